"""Cosine search, pairs above a threshold, and reciprocal rank fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Accumulated in double; null for a zero vector; an error for vectors of different lengths."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double")).otherwise(F.when(norm > 0, _dot(a, b) / norm))


def knn(vectors: DataFrame, query: list[float], limit: int, vector: str = "embedding", hidden: DataFrame | None = None) -> DataFrame:
    """Exact nearest rows by cosine; rows marked as duplicates go before the cut, so no over-fetch is needed."""
    if hidden is not None:
        vectors = vectors.join(hidden.select("id").distinct(), "id", "left_anti")
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.withColumn("similarity", cosine(F.col(vector), q)).orderBy(F.desc_nulls_last("similarity"), "id").limit(limit)


def units(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The vectors with `unit`, of length 1 (null for a zero vector): the stored form that search reads, so that a
    query costs one product a row."""
    norm = F.sqrt(_dot(F.col(vector), F.col(vector)))
    return vectors.withColumn("_n", F.explode(F.array(norm))).withColumn("unit", F.when(F.col("_n") > 0, F.transform(vector, lambda x: x.cast("double") / F.col("_n")))).drop("_n", vector)


def knn_units(stored: DataFrame, query: list[float], limit: int, hidden: DataFrame | None = None) -> DataFrame:
    """Exact nearest rows over stored unit vectors; vectors of another length than the query's take no part."""
    size = sum(float(x) * float(x) for x in query) ** 0.5
    if hidden is not None:
        stored = stored.join(hidden.select("id").distinct(), "id", "left_anti")
    if size == 0:
        return stored.limit(0).withColumn("similarity", F.lit(0.0))
    q = F.array(*(F.lit(float(x) / size) for x in query))
    return stored.filter(F.size("unit") == len(query)).withColumn("similarity", _dot(F.col("unit"), q)).orderBy(F.desc("similarity"), "id").limit(limit)


def _unit(values) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in values])
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.full_like(m, np.nan), where=n > 0)


def _blocks(df: DataFrame, size: int) -> int:
    return max(1, -(-df.count() // size))


def knn_many(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096, hidden: DataFrame | None = None) -> DataFrame:
    """The k nearest rows of every query (id, embedding): a block product for each pair of blocks, each group bounded.
    Marked duplicates (hidden: id) go before the cut."""
    if hidden is not None:
        vectors = vectors.join(hidden.select("id").distinct(), "id", "left_anti")
    n, m = _blocks(vectors, block), _blocks(queries, 512)
    part = lambda of: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")
    dealt = vectors.select("id", "embedding", F.lit(False).alias("q"), part(n).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("qb")).unionByName(
        queries.select("id", "embedding", F.lit(True).alias("q"), part(m).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rb"))
    )

    def search(t: pa.Table) -> pa.Table:
        isq, ids, v = t.column("q").to_numpy(zero_copy_only=False), t.column("id").to_numpy(), t.column("embedding").to_pylist()
        out: list[list] = [[], [], []]
        if isq.any() and not isq.all():
            u = _unit(v)
            s = u[isq] @ u[~isq].T
            rows = ids[~isq]
            for q, line in zip(ids[isq], s):
                best = np.lexsort((rows, -np.nan_to_num(np.round(line, 12), nan=-2)))[:k]
                out[0] += [int(q)] * len(best)
                out[1] += rows[best].tolist()
                out[2] += line[best].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "id", "similarity"])

    found = dealt.groupBy("rb", "qb").applyInArrow(search, "query_id long, id long, similarity double")
    ranked = found.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("similarity", 9)), "id")))
    return ranked.filter(F.col("place") <= k)


def pairs(vectors: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """Pairs a < b of the same project (null equals null) with cosine of at least threshold. vectors: id, project,
    key (equal keys are exact copies and left out), embedding. Blocks of rows meet pairwise, so a group is bounded
    however large a project is."""
    n = _blocks(vectors, block)
    dealt = vectors.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("lo", F.least("b", "o")).withColumn("hi", F.greatest("b", "o"))

    def meet(t: pa.Table) -> pa.Table:
        ids, own, key = t.column("id").to_numpy(), t.column("b").to_numpy(), np.array(t.column("key").to_pylist(), object)
        u, lo = _unit(t.column("embedding").to_pylist()), t.column("lo")[0].as_py()
        i, j = np.flatnonzero(own == lo), np.flatnonzero(own != lo)  # one is empty where the project has no rows in a block: no pairs then
        if t.column("lo")[0].as_py() == t.column("hi")[0].as_py():
            i = j = np.arange(len(ids))
        s = u[i] @ u[j].T
        x, y = np.nonzero(np.round(s, 12) >= threshold)
        a, b, v = ids[i[x]], ids[j[y]], s[x, y]
        ok = (key[i[x]] != key[j[y]]) & ((a < b) if i is j else (a != b))
        a, b, v = a[ok], b[ok], v[ok]
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(v, pa.float64())], ["a", "b", "similarity"])

    both = dealt.filter((F.col("lo") != F.col("hi")) | (F.col("b") == F.col("o")))
    return both.groupBy("project", "lo", "hi").applyInArrow(meet, "a long, b long, similarity double")


def fuse(first: DataFrame, second: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (key, place from 1): score, source and both places. Ties go to the
    better place in the first list, then in the second."""
    one = first.select("key", F.col("place").alias("p1"))
    two = second.select("key", F.col("place").alias("p2"))
    share = lambda p: F.coalesce(1.0 / (k + F.col(p)), F.lit(0.0))
    joined = one.join(two, "key", "full_outer").withColumn("score", share("p1") + share("p2"))
    source = F.when(F.col("p1").isNull(), "vec").when(F.col("p2").isNull(), "fts").otherwise("both")
    return joined.withColumn("source", source).orderBy(F.desc("score"), F.asc_nulls_last("p1"), F.asc_nulls_last("p2"), "key").limit(limit)
