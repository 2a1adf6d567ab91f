"""Integrity checks, statistics, evaluation and export manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, id_column: str, name: str, samples: int = 5) -> DataFrame:
    """check, n, samples (smallest ids) of rows whose key has no parent; no row if all have one."""
    lost = child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")
    few = lost.select(F.col(id_column).cast("long").alias("_id")).orderBy("_id").limit(samples).agg(F.array_sort(F.collect_list("_id")).alias("samples"))
    return lost.agg(F.count("*").alias("n")).join(few).filter("n > 0").select(F.lit(name).alias("check"), "n", "samples")


def gaps(rows: DataFrame, embedded: DataFrame, text: str, least: int = 10) -> DataFrame:
    """Rows long enough to embed that have no embedding."""
    return rows.filter(F.length(text) >= least).join(embedded.select("id").distinct(), "id", "left_anti")


def histogram(rows: DataFrame, column: str, always: tuple[str, ...] = ("unknown",)) -> DataFrame:
    """value, n with null as unknown; the values in `always` are there even at 0."""
    n = rows.groupBy(F.coalesce(column, F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    zero = spark.createDataFrame([(v, 0) for v in always], "value string, n long")
    return n.unionByName(zero).groupBy("value").agg(F.sum("n").alias("n"))


def counts(tables: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """table, n, n_filtered of each table."""
    out = None
    for name, (df, condition) in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.count_if(F.lit(True) if condition is None else condition).alias("n_filtered"))
        out = one if out is None else out.unionByName(one)
    return out


def retrieval_metrics(results: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """query_id, precision, found_share (of the relevant rows), rr at k. results: query_id, id, place; truth: query_id, id."""
    size = truth.groupBy("query_id").agg(F.countDistinct("id").alias("relevant"))
    hits = results.filter(F.col("place") <= k).join(truth.distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("place").alias("first"))
    zero = F.lit(0)
    return size.join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", zero) / k).alias("precision"), (F.coalesce("hits", zero) / F.col("relevant")).alias("found_share"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def nearest_rank(rows: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The ceil(p * n)-th value of each group."""
    return rows.groupBy(group).agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100)}") for p in shares))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n, hash: a row count and an order-free content hash for each exported table: the sum over its rows of the
    first 32 bits of the digest of its columns (by name, as text, null as a zero sign), in decimal."""
    out = None
    for name, df in tables.items():
        row = F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("∅")) for c in sorted(df.columns)))
        part = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("hash"))
        out = one if out is None else out.unionByName(one)
    return out


def freshness(rows: DataFrame, minute: str, now: int, hours: int = 48) -> DataFrame:
    last = F.max(minute)
    return rows.agg(F.count("*").alias("n"), last.alias("last"), F.when(F.count("*") == 0, "FAIL").when(last > now - hours * 60, "PASS").otherwise("WARN").alias("state"))


def newest(rows: DataFrame, keep: int, order: list[Column], by: str | None = None) -> DataFrame:
    """The first `keep` rows, of all or of each group."""
    if by is None:
        return rows.orderBy(*order).limit(keep)
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= keep).drop("_n")
