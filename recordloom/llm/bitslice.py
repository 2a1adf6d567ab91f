"""Exact top-k search by inner product over a bit-sliced index.

Components are floor(256 * x). Rows are dealt into blocks; in a block each attribute becomes bit slices, one bitmap
over the block's rows for each bit of its value above the lowest `cut` bits. A query's scores are sums of slices
shifted by the set bits of its weights, added with carry-save bitmap arithmetic. The k-th best coarse score is read
from the most significant slice of the sum downward; rows that the dropped low bits could still bring up to it are
the boundary rows, and those are scored exactly.

Each row is in one block, whose index is built once; the queries pass it in chunks. Nothing is broadcast or collected. Vectors
that are null, empty or hold a null or a non-finite component take no part, nor do rows without an id. Vectors of
different lengths are never compared. A (vec_id, vector) row that repeats counts once; where one id has several
vectors, the smallest is its query. Vectors with a component beyond +-2^20 after scaling stay out of the index and are
scored exactly in whole numbers, as queries and as rows; a score that no long holds is the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

_LIMIT, _MOST = 1 << 20, (1 << 63) - 1
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantise(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v (array of int) and wide (array of long): one of them is null."""
    ok = F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(vector, lambda x: F.greatest(F.floor(x.cast("double") * scale), F.lit(-_MOST)))
    narrow = F.forall("wide", lambda x: F.abs(x) <= _LIMIT)
    known = vectors.filter(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("wide"))
    return known.select("vec_id", F.when(narrow, F.col("wide").cast("array<int>")).alias("v"), F.when(~narrow, F.col("wide")).alias("wide")).distinct()


def _slices(values: np.ndarray, bits: int) -> np.ndarray:
    """(attributes, bits, words): bitmaps over the rows of non-negative values (rows, attributes)."""
    rows, attributes = values.shape
    words = -(-rows // 64)
    out = np.zeros((attributes, bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((values >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return out.view(np.uint64)


class BitSlicedBlock:
    """The index of one block of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, cut: int = 2):
        self.ids, self.values, self.cut = ids, values, cut
        self.low = values.min(axis=0)
        self.bits = max(1, int((values - self.low).max() >> cut).bit_length())
        self.slices = _slices((values - self.low) >> cut, self.bits)
        self.words = self.slices.shape[2]
        self.real = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
        self.real[: len(packed)] = packed
        self.real = self.real.view(np.uint64)

    def coarse(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of sum |w| * coarse, where an attribute of negative weight enters as
        its complement. weights: (queries, attributes)."""
        size, flip = np.abs(weights), np.where(weights < 0, _ALL, np.uint64(0))
        queries, top = len(weights), int(np.abs(weights).max()).bit_length()
        columns: list[list[np.ndarray]] = [[] for _ in range(top + self.bits + 1)]
        out, at = [], 0

        def add(level):  # three bitmaps of one weight become one of it and one of the next
            a, b, c = columns[level].pop(), columns[level].pop(), columns[level].pop()
            half = a ^ b
            columns[level].append(half ^ c)
            half &= c
            a &= b
            half |= a
            if level + 1 == len(columns):
                columns.append([])
            columns[level + 1].append(half)

        for d in range(weights.shape[1]):
            if not size[:, d].any():
                continue
            turned = [self.slices[d, b][None, :] ^ flip[:, d][:, None] for b in range(self.bits)]
            for w in range(top):
                chosen = np.where(size[:, d] >> w & 1, _ALL, np.uint64(0))[:, None]
                if not chosen.any():
                    continue
                for b, bitmap in enumerate(turned):
                    columns[w + b].append(bitmap & chosen)
            for level in range(len(columns) + 8):
                while level < len(columns) and len(columns[level]) >= 3:
                    add(level)
        zero = np.zeros((queries, self.words), np.uint64)
        while at < len(columns):
            while len(columns[at]) >= 2:
                if len(columns[at]) == 2:
                    columns[at].append(zero.copy())
                add(at)
            out.append(columns[at][0] if columns[at] else zero)
            at += 1
        return out

    def top(self, queries: np.ndarray, k: int, own: np.ndarray):
        """For each query the k best (score, row): most significant slice downward, then boundary rows exactly."""
        size = np.abs(queries)
        total = self.coarse(queries)
        alive = np.broadcast_to(self.real, total[0].shape)
        surely, level = np.zeros_like(total[0]), np.zeros(len(queries), np.int64)
        need = k + 1  # one more: the query's own row may be among them
        for at in range(len(total) - 1, -1, -1):
            upper = alive & total[at]
            enough = np.bitwise_count(surely | upper).sum(axis=1) >= need
            level += np.where(enough, 1 << at, 0)
            surely = np.where(enough[:, None], surely, surely | upper)
            alive = np.where(enough[:, None], upper, alive & ~total[at])
        # Dropped low bits change a score by less than this much, so exact order needs all rows down to level - slack.
        slack = size.sum(axis=1) * ((1 << self.cut) - 1)
        floor = np.maximum(level - slack, 0)
        over, equal = np.zeros_like(total[0]), np.broadcast_to(self.real, total[0].shape)
        for at in range(len(total) - 1, -1, -1):
            bit = (floor >> at & 1).astype(bool)[:, None]
            over = np.where(bit, over, over | (equal & total[at]))
            equal = np.where(bit, equal & total[at], equal & ~total[at])
        boundary = np.unpackbits((over | equal).view(np.uint8), axis=1, bitorder="little")[:, : len(self.ids)]
        for q in range(len(queries)):
            rows = np.flatnonzero(boundary[q])
            rows = rows[self.ids[rows] != own[q]]
            scores = self.values[rows] @ queries[q]
            best = np.lexsort((self.ids[rows], -scores))[:k]
            yield scores[best], self.ids[rows[best]]


def _exactly(weights: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int, own: np.ndarray):
    """For each query the k best (score, row) by arithmetic of any size."""
    rows = values.astype(object)
    for query, mine in zip(weights.astype(object), own):
        other = np.flatnonzero(ids != mine)
        scores = rows[other] @ query
        best = sorted(range(len(other)), key=lambda i: (-scores[i], ids[other[i]]))[:k]
        yield np.array([max(min(scores[i], _MOST), -_MOST) for i in best], np.int64), ids[other[best]]


class _Rows:
    """One block of rows while the queries pass: its index, built once, and the rows that stay out of it."""

    def __init__(self, dim: int):
        self.dim, self.parts, self.index = dim, [], None

    def add(self, ids: np.ndarray, values: np.ndarray, is_wide: np.ndarray) -> None:
        self.parts.append((ids, values, is_wide))

    def top(self, ids: np.ndarray, values: np.ndarray, is_wide: np.ndarray, k: int):
        """(queries, their k best in this block) for each kind of query and row."""
        if self.parts:
            self.ids, self.values, self.wide = (np.concatenate(x) for x in zip(*self.parts))
            self.parts, plain = [], ~self.wide
            self.index = BitSlicedBlock(self.ids[plain], self.values[plain]) if plain.any() else None
        elif self.index is None and not hasattr(self, "ids"):
            return
        if self.index is not None and not is_wide.all():
            yield ids[~is_wide], self.index.top(values[~is_wide], k, ids[~is_wide])
        for asked, rows in ((~is_wide, self.wide), (is_wide, np.ones(len(self.ids), bool))):
            if asked.any() and rows.any():
                yield ids[asked], _exactly(values[asked], self.ids[rows], self.values[rows], k, ids[asked])


def _read(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, values and whether they are wide, of rows of one length."""
    v, wide = (batch.column(batch.schema.get_field_index(n)) for n in ("v", "wide"))
    is_wide, ids = v.is_null().to_numpy(zero_copy_only=False), batch.column(batch.schema.get_field_index("vec_id")).to_numpy()
    values = np.empty((len(ids), dim), np.int64)
    for column, at in ((v, ~is_wide), (wide, is_wide)):
        if at.any():
            values[at] = column.flatten().to_numpy().reshape(-1, dim)
    return ids, values, is_wide


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vector: str = "embedding", row_block: int = 4096, chunk: int = 64) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by `every`. Returns query_id, rank, vec_id, score. An empty table
    gives an empty result; other columns are ignored, whatever their names."""
    spark = vectors.sparkSession
    rows = stage(quantise(vectors, vector), "vectors").withColumn("dim", F.size(F.coalesce("v", "wide")))
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.min(F.struct("v", "wide")).alias("least")).select("vec_id", "dim", "least.*")
    n = max(1, -(-rows.count() // row_block))
    # Every row goes to one block, every query to all: a block's rows come first, then the queries pass its index in
    # chunks, so a task holds one block and one chunk however many there are of either.
    own = rows.select("dim", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n)).cast("int").alias("block"), F.lit(False).alias("query"), "vec_id", "v", "wide")
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(True).alias("query"), "vec_id", "v", "wide")
    tasks = max(n, spark.sparkContext.defaultParallelism)
    dealt = own.unionByName(asked).repartition(tasks, "dim", "block").sortWithinPartitions("dim", "block", "query", "vec_id")

    def search(batches):
        now, held = None, None
        for batch in batches:
            dim, block, query = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cut = np.flatnonzero((np.diff(dim) != 0) | (np.diff(block) != 0) | (query[1:] != query[:-1])) + 1
            for start, end in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                if (key := (int(dim[start]), int(block[start]))) != now:
                    now, held = key, _Rows(key[0])
                if not query[start]:
                    held.add(*_read(batch.slice(start, end - start), key[0]))
                    continue
                for at in range(start, end, chunk):
                    out: list[list] = [[], [], []]
                    for ids, tops in held.top(*_read(batch.slice(at, min(chunk, end - at)), key[0]), k):
                        for q, (scores, found) in zip(ids, tops):
                            out[0] += [int(q)] * len(found)
                            out[1] += found.tolist()
                            out[2] += scores.tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
