"""Vectors in cells around pivots: a similarity join and a search index whose bounds make them exact.

The angle between vectors is a distance, so what a cell's radius (the greatest angle to its pivot) and a vector's angle
to that pivot say about all of the cell's vectors is certain. Pivots are at most `most` vectors of the table, those of the
smallest hashes; they are a documented sample and decide only which cell a vector is in, never what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

#: Angles are computed with an error far below this; bounds give way by it.
SLACK = 1e-6
#: Rows whose visits are made at a time.
TRAVELLERS = 64
#: Bytes that a block's vectors have in double precision at most; products made at a time; pairs whose cosines are.
BLOCK_BYTES, STRIP, PIECE = 16 << 20, 1 << 21, 1 << 16


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _sound(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Vectors with a direction: not null, not zero, all components finite."""
    fine = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    return vectors.filter(fine)


def pivots_of(vectors: DataFrame, most: int = 512) -> np.ndarray:
    """At most `most` vectors of the commonest length, of the smallest hashes, as rows of length 1."""
    rows = vectors.select("embedding").withColumn("h", F.xxhash64("embedding")).orderBy("h").limit(most).collect()  # `most` vectors
    if not rows:
        return np.zeros((0, 0))
    size = len(rows[0]["embedding"])
    return _unit(np.array([r["embedding"] for r in rows if len(r["embedding"]) == size], np.float64))


def _one_length(vectors: DataFrame) -> int:
    sizes = vectors.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        raise ValueError("vectors of different lengths")
    return sizes["a"] or 0


class Rows:
    """A block's vectors: as single-precision rows of length 1 for products, and by component for exact cosines."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        self.parts = np.ascontiguousarray(_matrix(column).T)
        self.norm = np.sqrt(sum((x * x for x in self.parts), np.zeros(self.parts.shape[1])))
        self.unit = np.ascontiguousarray((self.parts / self.norm).T, np.float32)
        self.slack = (len(self.parts) + 8) * 2.0**-23  # more than products in single precision can be off

    def __len__(self) -> int:
        return len(self.norm)

    def cosines(self, p: np.ndarray, other: Rows, q: np.ndarray) -> np.ndarray:
        """Of rows p with the other's rows q; added up in the order of the components, as SQL does, so that equal vectors tie
        wherever they lie."""
        s = np.zeros(len(p))
        for x, y in zip(self.parts, other.parts):
            s += x[p] * y[q]
        return s / (self.norm[p] * other.norm[q])

    def screened(self, other: Rows, threshold: float, own: np.ndarray, theirs: np.ndarray):
        """p, q, cosine in single precision of own rows and their rows that may have one of at least threshold, a bounded number
        at a time. Where the other is self, and own rows are theirs too, in order, each two rows meet once."""
        once = other is self and own is theirs
        right, at = other.unit[theirs], 0
        while at < len(own):
            first = at + 1 if once else 0
            to = min(len(own), at + max(1, STRIP // max(1, len(theirs) - first)))
            s = self.unit[own[at:to]] @ right[first:].T
            p, q = np.nonzero(s >= np.float32(threshold - self.slack))
            if once:
                later = q + first > p + at
                p, q = p[later], q[later]
            yield own[at + p], theirs[first + q], s[p, q]
            at = to

    def close(self, other: Rows, threshold: float, own: np.ndarray, theirs: np.ndarray):
        """As screened(), but those with a cosine of at least threshold (rounded to 12 places), and that cosine."""
        for p, q, _ in self.screened(other, threshold, own, theirs):
            for k in range(0, len(p), PIECE):
                s = self.cosines(p[k : k + PIECE], other, q[k : k + PIECE])
                ok = np.flatnonzero(np.round(s, 12) >= threshold)
                yield p[k + ok], q[k + ok], s[ok]

    def near(self, threshold: float, own: np.ndarray, theirs: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which of own rows (down) and theirs (across) have a cosine of at least threshold and other keys."""
        s = self.unit[own] @ self.unit[theirs].T
        out = s >= np.float32(threshold + self.slack)
        p, q = np.nonzero((s >= np.float32(threshold - self.slack)) & ~out)
        out[p, q] = np.round(self.cosines(own[p], self, theirs[q]), 12) >= threshold
        return out & (keys[own][:, None] != keys[theirs][None, :])


def _visits(rows: pa.RecordBatch, pivots: np.ndarray, reach: float) -> pa.RecordBatch:
    """A copy of each row for its own cell and for each higher one of its project in which it may have a partner."""
    t = {c: rows.column(i) for i, c in enumerate(rows.schema.names)}
    near = _angles(_unit(_matrix(t["embedding"])), pivots)
    cell, own = t["cell"].to_numpy(), t["angle"].to_numpy()
    others = t["cells"].flatten()
    there, radius, blocks = (others.field(c).to_numpy() for c in ("cell", "radius", "blocks"))
    row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(t["cells"]).to_numpy())
    home, angle = there == cell[row], near[row, there]
    pick = np.flatnonzero(home | (there > cell[row]) & (angle <= radius + reach) & (angle - own[row] <= 2 * reach))
    of, own_columns = pa.array(row[pick]), [c for c in t if c not in ("cell", "angle", "cells")]
    return pa.RecordBatch.from_arrays(
        [*(t[c].take(of) for c in own_columns), pa.array(there[pick], pa.int32()), pa.array(blocks[pick], pa.int32()), pa.array(home[pick], pa.bool_())],
        [*own_columns, "there", "blocks", "home"],
    )


def block_rows(biggest: int, length: int) -> int:
    """Rows of a block, where the biggest project has so many: a quarter of them, so that rows are copied a few times and all cores
    have work, but at least 2,048 and no more than BLOCK_BYTES hold."""
    return max(1, min(BLOCK_BYTES // (8 * max(1, length)), max(2048, -(-biggest // 4))))


def _tiles(vectors: DataFrame, threshold: float, rows_per_cell: int | None = None, block: int | None = None, most: int = 512) -> tuple[DataFrame, list[DataFrame]]:
    """Rows dealt out to tiles (project, there, x, y) so that rows with a cosine of at least threshold meet in one, and the staged
    tables that this reads. In a tile where x is y its rows (side 1) meet each other, in any other those of side 1 those of side 2.

    A row of a lower cell visits a higher one of its project only if the triangle inequality leaves room for a partner
    there: its angle to that cell's pivot is at most the cell's radius and the threshold's angle, and at most twice the
    latter more than that to its own pivot, which is nearer to it. Cells and visitors meet in blocks of bounded size.
    Vectors without clusters visit nearly every cell, so cells are about as large as blocks: a row is copied about as
    often as its project has blocks, however many cells the table could have."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    own = ("id", "project", "key", "embedding", "done")
    rows = _sound(vectors.select("id", "project", "key", "embedding", F.col("done") if "done" in kinds else F.lit(False).alias("done")))
    length = _one_length(rows)
    biggest = rows.groupBy("project").count().agg(F.max("count")).first()[0] or 0
    block = block or block_rows(biggest, length)
    pivots = pivots_of(rows, max(1, min(most, biggest // (rows_per_cell or block))))
    reach = math.acos(max(-1.0, min(1.0, threshold))) + SLACK

    def settle(batches):
        for b in batches:
            if b.num_rows:
                near = _angles(_unit(_matrix(b.column(3))), pivots)
                cell = near.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(near[np.arange(len(cell)), cell])], [*b.schema.names, "cell", "angle"])

    schema = ", ".join(f"{c} {kinds.get(c, 'boolean')}" for c in own)
    homes = store.staged(rows.mapInArrow(settle, schema + ", cell int, angle double"), "cells")
    # A project's cells: at most one entry for each pivot.
    cells = homes.groupBy("project", "cell").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / block).cast("int").alias("blocks")).groupBy(F.col("project").alias("of")).agg(F.collect_list(F.struct("cell", "radius", "blocks")).alias("cells"))
    known = homes.join(cells, F.col("project").eqNullSafe(F.col("of"))).drop("of")

    def travel(batches):
        # A row may visit every cell of its project, and each visit copies its vector: few rows go at a time.
        for b in batches:
            for at in range(0, b.num_rows, TRAVELLERS):
                yield _visits(b.slice(at, TRAVELLERS), pivots, reach)

    moved = known.mapInArrow(travel, schema + ", there int, blocks int, home boolean")
    # A cell's rows lie in `blocks` blocks. A home row meets every block's rows that are not before its own, a visitor every block.
    lot = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id", "embedding"), F.col("blocks"))).otherwise(0).cast("int")
    dealt = store.staged(moved.withColumn("own", lot), "visits")
    visits = dealt.filter(~F.col("home")).withColumn("visit", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 20)).cast("int"))
    crowd = visits.groupBy("project", "there").agg(F.ceil(F.count("*") / block).cast("int").alias("groups")).select(F.col("project").alias("of"), F.col("there").alias("at"), "groups")
    here = F.col("project").eqNullSafe(F.col("of")) & (F.col("there") == F.col("at"))
    grouped = visits.join(crowd, here).select(*own, "there", "blocks", F.pmod(F.col("visit"), F.col("groups")).alias("guest"))
    guests = grouped.select(*own, "there", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), (F.col("guest") + F.lit(1 << 20)).alias("y"), F.lit(2).alias("side"))
    hosts = dealt.filter("home").join(crowd, here).select(*own, "there", F.col("own").alias("x"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"))
    hosts = hosts.select(*own, "there", "x", (F.col("g") + F.lit(1 << 20)).alias("y"), F.lit(1).alias("side"))
    inner = dealt.filter("home").select(*own, "there", F.col("own").alias("lot"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    inner = inner.select(*own, "there", F.least("lot", "o").alias("x"), F.greatest("lot", "o").alias("y"), F.when(F.col("lot") <= F.col("o"), 1).otherwise(2).alias("side"))
    return hosts.unionByName(guests).unionByName(inner), [homes, dealt]


def _keys(t: pa.Table) -> np.ndarray:
    return t.column("key").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()


def _meetings(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which rows of a tile meet which; two rows that are done make no pair."""
    side, done = t.column("side").to_numpy(), t.column("done").to_numpy(zero_copy_only=False).astype(bool)
    alone = t.column("x")[0].as_py() == t.column("y")[0].as_py()
    i = np.flatnonzero(side == 1)
    j = i if alone else np.flatnonzero(side == 2)
    if not len(i) or not len(j):
        return []
    free = i[~done[i]]
    return [(free, free), (free, i[done[i]])] if alone else [(free, j), (i[done[i]], j[~done[j]])]


def _met(t: pa.Table, threshold: float, below: float | None = None):
    """Rows a and b (by place in the tile; the smaller id is a's) and cosine of a tile's pairs, a bounded number at a time."""
    ids, keys, meetings = t.column("id").to_numpy(), _keys(t), _meetings(t)
    rows = Rows(t.column("embedding")) if meetings else None
    for own, theirs in meetings:
        for p, q, s in rows.close(rows, threshold, own, theirs):
            ok = (keys[p] != keys[q]) & (ids[p] != ids[q])
            if below is not None:
                ok &= np.round(s, 12) < below
            p, q = p[ok], q[ok]
            turned = ids[p] > ids[q]
            yield np.where(turned, q, p), np.where(turned, p, q), s[ok]


def _pairs(met: DataFrame, threshold: float, below: float | None = None) -> DataFrame:
    """a, b, similarity, a_done, b_done of the tiles' pairs with a cosine of at least threshold and, if it is given, under `below`."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        ids, done = t.column("id").to_numpy(), t.column("done").to_numpy(zero_copy_only=False).astype(bool)
        for a, b, s in _met(t, threshold, below):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64()), pa.array(s, pa.float64()), pa.array(done[a]), pa.array(done[b])], ["a", "b", "similarity", "a_done", "b_done"])

    return met.groupBy("project", "there", "x", "y").applyInArrow(meet, "a long, b long, similarity double, a_done boolean, b_done boolean")


def _bound(met: DataFrame, threshold: float, below: float | None, most: int) -> float:
    """A cosine of at least threshold that at most about `most` of the tiles' pairs under `below` reach: the threshold if those are
    all, else the edge of one of some thousand classes, which get narrower towards 1. One class is taken however many it has."""
    edges = np.unique(np.concatenate([1 - np.geomspace(1e-7, max(1 - threshold, 2e-7), 400), np.linspace(threshold, 1, 4000)]))
    edges = edges[edges >= threshold] if below is None else edges[(edges >= threshold) & (edges < below)]

    def count(t: pa.Table) -> pa.Table:
        n, meetings = np.zeros(len(edges), np.int64), _meetings(t)
        rows = Rows(t.column("embedding")) if meetings else None
        for own, theirs in meetings:
            for _, _, s in rows.screened(rows, threshold, own, theirs):
                s = s if below is None else s[s < below + rows.slack]
                n += np.bincount(np.maximum(np.searchsorted(edges, s, "right") - 1, 0), minlength=len(edges))
        some = np.flatnonzero(n)
        return pa.table([pa.array(some, pa.int32()), pa.array(n[some])], ["class", "n"])

    classes = met.groupBy("project", "there", "x", "y").applyInArrow(count, "class int, n long").groupBy("class").agg(F.sum("n").alias("n"))
    total = np.zeros(len(edges), np.int64)
    for r in classes.collect():  # a row for each class
        total[r["class"]] = r["n"]
    reached = total[::-1].cumsum()[::-1]
    fit = np.flatnonzero(reached <= most)
    low = fit[0] if len(fit) else len(edges)
    if low == 0:
        return threshold
    if low == len(edges) or not reached[low]:  # the strongest class that has any is too large
        low = np.flatnonzero(total)[-1]
    return float(edges[low])


def similar_pairs(vectors: DataFrame, threshold: float, rows_per_cell: int | None = None, block: int | None = None, most: int = 512) -> DataFrame:
    """a, b, similarity: pairs a < b of the same project (null equals null) with a cosine of at least threshold. vectors:
    id, project, key (equal keys are exact copies and left out), embedding; zero vectors and null ones have no pairs.
    Pairs leave a task as they are found, so that a dense tile needs no more room than another."""
    return _pairs(_tiles(vectors, threshold, rows_per_cell, block, most)[0], threshold).select("a", "b", "similarity")


@dataclass
class Nearest:
    """rows: id, similarity, best first; tier: what gave them (knn, bruteforce, none); read: vectors read; of: vectors there."""

    rows: DataFrame
    tier: str
    read: int
    of: int


class VectorIndex:
    """Unit vectors in a folder for each cell. Opening it checks that it is of the vectors' present version and length."""

    def __init__(self, spark: SparkSession, pivots: np.ndarray, cells: list[tuple[int, float, int]], version: str):
        self.spark, self.pivots, self.cells, self.version = spark, pivots, cells, version

    @classmethod
    def build(cls, spark: SparkSession, name: str, vectors: DataFrame, version: str, rows_per_cell: int = 1000, most: int = 512) -> VectorIndex:
        """Of vectors (id, embedding), in this version; built if it is not there. Vectors without a direction are left out."""
        rows = _sound(vectors.select(F.col("id").cast("long").alias("id"), "embedding"))
        if rows.isEmpty():
            return cls(spark, np.zeros((0, 0)), [], version)

        def place() -> DataFrame:
            _one_length(rows)
            pivots = pivots_of(rows, max(1, min(most, rows.count() // rows_per_cell)))

            def settle(batches):
                for b in batches:
                    if b.num_rows:
                        units = _unit(_matrix(b.column(1)))
                        near = _angles(units, pivots)
                        cell = near.argmin(axis=1)
                        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(units.tolist(), pa.list_(pa.float64())), pa.array(near[np.arange(len(cell)), cell]), pa.array(cell, pa.int32())], ["id", "unit", "angle", "cell"])

            return rows.mapInArrow(settle, "id long, unit array<double>, angle double, cell int").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4)))

        held = store.derived(spark, f"{name}-cells", version, place, ("cell",))
        known = store.derived(spark, f"{name}-centres", version, lambda: _centres(held)).orderBy("cell").collect()  # a row for each of `most` cells
        points = np.array([r["centre"] for r in known], np.float64).reshape(len(known), -1)
        made = cls(spark, points, [(r["cell"], r["radius"] + SLACK, r["n"]) for r in known], version)
        made.held = held
        return made

    def nearest(self, query: list[float], limit: int, hidden: DataFrame | None = None) -> Nearest:
        """The exact nearest rows. Cells are read from the nearest on until no cell left can hold a better row: a cell's
        rows are at least as far as its centre less its radius."""
        q = np.array(query, np.float64)
        if not self.cells or not np.any(q) or len(q) != self.pivots.shape[1]:
            return Nearest(self.spark.createDataFrame([], "id long, similarity double"), "none", 0, sum(n for *_, n in self.cells))
        q = q / np.sqrt(q @ q)
        far = _angles(q[None, :], self.pivots)[0]
        bounds = sorted((max(0.0, far[i] - radius), cell, n) for i, (cell, radius, n) in enumerate(self.cells))
        total, take, found = sum(n for *_, n in self.cells), 0, []
        dot = F.aggregate(F.zip_with("unit", F.array(*(F.lit(float(x)) for x in q)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

        def best(cells):
            rows = self.held.filter(F.col("cell").isin(*cells)).select("id", dot.alias("similarity"))
            if hidden is not None:
                rows = rows.join(hidden.select("id").distinct(), "id", "left_anti")
            return rows.orderBy(F.desc("similarity"), "id").limit(limit)

        step = 1
        while take < len(bounds):
            worst = math.acos(max(-1.0, min(1.0, found[-1]["similarity"]))) + SLACK if len(found) == limit else math.inf
            more = [cell for bound, cell, _ in bounds[take : take + step] if bound <= worst] if math.isinf(worst) else [cell for bound, cell, _ in bounds[take:] if bound <= worst]
            if not more:
                break
            found = sorted(found + best(more).collect(), key=lambda r: (-r["similarity"], r["id"]))[:limit]  # limit rows a step
            take, step = take + len(more), 4 * step
        rows = self.spark.createDataFrame([(r["id"], r["similarity"]) for r in found], "id long, similarity double")
        return Nearest(rows, "knn", sum(n for *_, n in bounds[:take]), total)


def _centres(held: DataFrame) -> DataFrame:
    """cell, centre, radius, n: the direction of a cell's mean is nearer to its rows than the pivot that drew them."""
    row = held.select(F.size("unit").alias("n")).first()
    mean = F.array(*(F.avg(F.get("unit", i)) for i in range(row["n"] if row else 0))).cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    means = held.groupBy("cell").agg(mean.alias("mean"), F.count("*").alias("n")).withColumn("norm", F.sqrt(dot("mean", "mean")))
    axis = F.transform("mean", lambda x, i: F.when(i == 0, 1.0).otherwise(0.0))  # a mean of no direction: any will do
    at = means.select("cell", "n", F.when(F.col("norm") > 1e-9, F.transform("mean", lambda x: x / F.col("norm"))).otherwise(axis).alias("centre"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("unit", "centre"))))
    return held.join(F.broadcast(at), "cell").groupBy("cell").agg(F.first("centre").alias("centre"), F.max(angle).alias("radius"), F.first("n").alias("n"))


def search(index: VectorIndex | None, vectors: DataFrame, version: str, query: list[float], limit: int, hidden: DataFrame | None = None) -> Nearest:
    """By the index if it is of this version of the vectors (id, embedding) and answers; else by reading all vectors; the tier says
    what gave the rows. An index that is missing, older, of another length or empty while vectors are there is passed over."""
    if index is not None and index.version == version:
        found = index.nearest(query, limit, hidden)
        if found.tier == "knn":
            return found
    own = _sound(vectors).filter(F.size("embedding") == len(query))
    n = own.count()
    size = math.sqrt(sum(float(x) ** 2 for x in query))
    if not n or not size:
        return Nearest(vectors.sparkSession.createDataFrame([], "id long, similarity double"), "none", 0, n)
    if hidden is not None:
        own = own.join(hidden.select("id").distinct(), "id", "left_anti")
    from . import vector

    rows = vector.units(own).select("id", vector._dot(F.col("unit"), F.array(*(F.lit(float(x) / size) for x in query))).alias("similarity"))
    return Nearest(rows.orderBy(F.desc("similarity"), "id").limit(limit), "bruteforce", n, n)
