"""Near copies by shingles: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come first from SimHash: each document's 64 bits over its shingles, and simhash.links, whose half-way balls
connect all fingerprints of at most three differing bits. The documents of one such component meet. A pair at 0.8
differs in about ten bits, which no ball of feasible size reaches, so each document also has
`BANDS` fingerprints, each of `ROWS` minima of the hashed shingles. Two documents meet where one is equal: at
similarity s with chance 1 - (1 - s^4)^32, which is all but 5 in 10^8 at 0.8. Each pair that meets, by SimHash or by
minima, is then judged by all of its shingles, so the fingerprints decide only who is compared.

Documents with equal sets are one node, named by its smallest row. A shingle that no other compared node has can be in
no intersection, so a node's own shingles bound the size of its partners from above (its reach) by arithmetic alone: a
copy with many edits of its own is seen to have no partner without a comparison. Within a bucket (the nodes that share
a fingerprint) a few leaders, those with the fewest own shingles first, meet all others within reach; nodes that are
linked by then, or that no node of another component can reach, need no further comparison. More leaders follow, until
no bucket has an open node or all its pairs are compared. So a large group of copies costs a few rows for each copy,
and none is cut.

Texts are split and lower-cased as in simhash; one of fewer than five words is one shingle, and null or blank text the
empty set, which equals only itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, release, slices, stage
from .simhash import components
from .simhash import links as ball_links

BANDS, ROWS = 32, 4
#: Leaders of each bucket in the first round, and how many times as many in each further one.
LEADERS, MORE = 2, 64
_U = np.uint64
#: Classes of the spread. A class counts up to 32,767 names; a node with more in one is bounded by its other facts.
CLASSES = 64
_SEEDS = np.random.default_rng(20).integers(0, 1 << 63, (2, BANDS * ROWS)).astype(_U) << _U(1) | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """The sorted names of a text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, _U)
    names = np.array([xxhash.xxh3_64_intdigest(w) for w in words], _U)
    size = min(size, len(names))
    out = np.full(len(names) - size + 1, size, _U)
    for i in range(size):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + names[i : i + len(out)])
    return np.unique(out)


def _node(names: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(names.tobytes())


def _prints(names: np.ndarray) -> np.ndarray:
    """A document's fingerprints, one for each band."""
    least = np.full(BANDS * ROWS, _U(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(names), 256):
        least = np.minimum(least, ((names[at : at + 256] ^ _SEEDS[0, :, None]) * _SEEDS[1, :, None]).min(axis=1))
    out = np.arange(BANDS, dtype=_U)
    for column in least.reshape(BANDS, ROWS).T:
        out = _mix(out * _U(0x9E3779B97F4A7C15) + column)
    return out


def _simhash(names: np.ndarray) -> int:
    """The SimHash of a set of shingles by their names: a bit is 1 if more than half of them have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(names), 65_536):
        part = names[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(names)).view(np.int64)[0])


def _nodes(rows: DataFrame, size: int) -> DataFrame:
    """row, node, fp, prints of every row."""

    def make(batches):
        for batch in slices(batches):
            sets = [shingles(t, size) for t in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_node(s) for s in sets], pa.binary()), pa.array([_simhash(s) for s in sets], pa.int64()), pa.array([_prints(s).view(np.int64) for s in sets], pa.list_(pa.int64()))], ["row", "node", "fp", "prints"])

    return rows.select("row", "text").mapInArrow(make, "row long, node binary, fp long, prints array<long>")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """id, names (the shingles) of every row."""

    def make(batches):
        for batch in slices(batches, 500):
            sets = [shingles(t, size) for t in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "names"])

    return rows.select(F.col("row").alias("id"), "text").mapInArrow(make, "id long, names array<long>")


def _held(sets: DataFrame, fifths: int) -> DataFrame:
    """id, n (shingles), names (those that another node has too), own (how many are not), reach (the most shingles a
    partner can have) and spread (of the shared names, how many fall in each of CLASSES classes). With o shared shingles
    a pair is similar if (5 + fifths) * o >= fifths * (n_a + n_b); o is at most n - own of both, and at most what the
    two spreads have in common. Nodes that can have no partner at all (it has o shingles or more) are left out."""
    alone = sets.select("id", F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("in"), F.min("id").alias("id")).filter(F.col("in") == 1)
    joined = sets.join(alone.groupBy("id").agg(F.collect_list("name").alias("alone")), "id", "left").select("id", "names", "alone")

    def count(batches):
        for batch in slices(batches, 500):
            ids, n, names, spread = [], [], [], []
            for i, every, alone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                own = every.values.to_numpy()
                shared = np.setdiff1d(own, alone.values.to_numpy(), True) if alone.is_valid else own
                ids.append(i)
                n.append(len(own))
                names.append(shared)
                spread.append(np.minimum(np.bincount(shared & (CLASSES - 1), minlength=CLASSES), 32767).astype(np.int16))
            own = np.array(n, np.int64) - np.array([len(x) for x in names], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(own), pa.array(names, pa.list_(pa.int64())), pa.array(spread, pa.list_(pa.int16()))], ["id", "n", "own", "names", "spread"])

    facts = joined.mapInArrow(count, "id long, n long, own long, names array<long>, spread array<short>")
    return facts.withColumn("reach", F.floor((5 * F.col("n") - (5 + fifths) * F.col("own")) / F.lit(fifths))).filter(5 * F.col("reach") >= fifths * F.col("n"))


def _similar(pairs: DataFrame, sets: DataFrame, fifths: int) -> DataFrame:
    """The pairs a, b whose sets have a similarity of at least fifths / 5."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("names").alias(f"_{x}"), F.col("n").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("same", F.size(F.array_intersect("_a", "_b")))
    return both.filter((5 + fifths) * F.col("same") >= fifths * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _open(known: DataFrame) -> DataFrame:
    """The rows (key, id, n, own, reach, root) that a node of another component in their bucket may still be similar
    to: its size is within their reach and theirs within its. For each bucket the least size and the largest reach are
    kept for two components, so that each row is held against components other than its own."""
    parts = known.groupBy("key", "root").agg(F.min("n").alias("n"), F.max("reach").alias("reach"))
    first = parts.groupBy("key").agg(F.min(F.struct("n", "root")).alias("low"), F.max(F.struct("reach", "root")).alias("far"))
    other = parts.join(first, "key").groupBy("key").agg(
        F.first("low").alias("low"), F.first("far").alias("far"),
        F.min(F.when(F.col("root") != F.col("low.root"), F.col("n"))).alias("low2"), F.max(F.when(F.col("root") != F.col("far.root"), F.col("reach"))).alias("far2"),
    )
    held = known.join(other.filter("low2 is not null"), "key")
    least = F.when(F.col("root") == F.col("low.root"), F.col("low2")).otherwise(F.col("low.n"))
    most = F.when(F.col("root") == F.col("far.root"), F.col("far2")).otherwise(F.col("far.reach"))
    return held.filter((least <= F.col("reach")) & (F.col("n") <= most)).select(*known.columns)


def groups(rows: DataFrame, size: int = 5, fifths: int = 4) -> DataFrame:
    """row, root for every row (row: a long that is unique and the same whenever it is read; text): rows with one root
    are connected over pairs with a similarity of at least fifths / 5."""
    prints = stage(_nodes(rows, size), "near-prints")
    first = stage(prints.groupBy("node").agg(F.min("row").alias("id")), "near-nodes")
    nodes = prints.join(first.select(F.col("id").alias("row")), "row", "left_semi")
    linked = components(ball_links(nodes.select("fp").distinct()))
    balls = linked.toDF("fp", "ball")
    key = F.xxhash64(F.lit("ball"), F.coalesce("ball", "fp"))
    emitted = nodes.select("row", "fp", "prints").join(balls, "fp", "left").select(F.col("row").alias("id"), F.explode(F.concat("prints", F.array(key))).alias("key"))
    shared = emitted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    met_at = stage(emitted.join(shared, "key", "left_semi"), "near-buckets")
    every = stage(_sets(rows.join(met_at.select(F.col("id").alias("row")).distinct(), "row", "left_semi"), size), "near-sets")
    sets = stage(_held(every, fifths), "near-held")
    buckets = stage(met_at.join(sets.select("id", "n", "own", "reach", "spread"), "id").select("key", "id", "n", "own", "reach", "spread"), "near-open")
    roots = stage(sets.select("id", F.col("id").alias("root")), "near-roots")
    release(linked, met_at, every)
    leaders = LEADERS
    most = F.aggregate(F.zip_with("spread", "spread_", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    # A class that may hold more than it counts bounds nothing.
    close = ((5 + fifths) * most >= fifths * (F.col("n") + F.col("n_"))) | (F.greatest("n", "n_") >= 32_767)
    while True:
        # Settled rows never become open again: components only grow. A node that has led has met all others.
        known = stage(_open(buckets.join(roots, "id").select(*buckets.columns, "root")), "near-known")
        dealt = known.withColumn("class", F.pmod(F.xxhash64("id", F.lit(leaders)), F.lit(leaders)))
        best = dealt.groupBy("key", "class").agg(F.min(F.struct("own", "id", "n", "reach", "root", "spread")).alias("x"))
        chosen = stage(best.select("key", F.col("x.id").alias("leader"), *(F.col(f"x.{n}").alias(f"{n}_") for n in ("n", "reach", "root", "spread"))), "near-leaders")
        if chosen.isEmpty():
            release(known, chosen)
            break
        meeting = known.join(chosen, "key").filter((F.col("root") != F.col("root_")) & (F.col("n") <= F.col("reach_")) & (F.col("n_") <= F.col("reach")) & close)
        pairs = stage(meeting.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct(), "near-pairs")
        similar = stage(_similar(pairs, sets, fifths), "near-similar")
        if not similar.isEmpty():
            links = similar.join(roots.toDF("a", "u"), "a").join(roots.toDF("b", "v"), "b")
            linked = components(links.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).filter("a != b").distinct())
            new = stage(roots.join(linked.toDF("of", "to"), F.col("root") == F.col("of"), "left").select("id", F.coalesce("to", "root").alias("root")), "near-roots")
            release(roots, linked)
            roots = new
        left = stage(known.drop("root").join(chosen.select("key", F.col("leader").alias("id")), ["key", "id"], "left_anti"), "near-open")
        release(buckets, known, chosen, pairs, similar)
        buckets, leaders = left, leaders * MORE
    release(buckets, sets)
    named = prints.select("row", "node").join(first, "node").join(roots, "id", "left")
    return named.select("row", F.coalesce("root", "id").alias("root"))
