"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within `radius` = 3 bits meet at a word half-way between them. Half of 3 is not whole, and a ball of
radius 2 has 2,081 words; so one of four 16-bit parts is masked in turn. For at least one mask a differing bit is
masked, at most 2 differ in the 48 bits left, and half of 2 is 1: every fingerprint emits, for each mask, its 48 bits
and their 48 one-bit variants. Fingerprints that meet at a (mask, word) are verified on all 64 bits there.

A bucket holds at most 2^16 different values of its masked part, and fingerprints that share one are linked anyway
(they differ in 2 bits at most), so a bucket's state is bounded however large its group of copies. Only links that
survive go on; components come from alternating large-star and small-star rounds over staged tables.

Documents with equal fingerprints are one node, so exact copies never make pairs. Null or blank text has fingerprint
zero and is linked like any other. Rows that repeat a doc_id are kept each; a null doc_id takes part but is never a
component's name unless no other is there (then component_id is null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, release, slices, stage

PARTS, WIDTH = 4, 16
_U = np.uint64


def fingerprint(text: bytes | None, size: int = 3) -> int:
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= size:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(g, 42) for g in grams]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 65_536):
        ones += np.unpackbits(raw[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t, size) for t in byte_texts(batch.column(1))], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(make, f"doc_id {id_type}, fp long")


def _squeeze(fps: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The 48 bits outside the masked part, and the part."""
    low = _U(part * WIDTH)
    masked = (fps >> low) & _U(0xFFFF)
    under = fps & _U((1 << part * WIDTH) - 1)
    over = (fps >> low >> _U(WIDTH)) << low
    return over | under, masked


def ball(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (mask number above 48 bits) and payloads (flipped bit or 63, above the masked part)."""
    keys, loads = [], []
    for part in range(PARTS):
        word, masked = _squeeze(fps, part)
        for bit in [63, *range(48)]:
            keys.append((word if bit == 63 else word ^ _U(1 << bit)) | _U(part << 48))
            loads.append(masked | _U(bit << 16))
    return np.concatenate(keys), np.concatenate(loads)


def unball(keys: np.ndarray, loads: np.ndarray) -> np.ndarray:
    """The fingerprints that emitted these."""
    bit, part = loads >> _U(16), keys >> _U(48)
    word = (keys & _U((1 << 48) - 1)) ^ np.where(bit < 48, _U(1) << np.minimum(bit, _U(47)), _U(0))
    low = part * _U(WIDTH)
    under = word & ((_U(1) << low) - _U(1))
    return ((word >> low) << low << _U(WIDTH)) | ((loads & _U(0xFFFF)) << low) | under


def _small_buckets(fps: np.ndarray, group: np.ndarray, largest: int, radius: int):
    """Verified pairs within groups of at most `largest` rows."""
    for step in range(1, largest):
        at = np.flatnonzero(group[step:] == group[:-step])
        if not len(at):
            return
        a, b = fps[at], fps[at + step]
        ok = np.bitwise_count(a ^ b) <= radius
        yield a[ok], b[ok]


_NEAR = {r: np.array([m for m in range(1 << WIDTH) if 0 < m.bit_count() <= r], np.int64) for r in (1, 2, 3)}


def _large_bucket(fps: np.ndarray, loads: np.ndarray, radius: int):
    """Links of one bucket of any size, as stars: labels spread over the table of its masked values."""
    value, one = (loads & _U(0xFFFF)).astype(np.int64), (loads >> _U(16)) < 48
    order = np.lexsort((fps, one, value))
    head = order[np.r_[True, value[order][1:] != value[order][:-1]]]
    place = np.full(1 << WIDTH, -1, np.int64)
    place[value[head]] = np.arange(len(head))
    yield fps, fps[head][place[value]]  # equal masked values
    label, off = np.arange(len(head)), one[head].astype(np.int64)
    while True:
        before = label.copy()
        for m in _NEAR[min(radius, 3)]:
            other = place[value[head] ^ m]
            near = (other >= 0) & (off + off[other] + int(m).bit_count() <= radius)
            np.minimum.at(label, np.flatnonzero(near), label[other[near]])
        label = label[label]
        if (label == before).all():
            break
    yield fps[head], fps[head][label]


def links(fps: DataFrame, radius: int = 3, most: int = 64) -> DataFrame:
    """Pairs a < b of different fingerprints that connect all that lie within radius. fps has a column fp of
    distinct values."""

    def emit(batches):
        for batch in slices(batches, 4000):
            keys, loads = ball(batch.column(0).to_numpy().view(_U))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(loads.astype(np.int32))], ["key", "load"])

    def meet(batches):
        held_k, held_l = np.empty(0, _U), np.empty(0, _U)

        def out(keys, loads):
            same = keys[1:] == keys[:-1]
            keep = np.r_[same, False] | np.r_[False, same]
            keys, loads = keys[keep], loads[keep]
            if not len(keys):
                return None
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[start, len(keys)])
            group, fp = np.repeat(np.arange(len(start)), size), unball(keys, loads)
            small = np.repeat(size <= most, size)
            found = list(_small_buckets(fp[small], group[small], most, radius))
            for s, n in zip(start[size > most], size[size > most]):
                found += _large_bucket(fp[s : s + n], loads[s : s + n], radius)
            if not found:
                return None
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

        for batch in batches:
            keys = np.r_[held_k, batch.column(0).to_numpy().view(_U)]
            loads = np.r_[held_l, batch.column(1).to_numpy().astype(_U)]
            last = np.flatnonzero(keys != keys[-1])
            cut = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
            held_k, held_l = keys[cut:], loads[cut:]
            if len(held_k) > 1 << 18:  # bounded: more rows than that share masked values
                fp, value = unball(held_k, held_l), held_l & _U(0xFFFF)
                order = np.lexsort((fp, held_l >> _U(16) < 48, value))
                head = order[np.r_[True, value[order][1:] != value[order][:-1]]]
                place = np.zeros(1 << WIDTH, np.int64)
                place[value[head].astype(np.int64)] = head
                a, b = fp.view(np.int64), fp[place[value.astype(np.int64)]].view(np.int64)
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])
                held_k, held_l = held_k[head], held_l[head]
            if cut and (rows := out(keys[:cut], loads[:cut])) is not None:
                yield rows
        if len(held_k) and (rows := out(held_k, held_l)) is not None:
            yield rows

    # A few bytes a row before, 196 rows after: dealt out first, or one task would emit for a whole file.
    spark = fps.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    emitted = fps.select("fp").repartition(tasks).mapInArrow(emit, "key long, load int")
    shuffled = emitted.repartition("key").sortWithinPartitions("key")
    return shuffled.mapInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the smallest node of its component. Alternates
    large-star and small-star; each round is staged, and both use only min-aggregates and joins."""
    edges = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = state_of(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        after = stage(small, "edges")
        state = state_of(after)
        release(edges)
        edges = after
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """Returns doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of at most
    `radius` differing bits). radius is 2 or 3."""
    if radius not in (2, 3):
        raise ValueError("radius must be 2 or 3")
    prints = stage(fingerprints(docs, size), "prints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, radius))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.join(names, "root").select(F.col("fp").alias("node"), "component_id")
    return prints.join(linked, F.col("fp") == F.col("node")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
