"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item's windows are sets of word shingles that a document must hold whole, so by the prefix filter one
shingle is enough to find every match: the rarest of the window in the corpus. Documents are joined to windows on
that shingle; the length bound (a window may not be longer than the document) and the positional bound (the
shingle's place fixes where the window starts) drop candidates, and the rest are compared word by word.

Null text has no words. Items with the same item_id count once; an item without an id marks words but is not named.
Rows that repeat, extra columns and empty tables are fine.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_texts, slices, stage

#: Lower-cases A-Z, keeps digits, a-z and every non-ASCII byte, and makes all else a blank.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def _windows(items: DataFrame, size: int) -> DataFrame:
    """item_id (as string) and words (space-joined) of every window."""

    def explode(batches):
        for batch in slices(batches):
            ids, out = [], []
            for item, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                words = words_of(text)
                for at in range(max(1, len(words) - size + 1) if words else 0):
                    ids.append(item)
                    out.append(b" ".join(words[at : at + size]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], ["item_id", "words"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(explode, "item_id string, words string").distinct()


def _hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


class Matcher:
    """Shingles to look for, by first word: a document's words are looked up once each."""

    def __init__(self, shingles):
        self.first: dict[bytes, dict[int, dict[tuple, list]]] = {}
        for words, value in shingles:
            self.first.setdefault(words[0], {}).setdefault(len(words), {}).setdefault(tuple(words), []).append(value)

    def find(self, words: list[bytes]):
        """(position, values) of every shingle that occurs."""
        first = self.first
        for at, word in enumerate(words):
            if (lengths := first.get(word)) is not None:
                for n, table in lengths.items():
                    if (values := table.get(tuple(words[at : at + n]))) is not None:
                        yield at, values


def _shingles(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    size = min(size, len(words))
    return [tuple(words[at : at + size]) for at in range(len(words) - size + 1)]


def _judge(words: list[bytes], candidates) -> tuple[int, set]:
    """Words hit and items found, from candidates (start, window words, item ids)."""
    hit, items, n = bytearray(len(words)), set(), len(words)
    for start, window, ids in candidates:
        if start >= 0 and start + len(window) <= n and words[start : start + len(window)] == window:
            hit[start : start + len(window)] = b"\x01" * len(window)
            items.update(ids)
    return sum(hit), items


_OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _rows(columns: list[pa.Array], carry: tuple[str, ...], judged: list[tuple[int, int, set]]) -> pa.RecordBatch:
    """columns: doc_id and those carried."""
    named = [sorted(x for x in items if x is not None) for _, _, items in judged]
    return pa.RecordBatch.from_arrays(
        [columns[0], pa.array([x[0] for x in judged], pa.int64()), pa.array([x[1] for x in judged], pa.int64()), pa.array([len(x) for x in named], pa.int64()),
         pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], pa.string()), pa.array([x[1] > 0 and 20 * x[1] >= x[0] for x in judged], pa.bool_()), *columns[1:]],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *carry],
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 5, broadcast_windows: int = 200_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the columns that carry names. Up to broadcast_windows benchmark
    windows (about 100 bytes each) go to every executor; beyond that the shingles of both sides are shuffled."""
    windows = stage(_windows(items, window).groupBy("words").agg(F.collect_set("item_id").alias("items")), "windows")
    small = windows.limit(broadcast_windows + 1).count() <= broadcast_windows
    return (_by_broadcast if small else _by_shuffle)(docs, windows, shingle, carry)


def _schema(docs: DataFrame, carry: tuple[str, ...]) -> str:
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return ", ".join([f"doc_id {kind['doc_id']}", _OUT, *(f"{n} {kind[n]}" for n in carry)])


def _by_broadcast(docs: DataFrame, windows: DataFrame, shingle: int, carry: tuple[str, ...]) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    held = [(r["words"].encode().split(b" "), r["items"]) for r in windows.collect()]
    wanted = sc.broadcast(sorted({s for words, _ in held for s in _shingles(words, shingle)}))

    def count(batches):
        matcher, n = Matcher((list(s), i) for i, s in enumerate(wanted.value)), {}
        for batch in slices(batches):
            for text in byte_texts(batch.column(0)):
                for _, (i,) in matcher.find(words_of(text)):
                    n[i] = n.get(i, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["shingle", "n"])

    often = {r["shingle"]: r["n"] for r in docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()} if held else {}
    rarity = {s: often.get(i, 0) for i, s in enumerate(wanted.value)}
    prefixes = []
    for words, ids in held:
        own = _shingles(words, shingle)
        at = min(range(len(own)), key=lambda i: (rarity[own[i]], own[i]))
        if rarity[own[at]]:  # a shingle that never occurs ends the search for its window
            prefixes.append((list(own[at]), (at, words, ids)))
    index = sc.broadcast(prefixes)

    def match(batches):
        matcher = Matcher(index.value)
        for batch in slices(batches):
            judged = []
            for text in byte_texts(batch.column(1)):
                words = words_of(text)
                found = ((pos - at, window, ids) for pos, values in matcher.find(words) for at, window, ids in values)
                judged.append((len(words), *_judge(words, found)))
            yield _rows([batch.column(0), *batch.columns[2:]], carry, judged)

    return docs.select("doc_id", "text", *(F.col(n).alias(f"_{n}") for n in carry)).mapInArrow(match, _schema(docs, carry))


def _by_shuffle(docs: DataFrame, windows: DataFrame, shingle: int, carry: tuple[str, ...]) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    lengths = sorted(r[0] for r in windows.select(F.least(F.size(F.split("words", " ")), F.lit(shingle)).alias("n")).distinct().collect())

    def window_shingles(batches):
        for batch in slices(batches):
            rows = [(w, at, _hash(list(s))) for w in batch.column(0).to_pylist() for at, s in enumerate(_shingles(w.encode().split(b" "), shingle))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["words", "at", "h"])

    def doc_shingles(batches):
        for batch in slices(batches, 200):
            ids, pos, hs = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                words = words_of(text)
                for n in lengths:
                    for at in range(len(words) - n + 1):
                        ids.append(doc)
                        pos.append(at)
                        hs.append(_hash(words[at : at + n]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(pos, pa.int32()), pa.array(hs, pa.int64())], ["doc_id", "pos", "h"])

    exploded = windows.select("words").mapInArrow(window_shingles, "words string, at int, h long")
    wanted = exploded.select("h").distinct()
    seen = stage(docs.select("doc_id", "text").mapInArrow(doc_shingles, f"doc_id {id_type}, pos int, h long").join(wanted, "h", "left_semi"), "shingles")
    rarity = seen.groupBy("h").count()
    prefixes = exploded.join(rarity, "h", "left").withColumn("rank", F.row_number().over(W.partitionBy("words").orderBy(F.coalesce("count", F.lit(0)), "h", "at"))).filter("rank = 1 and count > 0").join(windows, "words").select("h", "at", "words", "items")
    candidates = (
        seen.join(prefixes, "h").filter(F.col("pos") >= F.col("at"))
        .groupBy("doc_id").agg(F.collect_set(F.struct((F.col("pos") - F.col("at")).alias("start"), "words", "items")).alias("found"))
        .withColumnRenamed("doc_id", "found_id")
    )
    held = docs.select("doc_id", "text", *(F.col(n).alias(f"_{n}") for n in carry))
    joined = held.join(candidates, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select("doc_id", "text", "found", *(f"_{n}" for n in carry))

    def match(batches):
        for batch in slices(batches):
            judged = []
            for text, found in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist()):
                words = words_of(text)
                judged.append((len(words), *_judge(words, ((c["start"], c["words"].encode().split(b" "), c["items"]) for c in found or []))))
            yield _rows([batch.column(0), *batch.columns[3:]], carry, judged)

    return joined.mapInArrow(match, _schema(docs, carry))
