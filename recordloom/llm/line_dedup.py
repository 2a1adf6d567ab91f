"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

Null and empty text count as one empty line. Rows with a null doc_id neither count towards a line's documents
nor lose lines. Rows that repeat a doc_id are the same document: they count once and lose the same lines.
An empty table gives an empty result; columns other than doc_id and text are ignored. A text is split whole, however
long; its state is its own lines.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, byte_texts, slices, stage


#: The most lines that are joined by broadcast.
FREQUENT = 10_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line that may be dropped, else None. bytes.lower() changes A-Z only."""
    key = line.strip(WHITE)
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()


def _key_hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each document row and distinct long line: doc_id, h1, h2 (128 bits, so no two lines meet)."""

    def explode(batches):
        for batch in slices(batches):
            ids, h1, h2 = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                if doc is None or text is None or len(text) < min_chars:
                    continue
                keys = {line_key(x, min_chars) for x in text.split(b"\n") if len(x) >= min_chars} - {None}
                for key in keys:
                    a, b = _key_hash(key)
                    ids.append(doc)
                    h1.append(a)
                    h2.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["doc_id", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(explode, "doc_id long, h1 long, h2 long")


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop every line whose key has min_chars code points and occurs in min_docs documents, except in the
    document with the largest doc_id that holds it. Returns doc_id, n_lines, n_dropped, kept_sha256, and the
    kept text as `text` if with_text, then the columns of docs that carry names."""
    pairs = stage(line_hashes(docs, min_chars), "lines")
    common = stage(pairs.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs), "common")
    # A line of more than 1 / FREQUENT of all rows would fill one task of a join; there are FREQUENT such lines at most,
    # so those are broadcast (24 bytes each), and only the others' rows are dealt by line.
    share = pairs.count() / FREQUENT
    often = common.filter(F.col("n") > share).select("h1", "h2", "keeper")
    seldom = common.filter(F.col("n") <= share).select("h1", "h2", "keeper")
    held = pairs.join(F.broadcast(often), ["h1", "h2"]).unionByName(pairs.join(F.broadcast(often), ["h1", "h2"], "left_anti").join(seldom, ["h1", "h2"]))
    drops = (
        held.filter(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
        .withColumnRenamed("doc_id", "drop_id")
    )
    joined = docs.select("doc_id", "text", *carry).join(drops, F.col("doc_id").cast("long") == F.col("drop_id"), "left").select("doc_id", "text", F.col("drops.h1").alias("d1"), F.col("drops.h2").alias("d2"), *carry)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def rebuild(batches):
        for batch in slices(batches):
            n_lines, n_dropped, sha, kept = [], [], [], []
            d1, d2 = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for text, a, b in zip(byte_texts(batch.column(1)), d1, d2):
                lines = (text or b"").split(b"\n")
                n_lines.append(len(lines))
                if a:
                    drop = set(zip(a, b))
                    lines = [x for x in lines if len(x) < min_chars or (key := line_key(x, min_chars)) is None or _key_hash(key) not in drop]
                n_dropped.append(n_lines[-1] - len(lines))
                out = b"\n".join(lines)
                sha.append(hashlib.sha256(out).hexdigest())
                if with_text:
                    kept.append(None if text is None else out)
            arrays = [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[4:]], [*names, *carry])

    return joined.mapInArrow(rebuild, f"doc_id {id_type}, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text + "".join(f", {n} {docs.schema[n].dataType.simpleString()}" for n in carry))
