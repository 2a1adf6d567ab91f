"""Substring dedup by winnowing: words of windows that already start in an earlier document go.

This is not recompression: no run and no pair is named, and there are no naming rounds. A symbol of a run or pair that a
window's edge cuts is lost, and after a further round 13 words hold too few whole symbols to find every window that two
documents share, which the contract asks for.

Words get global names (64-bit content hashes, so every executor names alike and no dictionary is shuffled). One bit of
a name says left or right; a six-word phrase may begin where a left name stands before a right one, or at any word where
a window has no such place. What may begin inside a window depends on its own words alone, so the smallest phrase
name among its words 2 to 8 is the same wherever the window occurs: it is the window's key.

Step 1 finds phrase names that several documents share. A task settles what it sees itself and sends one row for each
name and block of documents, so no name gathers more rows than there are blocks. Step 2 verifies: only windows whose
phrase is shared are compared, by 96 bits of their 13 word names, again with one document for each window and block.
Step 3 removes the words covered.

Null text has no words, and an empty table gives an empty result; other columns are ignored, whatever their names. A
text is named whole, however long, by the task that reads it. A null doc_id is neither earlier nor later than any: its row keeps all words and counts for no
other. Rows that repeat a doc_id are not earlier than each other, and each loses what its own text holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, settle, slices, stage

WINDOW, PHRASE, REACH = 13, 6, 7
_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)


class Names(dict):
    """64-bit names of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        name = xxhash.xxh3_64_intdigest(word)
        if len(self) < 400_000:
            self[word] = name
        return name


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _sum(names: np.ndarray, at: np.ndarray, size: int, factor: int) -> np.ndarray:
    """A polynomial of the `size` names from each place on."""
    out = np.zeros(len(at), _U)
    for i in range(size):
        out = out * _U(factor) + names[at + i]
    return _mix(out)


def _text_hash(text: bytes) -> int:
    """Tells apart texts that share a doc_id, by 64 bits (as a signed long)."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


class Block:
    """Names, symbols and windows of some documents, one after the other."""

    def __init__(self, texts: list[list[bytes]], names: Names):
        size = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(size) - size
        self.names = np.fromiter(map(names.__getitem__, (w for t in texts for w in t)), _U, int(size.sum()))
        self.doc = np.repeat(np.arange(len(texts)), size)
        n = len(self.names)
        if n < WINDOW:
            self.windows = self.phrase = np.empty(0, np.int64)
            self.key = np.empty(0, _U)
            return
        right = (self.names >> _U(40) & _U(1)).astype(bool)
        begins = np.ones(n, bool)
        begins[1:] = ~(~right[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1]))
        self.key = np.full(n, _TOP, _U)
        at = np.flatnonzero(begins[: n - PHRASE + 1])
        self.key[at] = np.minimum(_sum(self.names, at, PHRASE, 0x9E3779B97F4A7C15), _TOP - _U(1))
        self.windows = np.flatnonzero(self.doc[: n - WINDOW + 1] == self.doc[WINDOW - 1 :])
        least, self.phrase = self.key[self.windows + 1], self.windows + 1
        for step in range(2, REACH + 1):
            other = self.key[self.windows + step]
            better = other < least
            least = np.where(better, other, least)
            self.phrase = np.where(better, self.windows + step, self.phrase)


def _blocks(batches, most_words: int):
    """Rows gathered until they have most_words words: (ids, texts, shared names or None)."""
    ids, texts, extra, n, seen = [], [], [], 0, set()
    for batch in slices(batches, 500):
        more = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for doc, text, shared in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), more):
            if doc is None or text is None:
                continue
            words = text.split()
            if len(words) < WINDOW:
                continue
            if (doc, own := _text_hash(text)) in seen:  # what is found for the first such row holds for all
                continue
            seen.add((doc, own))
            ids.append(doc)
            texts.append((words, own))
            extra.append(shared)
            n += len(words)
            if n >= most_words:
                yield ids, texts, extra
                ids, texts, extra, n, seen = [], [], [], 0, set()
    if ids:
        yield ids, texts, extra


def _shared_phrases(docs: DataFrame, most_words: int) -> DataFrame:
    """doc_id, name: phrases of the document that occur in another one too."""

    def emit(batches):
        known = Names()
        for ids, texts, _ in _blocks(batches, most_words):
            block, doc_ids = Block([t for t, _ in texts], known), np.array(ids, np.int64)
            at = np.unique(block.phrase)
            name, doc = block.key[at].view(np.int64), doc_ids[block.doc[at]]
            order = np.lexsort((doc, name))
            name, doc = name[order], doc[order]
            once = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])] if len(name) else np.empty(0, bool)
            name, doc = name[once], doc[once]
            head = np.r_[True, name[1:] != name[:-1]] if len(name) else np.empty(0, bool)
            group = np.cumsum(head) - 1
            settled = (np.bincount(group) > 1)[group] if len(name) else head
            # One row of each name goes to where the name meets; the rest of a settled group goes anywhere.
            where = np.where(head, name, _mix(doc.view(_U) + _U(1)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(name), pa.array(doc), pa.array(settled), pa.array(head)], ["place", "name", "doc_id", "settled", "head"])

    def meet(batches):
        held_name, held = None, None
        for batch in batches:
            name, doc, settled, head = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            out = settled.copy()
            met = np.flatnonzero(head)
            if len(met):
                own = name[met]
                again = np.r_[own[0] == held_name, own[1:] == own[:-1]]
                shared = again | np.r_[again[1:], False]
                out[met] |= shared
                if again[0] and held is not None:  # the row before, in the last batch, is shared after all
                    yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], ["doc_id", "name"])
                last = met[-1]
                held_name, held = name[last], None if out[last] else (int(doc[last]), int(name[last]))
            yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(name[out])], ["doc_id", "name"])

    rows = docs.mapInArrow(emit, "place long, name long, doc_id long, settled boolean, head boolean")
    met = rows.repartition("place").sortWithinPartitions("place", "name").select("name", "doc_id", "settled", "head")
    return met.mapInArrow(meet, "doc_id long, name long")


def _covered(docs: DataFrame, most_words: int) -> DataFrame:
    """doc_id, text_hash, start, more, n: from start on (and from each of more, if any) n windows of that text also start in
    an earlier document."""

    def emit(batches):
        known = Names()
        for ids, texts, shared in _blocks(batches, most_words):
            block, doc_ids, hashes = Block([t for t, _ in texts], known), np.array(ids, np.int64), np.array([h for _, h in texts], np.int64)
            mine = np.concatenate([np.array(s, np.int64).view(_U) ^ _mix(np.full(len(s), i, _U)) for i, s in enumerate(shared)])
            key = block.key[block.phrase] ^ _mix(block.doc[block.windows].astype(_U))
            at = block.windows[np.isin(key, mine)]
            h1, h2 = (_sum(block.names, at, WINDOW, f) for f in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
            doc = doc_ids[block.doc[at]]
            order = np.lexsort((doc, h2, h1))
            a, b, d, w = h1[order], h2[order], doc[order], at[order]  # 128 bits here, 96 between tasks
            head = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.empty(0, bool)
            later = d > d[head][np.cumsum(head) - 1] if len(a) else head
            gone = np.sort(w[later])
            cut = np.flatnonzero(np.r_[True, (np.diff(gone) != 1) | (np.diff(block.doc[gone]) != 0)]) if len(gone) else np.empty(0, np.int64)
            start, n = gone[cut], np.diff(np.r_[cut, len(gone)])
            # Settled stretches go anywhere, by their own hash; the earliest document of each window goes to meet others,
            # in one row however often it holds that window.
            w, a, b = w[~later], a[~later], b[~later]
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (np.diff(block.doc[w]) != 0)]) if len(w) else np.empty(0, np.int64)
            own = block.doc[np.concatenate([start, w[new]])]
            one = np.concatenate([_mix(start.astype(_U) + _mix(doc_ids[block.doc[start]].view(_U))), a[new]]).view(np.int64)
            two = np.concatenate([np.zeros(len(start), np.int32), (b[new] >> _U(32)).astype(np.uint32).view(np.int32)])
            inside = (w - block.first[block.doc[w]]).astype(np.int32)
            first = np.concatenate([start - block.first[block.doc[start]], inside[new]]).astype(np.int32)
            rest, counts = np.ones(len(w), bool), np.diff(np.r_[new, len(w)]) - 1
            rest[new] = False
            counts = np.concatenate([np.zeros(len(start), np.int64), counts])
            ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
            more = pa.ListArray.from_arrays(pa.array(ends), pa.array(inside[rest]), mask=pa.array(counts == 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(one), pa.array(two), pa.array(doc_ids[own]), pa.array(hashes[own]), pa.array(first), more, pa.array(np.concatenate([n, np.zeros(len(new), np.int64)]).astype(np.int32))],
                ["h1", "h2", "doc_id", "text_hash", "start", "more", "n"],
            )

    def meet(batches):
        held = (None, None, None)
        for batch in batches:
            h1, h2, doc, n = (batch.column(i).to_numpy() for i in (0, 1, 2, 6))
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            least = doc[new][np.cumsum(new) - 1]
            if (h1[0], h2[0]) == held[:2]:
                upto = np.flatnonzero(new)[1] if new.sum() > 1 else len(new)
                least[:upto] = held[2]
            out = pa.array((n > 0) | (doc > least))
            held = (h1[-1], h2[-1], least[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(out) for i in (2, 3, 4, 5)), pa.array(np.maximum(n, 1)).filter(out)], ["doc_id", "text_hash", "start", "more", "n"])

    rows = docs.mapInArrow(emit, "h1 long, h2 int, doc_id long, text_hash long, start int, more array<int>, n int")
    # Settled rows (n > 0) have h2 = 0 and would only meet a window of that very name; they sort last there.
    return rows.repartition("h1").sortWithinPartitions("h1", "h2", "n", "doc_id").mapInArrow(meet, "doc_id long, text_hash long, start int, more array<int>, n int")


def remove_repeats(docs: DataFrame, most_words: int = 1_000_000, with_text: bool = False) -> DataFrame:
    """Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and those words as
    `text` if with_text."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = stage(_shared_phrases(read, most_words), "phrases")
    settle(spark)
    names = shared.groupBy("doc_id").agg(F.collect_list("name").alias("names"))
    covered = stage(_covered(read.join(names, "doc_id").select("doc_id", "text", "names"), most_words), "covered")
    settle(spark)
    ranges = covered.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("text_hash").alias("hashes"), F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"), F.collect_list(F.when(F.col("more").isNotNull(), F.struct("text_hash", "more", "n"))).alias("rest"))
    joined = docs.select("doc_id", "text").join(ranges, F.col("doc_id").cast("long") == F.col("of"), "left").select("doc_id", "text", "hashes", "starts", "ns", "rest")

    def cut(batches):
        for batch in slices(batches, 500):
            n_words, n_removed, sha, kept = [], [], [], []
            for text, hashes, starts, ns, rest in zip(byte_texts(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                words = text.split() if text else []
                n_words.append(len(words))
                if starts:
                    own, gone = _text_hash(text), bytearray(len(words))
                    found = [(h, start, n) for h, start, n in zip(hashes, starts, ns)] + [(r["text_hash"], start, r["n"]) for r in rest for start in r["more"]]
                    for h, start, n in found:
                        if h == own:
                            gone[start : start + n + WINDOW - 1] = b"\x01" * (n + WINDOW - 1)
                    words = [w for w, g in zip(words, gone) if not g]
                n_removed.append(n_words[-1] - len(words))
                out = b" ".join(words)
                sha.append(hashlib.sha256(out).hexdigest())
                kept.append(out if with_text and text is not None else None)
            arrays, names = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return joined.mapInArrow(cut, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
