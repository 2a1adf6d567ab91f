"""Language-model scores by context-tree weighting over the bytes of words.

A text is its lower-cased words and one end. A word is coded byte by byte with a closing blank (the end is the empty
word), each byte as eight binary decisions. A decision's contexts are, from coarse to fine: nothing, the byte before,
the two bytes before (blanks stand before the word), and the whole word so far. At each context a Krichevsky-Trofimov
estimate counts the decisions of the training text; context-tree weighting mixes all depths, each node's weight being
its own block probability against that of all that lies below. A context without training data leaves the word to
the depths above it.

The tree is learnt from the vocabulary (distinct words with their counts, over all training documents). Tables of the
first three depths have at most 2^24 entries whatever the corpus, and are sent to every executor. For the deepest
contexts the vocabulary is cut into ranges of about `PART` words, however many begin alike, and a task handles one range
at a time, in sorted order. The words of one context follow each other, so a context is in one range only, or else it
is the beginning of a bound between ranges: such contexts' counts are summed over the ranges (a few for each range) and
go to every executor. The `common` most frequent words (a bound) go to every executor, so that no word is a hot key; the
other words of each document meet their scores in a shuffle.

Null text is empty. A null doc_id counts as the empty text for the split. Rows may repeat: each is counted and scored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, settle, slices, stage

#: Words of a range of the vocabulary, about.
PART = 40_000
#: Words looked at for each bound between ranges, and bytes of a bound.
LOOKS, BOUND_BYTES = 16, 1024
HALF = float(np.log(0.5))
_COEFFICIENTS = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def held_out(doc_id: object) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5, by Stirling's series after shifting small values up."""
    x = np.asarray(x, np.float64)
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        small = y < 8
        if not small.any():
            break
        shift -= np.where(small, np.log(y), 0.0)
        y = np.where(small, y + 1, y)
    inverse = 1 / y
    return shift + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + sum(c * inverse ** (2 * i + 1) for i, c in enumerate(_COEFFICIENTS))


def block_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - float(np.log(np.pi))


def vocabulary(docs: DataFrame, block: int = 4000) -> DataFrame:
    """word (binary, lower-cased; empty: the end), c (occurrences in training documents; 0: in others only)."""

    def count(batches):
        train, rest, n = Counter(), set(), 0

        def out():
            words = list(train) + [w for w in rest if w not in train]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([train.get(w, 0) for w in words], pa.int64())], ["word", "c"])

        for batch in slices(batches, 500):
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                words = text.lower().split() if text else []
                words.append(b"")
                (rest if held_out(doc) else train).update(words)
                n += 1
            if n >= block or len(train) + len(rest) > 600_000:
                yield out()
                train, rest, n = Counter(), set(), 0
        if n:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _same(a: bytes, b: bytes) -> int:
    """How many first bytes two words share."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Words:
    """A range of sorted words (from `low` on, below `high`; None: no bound) as flat arrays: for each byte to code its
    word, the two bytes before, and whether the word so far is other words' too, in this range or maybe in others."""

    def __init__(self, words: list[bytes], counts: np.ndarray, low: bytes | None = None, high: bytes | None = None):
        self.words, self.counts, n = words, counts, len(words)
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join([b"  " + w + b" " for w in words]), np.uint8).astype(np.int64)
        begin = np.cumsum(size + 3) - (size + 3)
        same = np.zeros(n + 1, np.int64)
        for i in range(1, n):
            same[i] = _same(words[i - 1], words[i])
        if low is not None:
            same[0] = _same(words[0], low)
        if high is not None:
            same[n] = _same(words[-1], high)
        self.shared = np.maximum(same[:-1], same[1:])  # the word so far of up to this many bytes is not its own
        self.word = np.repeat(np.arange(n), size + 1)
        self.at = np.arange(len(self.word)) - np.repeat(np.cumsum(size + 1) - (size + 1), size + 1)
        place = begin[self.word] + self.at + 2
        self.byte, self.context = flat[place], flat[place - 2] << 8 | flat[place - 1]
        self.same = same

    def levels(self):
        """For each length of the word so far (2 and more) that words share: places, their group, and the groups whose
        context begins a bound, so that other ranges may hold it too."""
        order = np.argsort(self.at, kind="stable")
        order = order[(self.at[order] >= 2) & (self.at[order] <= self.shared[self.word[order]])]
        cuts = np.flatnonzero(np.diff(self.at[order], prepend=-1))
        for places in np.split(order, cuts[1:]) if len(order) else []:
            at, word = self.at[places[0]], self.word[places]
            group = np.cumsum(np.r_[True, (np.diff(word) != 1) | (self.same[word[1:]] < at)]) - 1
            yield places, group, {int(group[i]): self.words[word[i]][:at] for i, edge in ((0, 0), (-1, len(self.words))) if self.same[edge] >= at}

    def alone(self) -> np.ndarray:
        return np.flatnonzero((self.at >= 2) & (self.at > self.shared[self.word]))


def _bits(byte: np.ndarray):
    """(node, bit) of each of the eight decisions."""
    for k in range(8):
        yield (1 << k) | byte >> (8 - k), byte >> (7 - k) & 1


def _bounds(vocab: DataFrame, words: int) -> list[bytes]:
    """Sorted words that cut the vocabulary into ranges of about PART words, from LOOKS words a range, picked by hash."""
    parts = -(-words // PART)
    if parts < 2:
        return []
    every = max(1, words // (parts * LOOKS))
    picked = vocab.filter(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select(F.substring("word", 1, BOUND_BYTES).alias("word"))
    looked = sorted(set(picked.toArrow().column("word").to_pylist()))
    return looked[LOOKS::LOOKS]


def _ranges(vocab: DataFrame, bounds) -> DataFrame:
    """The vocabulary with each word's range, sorted; the ranges are dealt out whole."""

    def number(batches):
        at = bounds.value
        for batch in batches:
            part = [bisect_right(at, word) for word in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *batch.columns], ["part", "word", "c"])

    return vocab.select("word", "c").mapInArrow(number, "part long, word binary, c long").repartition("part").sortWithinPartitions("part", "word")


def _read_ranges(batches, bounds: list[bytes]):
    """Each range's Words."""
    words, counts, now = [], [], None

    def made():
        return Words(words, np.array(counts, np.float64), bounds[now - 1] if now else None, bounds[now] if now < len(bounds) else None)

    for batch in batches:
        for part, word, c in zip(*(column.to_pylist() for column in batch.columns)):
            if part != now and words:
                yield made()
                words, counts = [], []
            now = part
            words.append(word)
            counts.append(c)
    if words:
        yield made()


def _evidence(ranges: DataFrame, bounds) -> DataFrame:
    """key (two bytes, node), n0, n1: counts at depth two; below: log block probability of all deeper contexts that lie
    in one range. For the others the rows have their context (the word so far) and its counts."""

    def measure(batches):
        for w in _read_ranges(batches, bounds.value):
            c = w.counts[w.word]
            contexts, place = np.unique(w.context, return_inverse=True)
            sums = np.zeros((3, len(contexts) << 8))

            def add(which, at, node, value):
                sums[which] += np.bincount(place[at] << 8 | node, np.broadcast_to(value, node.shape), sums.shape[1])

            every = np.arange(len(w.byte))
            for node, bit in _bits(w.byte):
                add(0, every, node, c * (1 - bit))
                add(1, every, node, c * bit)
            alone = w.alone()
            alone = alone[c[alone] > 0]
            own = block_log(c[alone], 0.0)
            for node, _ in _bits(w.byte[alone]):
                add(2, alone, node, own)
            deep, split = np.zeros(sums.shape[1]), []
            for places, group, edges in w.levels():
                first = places[np.r_[True, np.diff(group) > 0]]
                for node, bit in _bits(w.byte[places]):
                    node_of, which = np.unique(group << 8 | node, return_inverse=True)
                    n, n1 = np.bincount(which, c[places]), np.bincount(which, c[places] * bit)
                    for i in np.flatnonzero(np.isin(node_of >> 8, list(edges)) & (n > 0)):
                        g = int(node_of[i]) >> 8
                        split.append((edges[g], int(w.context[first[g]]) << 8 | int(node_of[i]) & 255, n[i] - n1[i], n1[i]))
                        n[i] = 0
                    seen = n > 0
                    np.add.at(deep, place[first[node_of[seen] >> 8]] << 8 | node_of[seen] & 255, block_log((n - n1)[seen], n1[seen]))
            sums[2] += deep
            at = np.flatnonzero(sums.any(axis=0))
            n_split = [0.0] * len(split)
            context, key, n0, n1 = zip(*split) if split else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None] * len(at) + list(context), pa.binary()),
                    pa.array([*(contexts[at >> 8] << 8 | at & 255).tolist(), *key], pa.int64()),
                    *(pa.array(np.r_[sums[i][at], more].astype(np.float64)) for i, more in enumerate((n0, n1, n_split))),
                ],
                ["context", "key", "n0", "n1", "below"],
            )

    found = ranges.mapInArrow(measure, "context binary, key long, n0 double, n1 double, below double")
    return found.groupBy("context", "key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below"))


class Split:
    """Counts of the contexts that several ranges may hold: for each context its nodes' zeros and ones."""

    def __init__(self, context: list[bytes], node: np.ndarray, n0: np.ndarray, n1: np.ndarray):
        order = sorted(range(len(context)), key=context.__getitem__)
        self.node, self.n0, self.n1 = node[order], n0[order], n1[order]
        self.place: dict[bytes, list[int]] = {}
        for i, at in enumerate(order):
            self.place.setdefault(context[at], [i, i])[1] = i + 1

    def counts(self, context: bytes) -> np.ndarray:
        out = np.zeros((2, 256))
        begin, end = self.place.get(context, (0, 0))
        out[0, self.node[begin:end]], out[1, self.node[begin:end]] = self.n0[begin:end], self.n1[begin:end]
        return out


def grow(table: pa.Table) -> Tree:
    """The tree, from what _evidence() gathers: at most 2^24 rows, and those of the contexts that ranges share."""
    key, n0, n1, below = (table.column(n).to_numpy() for n in ("key", "n0", "n1", "below"))
    context = table.column("context").to_pylist()
    shared = np.array([x is not None for x in context], bool)
    split = Split([x for x in context if x is not None], key[shared] & 255, n0[shared], n1[shared])
    order = np.argsort(key[~shared])
    key_of, n0_of, n1_of, below_of = key[~shared][order], n0[~shared][order], n1[~shared][order], below[~shared][order].copy()
    np.add.at(below_of, np.searchsorted(key_of, key[shared]), block_log(n0[shared], n1[shared]))
    return Tree(key_of, n0_of, n1_of, below_of, split)


class Tree:
    """The first three depths: for each (two bytes, node) the mixed chance of a one if nothing lies deeper (stop), and
    the part (upper) and weight (rest) to which a deeper context adds its estimate."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray, split: Split):
        self.split = split
        kt = lambda a, b: (b + 0.5) / (a + b + 1.0)
        seen = n0 + n1 > 0
        key, n0, n1, below = key[seen], n0[seen], n1[seen], below[seen]

        def up(key, n0, n1, inner):
            own, which = np.unique(key, return_inverse=True)
            return own, which, np.bincount(which, n0, len(own)), np.bincount(which, n1, len(own)), np.bincount(which, inner, len(own))

        def weigh(own, inner, leaf):
            gap = np.clip(own - inner, -700, 700)
            weight = np.where(leaf, 1.0, 1 / (1 + np.exp(-gap)))
            return weight, np.where(leaf, own, HALF + np.logaddexp(own, inner))

        weight2, whole2 = weigh(block_log(n0, n1), below, below == 0)
        key1, of1, a1, b1, inner1 = up(key & 0xFFFF, n0, n1, whole2)
        weight1, whole1 = weigh(block_log(a1, b1), inner1, False)
        key0, of0, a0, b0, inner0 = up(key1 & 0xFF, a1, b1, whole1)
        weight0, _ = weigh(block_log(a0, b0), inner0, False)

        stop0 = np.full(256, 0.5)
        stop0[key0] = kt(a0, b0)
        stop1 = np.repeat(stop0[None], 256, 0).ravel()
        stop1[key1] = weight0[of0] * kt(a0, b0)[of0] + (1 - weight0[of0]) * kt(a1, b1)
        part = weight0[of0] * kt(a0, b0)[of0] + (1 - weight0[of0]) * weight1 * kt(a1, b1)
        rest = (1 - weight0[of0]) * (1 - weight1)
        contexts = np.unique(key >> 8)
        self.row = (np.arange(65536) & 255).astype(np.int32)  # unseen: the row of the byte before
        self.row[contexts] = 256 + np.arange(len(contexts))
        shape = (256 + len(contexts), 256)
        stop, upper, left = np.empty(shape), np.zeros(shape), np.ones(shape)
        stop[:256] = stop1.reshape(256, 256)
        stop[256:] = stop[contexts & 255]
        at = self.row[key >> 8], key & 255
        stop[at] = part[of1] + rest[of1] * kt(n0, n1)
        upper[at] = part[of1] + rest[of1] * weight2 * kt(n0, n1)
        left[at] = rest[of1] * (1 - weight2)
        self.stop, self.upper, self.rest = (x.astype(np.float32).ravel() for x in (stop, upper, left))

    def log10(self, w: Words) -> np.ndarray:
        c, row = w.counts[w.word], self.row[w.context].astype(np.int64) << 8
        deep1, deep = np.zeros((8, len(w.byte)), np.float32), np.zeros((8, len(w.byte)), bool)
        alone = w.alone()
        alone = alone[c[alone] > 0]
        for k, (_, bit) in enumerate(_bits(w.byte[alone])):
            deep[k, alone] = True
            deep1[k, alone] = (c[alone] * bit + 0.5) / (c[alone] + 1.0)
        for places, group, edges in w.levels():
            whole = [(group == g, self.split.counts(context)) for g, context in edges.items()]
            for k, (node, bit) in enumerate(_bits(w.byte[places])):
                _, which = np.unique(group << 8 | node, return_inverse=True)
                n, n1 = np.bincount(which, c[places])[which], np.bincount(which, c[places] * bit)[which]
                for of, (zeros, ones) in whole:
                    n[of], n1[of] = (zeros + ones)[node[of]], ones[node[of]]
                deep[k, places] = n > 0
                deep1[k, places] = (n1 + 0.5) / (n + 1.0)
        total = np.zeros(len(w.byte))
        for k, (node, bit) in enumerate(_bits(w.byte)):
            at = row + node
            one = np.where(deep[k], self.upper[at] + self.rest[at] * deep1[k], self.stop[at]).astype(np.float64)
            total += np.log10(np.where(bit == 1, one, 1 - one))
        return np.bincount(w.word, total, len(w.words))


def score(docs: DataFrame, common: int = 200_000) -> DataFrame:
    """Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    vocab = stage(vocabulary(docs), "vocabulary")
    total = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count("*").alias("words")).first()
    bounds = spark.sparkContext.broadcast(_bounds(vocab, total["words"]))
    ranges = _ranges(vocab, bounds)
    tree = spark.sparkContext.broadcast(grow(_evidence(ranges, bounds).toArrow()))

    def weigh(batches):
        for w in _read_ranges(batches, bounds.value):
            yield pa.RecordBatch.from_arrays([pa.array(w.words, pa.binary()), pa.array(w.counts.astype(np.int64)), pa.array(tree.value.log10(w))], ["word", "c", "p"])

    scored = stage(ranges.mapInArrow(weigh, "word binary, c long, p double"), "scored")
    settle(spark)
    often = scored.orderBy(F.desc("c"), "word").limit(common).toArrow()
    known = spark.sparkContext.broadcast({w: (c, p) for w, c, p in zip(*(often.column(n).to_pylist() for n in ("word", "c", "p")))})
    floor = total["n"] + 0.1 * (total["v"] + 1)

    def read(batches):
        known_words, logs = known.value, {}
        row, kinds = TaskContext.get().partitionId() << 40, None
        for batch in slices(batches, 500):
            kinds = (pa.int64(), batch.column(0).type, pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
            out: list[list] = [[] for _ in kinds]
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                words = text.lower().split() if text else []
                words.append(b"")
                n_known, base, p, rare = 0, 0.0, 0.0, []
                for word, n in Counter(words).items():
                    if (found := known_words.get(word)) is None:
                        rare.append((word, n))
                        continue
                    c = found[0]
                    if c:
                        n_known += n
                    if c not in logs:
                        logs[c] = float(np.log10((c + 0.1) / floor))
                    base += n * logs[c]
                    p += n * found[1]
                # A blank never is in a word, so this key meets none and no two documents.
                for column, value in zip(out, (row, doc, b" %d" % row, 0, len(words), n_known, base, p, len(text or b""))):
                    column.append(value)
                for word, n in rare:
                    for column, value in zip(out, (row, None, word, n, 0, 0, 0.0, 0.0, 0)):
                        column.append(value)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["row", "doc_id", "word", "n", "n_tokens", "n_known", "base", "p", "bytes"])

    rows = docs.select("doc_id", "text").mapInArrow(read, f"row long, doc_id {id_type}, word binary, n long, n_tokens long, n_known long, base double, p double, bytes long")
    rare = scored.select(F.col("word").alias("of"), "c", F.col("p").alias("own"))
    joined = rows.join(rare, F.col("word") == F.col("of"), "left")
    zero: Column = F.lit(0)
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("n")).otherwise(zero)).alias("n_known"),
        F.sum(F.col("base") + F.col("n") * F.coalesce(F.log10((F.col("c") + F.lit(0.1)) / F.lit(floor)), F.lit(0.0))).alias("base_score"), F.sum(F.col("p") + F.col("n") * F.coalesce("own", F.lit(0.0))).alias("score"), F.sum("bytes").alias("bytes"),
    )
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return sums.select("doc_id", (crc % 10 == 0).alias("held_out"), "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") * float(np.log2(10)) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"))
