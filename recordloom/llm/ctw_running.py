"""Language-model scores by context-tree weighting over the bytes of the running text.

A text is its lower-cased words, each with a closing blank, and one more blank, which is the end. Each byte is coded as
eight binary decisions. A decision's contexts are all suffixes, of 0 to `DEPTH` bytes, of what stands before its byte,
through blanks into the words before (before a text stand blanks). At each context a Krichevsky-Trofimov estimate
counts the decisions of the training texts; context-tree weighting mixes all depths, each node's weight being its own
block probability against that of all that lies below. A context without training data leaves the decision to the
depths above it.

A byte and its longest context are one whole number (a gram): the latest byte of the context is the highest, so that a
shorter context is a prefix, and the coded byte is the lowest. Grams are counted in arrays in each task and then by
Spark. For all depths from three on they are dealt out by their last three bytes, where a context lies with all that is
below it. Tables of the first three depths have at most 2^24 entries whatever the corpus, and are sent to every
executor, as are the `often` most frequent grams (a bound) with their scores; the other grams of each document meet
their scores in a shuffle, together with the words that the base score needs.

Null text is empty. A null doc_id counts as the empty text for the split. Rows may repeat: each is counted and scored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, settle, slices, stage
from .ctw import HALF, Tree, _bits, block_log, held_out, vocabulary

#: Bytes of the longest context; a gram of them and the coded byte fits in a positive long.
DEPTH = 6
#: Bytes of running text whose grams are counted at once and looked up at once, counts that a task holds before it adds
#: them up, grams of a task that weighs.
BLOCK, LOOK, HELD, PART = 4_000_000, 300_000, 4_000_000, 150_000
_PAD = b" " * 7


def running(text: bytes | None) -> bytes:
    words = text.lower().split() if text else []
    return b" ".join(words) + b"  " if words else b" "


def grams(texts: list[bytes]) -> np.ndarray:
    """Each running text's grams, one after another."""
    flat = np.frombuffer(b"".join([x for t in texts for x in (_PAD, t)]), np.uint8)
    # Eight bytes from each place on, the last one highest.
    eight = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))
    wanted = np.ones(len(flat) - 7, bool)
    ends = np.cumsum([len(t) + 7 for t in texts])[:-1] - 7
    wanted[(ends[:, None] + np.arange(7)).ravel()] = False
    eight = eight[wanted]
    return ((eight << np.uint64(8) >> np.uint64(8 * (8 - DEPTH)) << np.uint64(8)) | eight >> np.uint64(56)).astype(np.int64)


def _blocks(texts):
    """The texts in lists of about LOOK bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 7
        if size >= LOOK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = np.sort(found)
    first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    return found[first], np.diff(np.r_[first, len(found)])


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    gram, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(gram, kind="stable")
    gram, n = gram[order], n[order]
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    return gram[first], np.add.reduceat(n, first)


def _summed(parts):
    """Arrow batches of the counts in parts (arrays of grams and their counts), one row a gram as far as HELD goes."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= 2 * HELD:
            held = [_merged(held)]
            size = len(held[0][0])
            if size >= HELD:
                yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["gram", "c"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([*map(pa.array, _merged(held))], ["gram", "c"])


def _recent() -> Column:
    """The three bytes before the coded one, by which grams are dealt out."""
    return F.shiftright("gram", 8 * (DEPTH - 2))


def counts(docs: DataFrame) -> DataFrame:
    """gram, c (occurrences in training documents; 0: in others only); a gram may have several rows."""

    def found(batches):
        sides, sizes = ([], []), [0, 0]
        for batch in slices(batches, 500):
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                which = held_out(doc)
                sides[which].append(running(text))
                sizes[which] += len(sides[which][-1])
                if sizes[which] >= BLOCK:
                    yield which, grams(sides[which])
                    sides[which].clear()
                    sizes[which] = 0
        yield from ((which, grams(sides[which])) for which in (0, 1) if sides[which])

    def count(batches):
        yield from _summed((gram, n * (1 - which)) for which, own in found(batches) for gram, n in [_counted(own)])

    def add(batches):
        # What HELD keeps apart here is added up where grams are weighed.
        yield from _summed((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows)

    own = docs.select("doc_id", "text").mapInArrow(count, "gram long, c long")
    return own.repartition("gram").mapInArrow(add, "gram long, c long")


class Grams:
    """A task's grams at all depths from DEPTH up to three: sorted (context, byte), counts, and the place of each in the
    next shorter depth. Sorted like this, the decisions of one context lie next to each other."""

    def __init__(self, gram: np.ndarray, c: np.ndarray):
        gram, c = _merged([(gram, c)])
        self.gram, self.c = gram, c.astype(np.float64)
        self.keys, self.n, self.up = {DEPTH: self.gram}, {DEPTH: self.c}, {}
        for d in range(DEPTH, 3, -1):
            key = self.keys[d] >> 16 << 8 | self.keys[d] & 255
            self.keys[d - 1], self.up[d] = np.unique(key, return_inverse=True)
            self.n[d - 1] = np.bincount(self.up[d], self.n[d], len(self.keys[d - 1]))
        self.place = np.arange(len(self.gram))
        for d in range(DEPTH, 3, -1):
            self.place = self.up[d][self.place]
        recent = self.keys[3] >> 16  # the two latest bytes, the latest one higher
        self.context = (recent & 255) << 8 | recent >> 8

    def decisions(self):
        """For each of the eight decisions: node and bit at depth three, log block probability of each of its rows'
        groups there (first rows only, else 0), chance of a one from depth three on, and whether that was trained."""
        for k in range(8):
            groups, first, ones, all_, weight, whole = {}, {}, {}, {}, {}, None
            for d in range(DEPTH, 2, -1):
                key = self.keys[d] >> (8 - k)  # of equal length, so the context and the byte's first bits
                start = np.r_[True, key[1:] != key[:-1]]
                groups[d], first[d] = np.cumsum(start) - 1, np.flatnonzero(start)
                size = len(first[d])
                bit = self.keys[d] >> (7 - k) & 1
                all_[d] = np.bincount(groups[d], self.n[d], size)
                ones[d] = np.bincount(groups[d], self.n[d] * bit, size)
                own = block_log(all_[d] - ones[d], ones[d])
                if d < DEPTH:
                    inner = np.bincount(groups[d][self.up[d + 1][first[d + 1]]], whole, size)
                    weight[d] = 1 / (1 + np.exp(-np.clip(own - inner, -700, 700)))
                    own = HALF + np.logaddexp(own, inner)
                whole = own
            p, trained = None, None
            for d in range(DEPTH, 2, -1):
                kt = (ones[d] + 0.5) / (all_[d] + 1)
                at = groups[d][self._at(d)]
                if p is None:
                    p = kt[at]
                else:
                    w = weight[d][at]
                    p = np.where(trained, w * kt[at] + (1 - w) * p, kt[at])
                trained = all_[d][at] > 0
            first_rows = np.zeros(len(self.keys[3]))
            first_rows[first[3]] = whole
            yield first_rows, p, trained

    def _at(self, d: int) -> np.ndarray:
        at = np.arange(len(self.gram))
        for e in range(DEPTH, d, -1):
            at = self.up[e][at]
        return at

    def evidence(self) -> pa.RecordBatch:
        """key (two bytes, node), n0, n1: counts at depth two; below: log block probability of what lies deeper."""
        contexts, place = np.unique(self.context, return_inverse=True)
        sums, c, byte = np.zeros((3, len(contexts) << 8)), self.n[3], self.keys[3] & 255
        for (node, bit), (whole, _, _) in zip(_bits(byte), self.decisions()):
            at = place << 8 | node
            for which, value in ((0, c * (1 - bit)), (1, c * bit), (2, whole)):
                sums[which] += np.bincount(at, value, sums.shape[1])
        at = np.flatnonzero(sums[:2].any(axis=0))
        return pa.RecordBatch.from_arrays([pa.array(contexts[at >> 8] << 8 | at & 255), *(pa.array(s[at]) for s in sums)], ["key", "n0", "n1", "below"])

    def log10(self, tree: Tree) -> np.ndarray:
        row, total = (tree.row[self.context].astype(np.int64) << 8)[self.place], np.zeros(len(self.gram))
        for (node, bit), (_, p, trained) in zip(_bits(self.gram & 255), self.decisions()):
            at = row + node
            one = np.where(trained, tree.upper[at] + tree.rest[at] * p, tree.stop[at]).astype(np.float64)
            total += np.log10(np.where(bit == 1, one, 1 - one))
        return total


def _whole(batches) -> Grams | None:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    return Grams(*(np.concatenate(x) for x in zip(*held))) if held else None


def _name(gram: np.ndarray) -> pa.Array:
    """Blank and the gram's seven bytes: no word has a blank."""
    data = np.ascontiguousarray(gram.astype(">u8")).view(np.uint8).reshape(-1, 8).copy()
    data[:, 0] = 32
    return pa.Array.from_buffers(pa.binary(), len(gram), [None, pa.py_buffer((np.arange(len(gram) + 1) * 8).astype(np.int32)), pa.py_buffer(data)])


def score(docs: DataFrame, common: int = 200_000, often: int = 2_000_000) -> DataFrame:
    """Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    vocab = stage(vocabulary(docs), "vocabulary")
    total = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    found = stage(counts(docs), "grams")
    dealt = found.repartition(max(1, -(-found.count() // PART)), _recent())

    def measure(batches):
        if whole := _whole(batches):
            yield whole.evidence()

    evidence = dealt.mapInArrow(measure, "key long, n0 double, n1 double, below double").groupBy("key").agg(*(F.sum(n).alias(n) for n in ("n0", "n1", "below"))).orderBy("key").toArrow()
    tree = spark.sparkContext.broadcast(Tree(*(evidence.column(n).to_numpy() for n in ("key", "n0", "n1", "below")), None))

    def weigh(batches):
        if whole := _whole(batches):
            yield pa.RecordBatch.from_arrays([pa.array(whole.gram), _name(whole.gram), pa.array(whole.c.astype(np.int64)), pa.array(whole.log10(tree.value))], ["gram", "word", "c", "p"])

    weighed = stage(dealt.mapInArrow(weigh, "gram long, word binary, c long, p double"), "weighed")
    settle(spark)
    # The least class of counts from which on there are at most `often` grams.
    size = F.floor(F.log2("c") * 8).cast("int")
    least, n = 1 << 30, 0
    for held in weighed.filter("c > 0").groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        if (n := n + held["count"]) > often:
            break
        least = held["size"]
    frequent = weighed.filter((F.col("c") > 0) & (size >= least)).select("gram", "p").toArrow()
    order = np.argsort(gram := frequent.column("gram").to_numpy())
    scores = spark.sparkContext.broadcast((np.r_[gram[order], np.iinfo(np.int64).max], np.r_[frequent.column("p").to_numpy()[order], 0.0]))
    words = vocab.orderBy(F.desc("c"), "word").limit(common).toArrow()
    known = spark.sparkContext.broadcast(dict(zip(*(words.column(n).to_pylist() for n in ("word", "c")))))
    floor = total["n"] + 0.1 * (total["v"] + 1)
    names = ["row", "doc_id", "word", "n", "n_tokens", "n_known", "base", "p", "bytes"]

    def read(batches):
        known_words, logs, (gram_of, p_of) = known.value, {}, scores.value
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 500):
            kinds = (pa.int64(), batch.column(0).type, pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
            ids, texts = batch.column(0).to_pylist(), byte_texts(batch.column(1))
            at = 0
            for block in _blocks(map(running, texts)):
                gram = grams(block)
                size = np.array([len(t) for t in block])
                own, which = np.unique(gram, return_inverse=True)
                place = np.searchsorted(gram_of, own)
                held = gram_of[place] == own
                p = np.add.reduceat(np.where(held, p_of[place], 0.0)[which], np.cumsum(size) - size)
                far = np.flatnonzero(~held[which])
                pair, times = np.unique(np.repeat(np.arange(len(block)), size)[far] * len(own) + which[far], return_counts=True)
                zeros = np.zeros(len(pair), np.int64)
                if len(pair):
                    yield pa.RecordBatch.from_arrays([pa.array(row + pair // len(own)), pa.nulls(len(pair), kinds[1]), _name(own[pair % len(own)]), pa.array(times), pa.array(zeros), pa.array(zeros), pa.array(zeros * 0.0), pa.array(zeros * 0.0), pa.array(zeros)], names)
                out: list[list] = [[] for _ in kinds]
                for i in range(len(block)):
                    n_known, base, rare, n_tokens = 0, 0.0, [], 0
                    tokens = block[i].split()
                    tokens.append(b"")
                    for word, n in Counter(tokens).items():
                        if (c := known_words.get(word)) is None:
                            rare.append((word, n))
                            continue
                        if c:
                            n_known += n
                        if c not in logs:
                            logs[c] = float(np.log10((c + 0.1) / floor))
                        base += n * logs[c]
                    # Longer than a gram's name, and no word, so this key meets none and no two documents.
                    for column, value in zip(out, (row, ids[at], b" %020d" % row, 0, len(tokens), n_known, base, float(p[i]), len(texts[at] or b""))):
                        column.append(value)
                    for word, n in rare:
                        for column, value in zip(out, (row, None, word, n, 0, 0, 0.0, 0.0, 0)):
                            column.append(value)
                    row, at = row + 1, at + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    rows = docs.select("doc_id", "text").mapInArrow(read, f"row long, doc_id {id_type}, word binary, n long, n_tokens long, n_known long, base double, p double, bytes long")
    rare = vocab.select(F.col("word").alias("of"), "c", F.lit(0.0).alias("own")).unionAll(weighed.filter(F.coalesce((F.col("c") == 0) | (size < least), F.lit(True))).select("word", F.lit(None).cast("long"), "p"))
    joined = rows.join(rare, F.col("word") == F.col("of"), "left")
    zero: Column = F.lit(0)
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("n")).otherwise(zero)).alias("n_known"),
        F.sum(F.col("base") + F.col("n") * F.coalesce(F.log10((F.col("c") + F.lit(0.1)) / F.lit(floor)), F.lit(0.0))).alias("base_score"), F.sum(F.col("p") + F.col("n") * F.coalesce("own", F.lit(0.0))).alias("score"), F.sum("bytes").alias("bytes"),
    )
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return sums.select("doc_id", (crc % 10 == 0).alias("held_out"), "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") * float(np.log2(10)) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"))
