"""Language identification by hierarchical discrimination.

A text's features are the frequencies of its letters' byte pairs and triples, hashed to `width` numbers, over the
whole text. Languages with similar mean features form families (average-link merging of the learned labels). The
family is predicted first, by one linear machine for each family; within it, one-versus-one linear support vector
machines separate each pair of languages, and the language with most votes wins (ties: larger summed margin).

Training uses at most `per_label` rows of each label, those with the smallest hash of their id and text (the documented
bound; a row that repeats counts once); nothing but the text is an input of a prediction. Null text, or text without a
letter, is `und` with score 0; without any labelled document every text is `und`. Each row is predicted on its own, so
rows may repeat; a text is read whole, however long, in a fixed number of counts; an empty table gives an empty result;
extra columns are ignored. Ties of votes and margins go to the label that sorts last.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, stage

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: A-Z to a-z; a-z and non-ASCII bytes stay; all else is a blank.
_TABLE = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text mod 3 is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features(text: str, width: int) -> np.ndarray:
    """Root of the relative frequencies, so that their squares sum to 1 for pairs and for triples together."""
    b = _TABLE[np.frombuffer(b" " + text.encode("utf-8", "replace") + b" ", np.uint8)]
    b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]].astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    codes = np.concatenate([two, three + np.uint32(0x1000000)])
    codes = (codes * np.uint32(2654435761)) >> np.uint32(32 - width.bit_length() + 1)
    n = np.bincount(codes, minlength=width).astype(np.float32)
    return np.sqrt(n / max(1.0, n.sum()))


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Linear support vector machine (hinge loss) by dual coordinate descent; x has a constant column, y is +-1."""
    alpha, w, square, random = np.zeros(len(y)), np.zeros(x.shape[1]), np.einsum("ij,ij->i", x, x), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in random.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / square[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


def families(means: dict[str, np.ndarray], threshold: float) -> list[list[str]]:
    """Average-link merging of labels while the mean cosine of two groups is above the threshold, which is set
    between the least and the most similar pair."""
    groups = [[name] for name in sorted(means)]
    if len(groups) < 3:
        return [[n for g in groups for n in g]]
    unit = {n: v / np.linalg.norm(v) for n, v in means.items()}
    near = lambda a, b: float(np.mean([unit[x] @ unit[y] for x in a for y in b]))
    pairs = [near([a], [b]) for i, a in enumerate(sorted(means)) for b in sorted(means)[i + 1 :]]
    stop = min(pairs) + threshold * (max(pairs) - min(pairs))
    while len(groups) > 1:
        best, i, j = max((near(a, b), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best < stop:
            break
        groups[-i] += groups.pop(-j)
    return groups


@dataclass
class LanguageModel:
    """Family machines (one row of zeros for a single family), and pair machines within each family."""

    families: list[list[str]]
    tree: np.ndarray
    pairs: list[dict[tuple[str, str], np.ndarray]]

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        v = np.append(v, np.float32(1))
        margin = self.tree @ v
        at = int(np.argmax(margin))
        members, votes, least = self.families[at], {n: [0, 0.0] for n in self.families[at]}, np.inf
        for (a, b), w in self.pairs[at].items():
            m = float(w @ v)
            for n, s in ((a, m), (b, -m)):
                votes[n][0] += s > 0
                votes[n][1] += s
        best = max(members, key=lambda n: (*votes[n], n))
        for (a, b), w in self.pairs[at].items():
            if best in (a, b):
                least = min(least, float(w @ v) * (1 if best == a else -1))
        if len(self.families) > 1:
            least = min(least, float(margin[at]))
        return best, float(1 / (1 + np.exp(-2 * np.clip(least, -20, 20)))) if np.isfinite(least) else 1.0


def train(docs: DataFrame, per_label: int = 400, width: int = 4096, most_labels: int = 500, threshold: float = 0.6) -> LanguageModel | None:
    """Learn from text and non-null lang of the rows that are not held out: of each label the per_label distinct rows
    with the smallest hash of id and text, so that no label is lost, whatever ids or texts its rows share. More than
    most_labels labels are an error, as the driver holds the machines (one for each pair in a family)."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.lit(11), "doc_id", "text").alias("key"), "text")
    keys = stage(rows.select("lang", "key").distinct(), "language-keys")
    counts = keys.groupBy("lang").count()
    if (labels := counts.limit(most_labels + 1).count()) > most_labels:
        raise ValueError(f"over {most_labels} labels ({labels} seen) can not be learnt")
    # Of a frequent label only the smallest hashes are ranked, about four times the quota, so that no task ranks them all.
    share = F.lit(4.0 * per_label) / F.col("count")
    few = keys.join(F.broadcast(counts), "lang").filter((F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53))) < share)  # most_labels rows at most
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.shiftrightunsigned("key", 11), "key"))
    chosen = stage(few.withColumn("rank", rank).filter(F.col("rank") <= per_label).select("lang", "key"), "language-rows")
    taken = rows.join(chosen, ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))

    def vectors(batches):
        for batch in slices(batches, 200):
            rows = [features(t, width) if _LETTER.search(t) else np.zeros(width, np.float32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary())], ["lang", "v"])

    learnt = taken.select("lang", "text").mapInArrow(vectors, "lang string, v binary").filter(F.col("v") != F.lit(bytes(2 * width)))
    return _machines(stage(learnt, "language-vectors"), width, threshold)


def _sorted(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of rows (lang, v) in one order, however they arrive."""
    raw, labels = rows.column("v").to_pylist(), np.array(rows.column("lang").to_pylist())
    x = np.frombuffer(b"".join(raw), np.float16).reshape(-1, width).astype(np.float32)
    order = np.lexsort((np.unique(np.array(raw, object), return_inverse=True)[1], *x[:, :8].T, labels))
    return x[order], labels[order]


def _machines(rows: DataFrame, width: int, threshold: float) -> LanguageModel | None:
    """The model of rows (lang, v). Each label's mean and each machine is learnt by a task of its own, from the rows of its
    labels; the driver gets the means and the machines, and no row."""

    def mean(t: pa.Table) -> pa.Table:
        x, labels = _sorted(t, width)
        return pa.table({"lang": pa.array(labels[:1].tolist(), pa.string()), "mean": pa.array([x.mean(axis=0).tobytes()], pa.binary())})

    means = {r["lang"]: np.frombuffer(r["mean"], np.float32) for r in rows.groupBy("lang").applyInArrow(mean, "lang string, mean binary").collect()}  # a row for each label
    if not means:
        return None
    found = families(means, threshold)
    sides: list[tuple[int, str, bool]] = []  # machine, label, whether it is on the machine's positive side
    if len(found) > 1:
        sides += [(i, n, own is members) for i, own in enumerate(found) for members in found for n in members]
    pairs = [(k, a, b) for k, members in enumerate(found) for i, a in enumerate(members) for b in members[i + 1 :]]
    for i, (_, a, b) in enumerate(pairs):
        sides += [(len(found) + i, a, True), (len(found) + i, b, False)]

    def fit(t: pa.Table) -> pa.Table:
        x, labels = _sorted(t, width)
        above = set(t.filter(t.column("above")).column("lang").to_pylist())
        w = svm(np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64), np.where([n in above for n in labels], 1.0, -1.0))
        return pa.table({"machine": t.column("machine").slice(0, 1), "w": pa.array([w.tobytes()], pa.binary())})

    learnt: dict[int, np.ndarray] = {}
    if sides:
        dealt = rows.join(F.broadcast(rows.sparkSession.createDataFrame(sides, "machine int, lang string, above boolean")), "lang")
        made = dealt.select("machine", "lang", "above", "v").groupBy("machine").applyInArrow(fit, "machine int, w binary")
        learnt = {r["machine"]: np.frombuffer(r["w"], np.float32) for r in made.collect()}  # a row for each machine
    tree = np.stack([learnt[i] for i in range(len(found))]) if len(found) > 1 else np.zeros((1, width + 1), np.float32)
    own = [{(a, b): learnt[len(found) + i] for i, (k, a, b) in enumerate(pairs) if k == at} for at in range(len(found))]
    return LanguageModel(found, tree, own)


def identify(docs: DataFrame, model: LanguageModel | None, width: int = 4096, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds held_out, lang_pred and score to the columns named by keep."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(*keep, held_out(F.col("doc_id")).alias("held_out"))
    extra = [] if "text" in keep else ["text"]  # read, but not handed on
    chosen = out if "text" in keep else docs.select(*keep, held_out(F.col("doc_id")).alias("held_out"), "text")
    place = chosen.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)

    def predict(batches):
        own = held.value
        for batch in slices(batches):
            found = [own.predict(features(t, width)) if own is not None and t and _LETTER.search(t) else (UNKNOWN, 0.0) for t in batch.column(place).to_pylist()]
            n = batch.num_columns - len(extra)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*batch.schema.names[:n], "lang_pred", "score"])

    return chosen.mapInArrow(predict, f"{schema}, lang_pred string, score double")
