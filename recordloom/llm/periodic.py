"""Periodic runs of words, by an all-lag scan of each document's word ids.

A run of period q is a longest stretch of words in which words q apart are the same, with q its smallest period and a
length of at least `least` words and `times` periods. Every lag q up to n/times is compared with the shifted ids and the
true stretches are measured. A stretch of such a length covers two multiples of q next to each other, so a lag is
first compared at the multiples of q alone, all lags in one vectorised step, and wholly only where those agree: the
runs found are the same.

A document of up to `long_chars` characters is scanned where it is read. A longer one's word ids go to several tasks, each with a
range of lags; a stretch's smallest period is found from the stretch itself, so ranges need nothing of each other, and
a stretch that several ranges find is one row after distinct. Its runs then meet its text by row. No task holds more
than one long document's ids at a time, and a range costs time by its lags.

Null text has no words. A null doc_id is kept as it is, rows that repeat or share a doc_id are judged each on its own,
an empty table gives no rows, other columns are not read, whatever their names. Words are compared by their bytes,
however long.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, slices, stage

#: Longest document whose first looks come from a table that all documents share.
TABLE = 1 << 15
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_SQL = "struct<start: bigint, length: bigint, period: bigint>"


@lru_cache(maxsize=16)
def _table(limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, lag, place two lags on) of all first looks in documents of up to limit words, by the last place."""
    lags = [np.arange(0, limit - 2 * q, q, dtype=np.int32) for q in range(1, limit // 2)]
    q = np.repeat(np.arange(1, limit // 2, dtype=np.int32), [len(x) for x in lags])
    at = np.concatenate(lags)
    last = at + 2 * q
    order = np.argsort(last, kind="stable")
    return at[order], q[order], last[order]


def _looks(ids: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place), by lag, where words lag apart agree at place, lag further, and half and a third of a lag on."""
    n = len(ids)
    if low == 1 and n <= TABLE:
        at, q, last = _table(1 << max(8, (n - 1).bit_length()))
        seen = np.searchsorted(last, n)
        at, q = at[:seen], q[:seen]
        hit = np.flatnonzero((ids[at] == ids[at + q]) & (q <= high))
        at, q = at[hit], q[hit]
    else:
        found = []
        for lag in range(low, high + 1):
            own = ids[::lag]
            same = own[1:] == own[:-1]
            hit = np.flatnonzero(same[1:] & same[:-1])
            if len(hit):
                found.append((np.full(len(hit), lag), hit * lag))
        q, at = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for part in (1, 2, 3):
        on = at + q // part
        ok = ids[on] == ids[on + q]
        at, q = at[ok], q[ok]
    order = np.lexsort((at, q))
    return q[order], at[order]


def _smallest(ids: np.ndarray, start: int, period: int) -> int:
    """The smallest period of a stretch that has this one three times: it divides it, so each prime factor is tried."""
    left, factor, p = period, 2, period
    while left > 1:
        if factor * factor > left:
            factor = left
        while left % factor == 0:
            left //= factor
            less = p // factor
            if np.array_equal(ids[start : start + period], ids[start + less : start + less + period]):
                p = less
        factor += 1
    return p


def find_runs(ids: np.ndarray, least: int = 24, times: int = 3, low: int = 1, high: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the runs that lags from low to high show, by start, then period."""
    n = len(ids)
    high = min(n // times, high or n)
    if n < least or high < low:
        return []
    lags, places = _looks(ids, low, high)
    cuts = np.flatnonzero(np.diff(lags)) + 1
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # starts and ends of the runs of a period
    found: set[tuple[int, int, int]] = set()
    for a, b in zip([0, *cuts], [*cuts, len(lags)]):
        if a == b:
            continue
        q, own = int(lags[a]), places[a:b]
        for p, (starts, ends) in known.items():
            if q % p == 0 and len(own):  # inside a run of a divisor, q shows that run again
                k = np.searchsorted(starts, own, "right") - 1
                own = own[(k < 0) | (ends[k] <= own + 2 * q)]
        if not len(own):
            continue
        differ = np.flatnonzero(ids[:-q] != ids[q:])
        ends = np.append(differ, n - q)
        starts = np.insert(differ + 1, 0, 0)
        for k in np.flatnonzero(ends - starts >= max(least - q, (times - 1) * q)):
            start = int(starts[k])
            run = (start, int(ends[k]) - start + q, _smallest(ids, start, q))
            if run not in found:
                found.add(run)
                of = known.get(run[2], (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                i = np.searchsorted(of[0], start)
                known[run[2]] = np.insert(of[0], i, start), np.insert(of[1], i, start + run[1])
    return sorted(found, key=lambda r: (r[0], r[2]))


def word_ids(words: list[bytes]) -> np.ndarray:
    names = dict.fromkeys(words)
    return np.fromiter(map(dict(zip(names, range(len(names)))).__getitem__, words), np.int32, len(words))


def _result(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple[bytes, int, tuple[int, int, int] | None]:
    """The words that stay, joined; how many go; and the run of the greatest exponent."""
    if not runs:
        return b" ".join(words), 0, None
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    steps = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    stay = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
    return b" ".join([words[i] for i in stay.tolist()]), len(words) - len(stay), best


def _rows(kept: pa.RecordBatch, results: list) -> pa.RecordBatch:
    as_run = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))
    columns = [
        pa.array([len(words) for words, _, _ in results], pa.int64()), pa.array([dropped for _, _, (_, dropped, _) in results], pa.int64()),
        pa.array([[as_run(r) for r in runs] for _, runs, _ in results], pa.list_(RUN)), pa.array([as_run(best) for _, _, (_, _, best) in results], RUN),
        pa.array([text for _, _, (text, _, _) in results], pa.binary()).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays([kept.column(0), *columns], ["doc_id", "n_words", "n_dropped", "runs", "best", "text"])


def collapse_runs(docs: DataFrame, text: Column | None = None, least: int = 24, times: int = 3, long_chars: int = 400_000) -> DataFrame:
    """doc_id, n_words, n_dropped, runs (array of start, length, period by start, then period), best (the run of the
    greatest length/period; ties: smallest start, then period) and text: the words but those that a run holds after its
    first period, joined by one blank. text: what is read in place of docs.text."""
    if times < 3:
        raise ValueError("runs of less than three periods are not looked for")
    rows = docs.select("doc_id", (F.col("text") if text is None else text).alias("text"))
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_dropped long, runs array<{RUN_SQL}>, best {RUN_SQL}, text string"

    def whole(batches):
        for batch in slices(batches, 500):
            results = []
            for own in byte_texts(batch.column(1)):
                words = (own or b"").split()
                runs = find_runs(word_ids(words), least, times)
                results.append((words, runs, _result(words, runs)))
            yield _rows(batch, results)

    here = rows.filter(F.col("text").isNull() | (F.length("text") <= long_chars)).mapInArrow(whole, out)
    far = rows.filter(F.length("text") > long_chars)
    return here.unionByName(_by_ranges(far, out, least, times, long_chars))


def _by_ranges(rows: DataFrame, out: str, least: int, times: int, long_chars: int) -> DataFrame:
    """The same for long documents, a task for each document and range of lags. Ranges grow in number with the square
    root of the length beyond long_chars, so that copies of the ids stay in proportion."""
    if rows.isEmpty():
        return rows.limit(0).mapInArrow(lambda batches: iter(()), out)
    held = stage(rows.withColumn("row", F.monotonically_increasing_id()), "long-texts")

    def ids(batches):
        for batch in slices(batches, 1):
            own = word_ids(byte_texts(batch.column(1))[0].split())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(own)], pa.int64()), pa.array([own.astype("<i4").tobytes()], pa.large_binary())], ["row", "n", "ids"])

    parts = F.ceil(F.sqrt(F.col("n") / (long_chars // 16 + 1))).cast("int") + 1
    numbered = stage(held.select("row", "text").mapInArrow(ids, "row long, n long, ids binary").withColumn("parts", parts), "word-ids")
    dealt = numbered.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.repartition(F.xxhash64("row", "part"))

    def scan(batches):
        for batch in slices(batches, 1):
            row, n, own, parts, part = (c[0].as_py() for c in batch.columns)
            lags = n // times
            runs = find_runs(np.frombuffer(own, "<i4"), least, times, part * lags // parts + 1, (part + 1) * lags // parts) if (part + 1) * lags // parts else []
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(runs), pa.int64()), *(pa.array([r[i] for r in runs], pa.int64()) for i in range(3))], ["row", "start", "length", "period"])

    found = dealt.select("row", "n", "ids", "parts", "part").mapInArrow(scan, "row long, start long, length long, period long").distinct()
    runs = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    met = held.join(runs, "row", "left").select("doc_id", "text", "runs")

    def finish(batches):
        for batch in slices(batches, 1):
            words = byte_texts(batch.column(1))[0].split()
            runs = [(r["start"], r["length"], r["period"]) for r in batch.column(2)[0].as_py() or []]
            yield _rows(batch, [(words, runs, _result(words, runs))])

    return met.mapInArrow(finish, out)


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which every tenth document (by the CRC-32 of its decimal id) repeats itself from some word on: word
    i >= a is word a + (i-a) % p, where g is that CRC over ten, a = g % n and p = 1 + (n-a) / (3 + g % 8)."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def edit(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (g % 8 + 3)).cast("long") + 1
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))), " ")

    words = F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    edited = F.get(F.transform(words, lambda w: F.when(F.size(w) > 0, edit(w)).otherwise("")), 0)
    return F.when((h % 10 == 0) & text.isNotNull(), edited).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from collapse_runs()."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"), "n_words", "n_dropped",
    )


#: CRC-32 of a decimal number, in SQL.
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
ORACLE = rf"""
WITH t AS (SELECT doc_id, {CRC.format("CAST(doc_id AS VARCHAR)")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT *, (h // 10) % len(w) AS a, (h // 10) % 8 AS m FROM t),
     d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % (1 + (len(w) - a) // (3 + m)) ELSE i END + 1]) ELSE w END AS w FROM s),
     u AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
     e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM u x JOIN u y USING (doc_id, word) WHERE y.i > x.i AND 3 * (y.i - x.i) <= x.n),
     g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
     r AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
     v AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r p WHERE p.doc_id = r.doc_id AND p.q < r.q AND r.q % p.q = 0 AND p.start <= r.start AND p.start + p.length >= r.start + r.length)),
     b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / q DESC, start, q) AS place FROM v),
     l AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM v GROUP BY doc_id),
     x AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM v),
     k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.q AS period, 1000 * b.length // b.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256,
       CAST(len(w) AS BIGINT) AS n_words, (SELECT count(*) FROM x WHERE x.doc_id = d.doc_id) AS n_dropped
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN (SELECT * FROM b WHERE place = 1) b USING (doc_id) LEFT JOIN k USING (doc_id)
"""
