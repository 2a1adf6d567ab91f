"""Best-fit packing of tokenised documents, bulk-synchronous.

Documents longer than half a sequence open one each. The others come in bands of lengths, each band's from half the
length of the band before it. A band's documents are ranged by length, from long to short, a frequent length over
several ranges. A superstep sweeps the ranges for their successors: each range takes the smallest gaps that hold its
documents, as many as these can use, and a gap that several could take is settled by rank; gaps that nobody can use stay out. The ranges then fill their gaps at once, one task a
range: each document goes to the smallest gap that holds it, and the gap is updated. What found no gap stays for the
next superstep; a range for which no gap is left opens sequences.

The driver sees counts for each length and gap (at most `capacity` each) and plans over those, whatever the number of
documents or ranges; the places do not depend on the number of tasks. Every superstep is
written to the shared folder, so a lost executor repeats its part of one superstep.

Null text is an empty document (its end id only). Rows that repeat, share a doc_id or have none are packed each on
its own. No documents: no rows. Other columns are not read. A very long text is cut into pieces by its own task.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import islice
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stage

END_ID = 1
#: Slots over which the rows of one length or gap are ranked.
SLOTS = 1 << 30
#: Sequences that a range's documents fill at least: each range may leave one that is not full.
FULL = 8


#: Chunks of these letters, digits and signs alone are cut as the tokenizer cuts them: they have no composing marks,
#: and their lower case is letter by letter.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

#: Signs that end a chunk of letters as one pre-token; those of special tokens are not among them.
_SIGNS = "!\"#$%&'()*+,-./:;=?@[]^_`{}~"


class ChunkTokenizer:
    """Ids of a text by a tokenizer whose pre-tokens never cross white space. Ids are kept for chunks between blanks
    and, below them, for pre-tokens, up to a bound."""

    def __init__(self, path: str, room: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        self.chunks: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}

    def _parts(self, todo: list[str]) -> list[bytes]:
        """Ids of pre-tokens, encoded together: each is one word of the joined text."""
        e = self.tokenizer.encode(" ".join(todo), add_special_tokens=False)
        words = np.array(e.word_ids, np.int64)
        ends = np.searchsorted(words, np.arange(len(todo)), "right")
        if len(words) and words[-1] != len(todo) - 1:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(todo, add_special_tokens=False)]
        ids, ends = np.array(e.ids, "<u4").tobytes(), (4 * ends).tolist()
        return [ids[i:j] for i, j in zip([0, *ends], ends)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        parts, cut, words, whole, todo = self.parts, {}, {}, [], {}
        for c in new:
            if c.isascii() and c.isalpha():
                words[c] = p = c.lower()
                if p not in parts:
                    todo[p] = b""
                continue
            word = c.rstrip(_SIGNS)
            if word.isalpha() and (word.isascii() or _PLAIN.fullmatch(word)):
                cut[c] = own = [word.lower(), c[len(word) :]] if len(word) < len(c) else [word.lower()]
                for p in own:
                    if p not in parts:
                        todo[p] = b""
                continue
            # A special token's string is taken from the text as it stands, so such a chunk stays whole.
            if _PLAIN.fullmatch(c) and "<|" not in c:
                cut[c] = own = _CUT.findall(c.lower())
                for p in own:
                    if p not in parts:
                        todo[p] = b""
            else:
                whole.append(c)
        out = {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False))} if whole else {}
        if todo:
            todo = dict(zip(todo, self._parts(list(todo))))
            if len(parts) < self.room:
                parts.update(todo)
        for c, p in words.items():
            out[c] = todo[p] if p in todo else parts[p]
        for c, own in cut.items():
            out[c] = b"".join([todo[p] if p in todo else parts[p] for p in own])
        return out

    def encode(self, texts: list) -> list[bytes]:
        """For each text its ids as little-endian 32-bit words."""
        cut = [(t or "").replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        known, new = self.chunks, set()
        found = [list(map(known.get, chunks)) for chunks in cut]
        gaps = [[i for i, ids in enumerate(own) if ids is None] if None in own else () for own in found]
        for chunks, missing in zip(cut, gaps):
            new.update([chunks[i] for i in missing])
        if new:
            learnt = self._learn(list(new))
            for own, chunks, missing in zip(found, cut, gaps):
                for i in missing:
                    own[i] = learnt[chunks[i]]
            known.update(islice(learnt.items(), max(0, self.room - len(known))))
        return [b"".join(own) for own in found]


@lru_cache(maxsize=1)
def _tokenizer(path: str, job: str) -> ChunkTokenizer:
    """One for each Python worker and job: the job's tasks that follow each other in a worker share what is learnt,
    another job starts anew."""
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and END_ID, cut only where longer than capacity."""
    id_type, job = docs.schema["doc_id"].dataType.simpleString(), uuid.uuid4().hex

    def cut(batches):
        tokenizer = _tokenizer(tokenizer_path, job)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches, 500):
            rows: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1).to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            kinds = (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")


def _bands(capacity: int) -> list[tuple[int, int]]:
    """(shortest, longest) length of each band, from half the capacity down, each to half of the one before; the last
    takes all from 1/64 of the capacity down."""
    out, high = [], capacity // 2
    while high:
        low = high // 2 + 1 if high > capacity // 64 else 1
        out.append((low, high))
        high = low - 1
    return out


@dataclass
class Plan:
    """Which range takes which documents and gaps, in a size that depends on the number of different lengths and gaps
    (at most capacity each) and not on the number of ranges: alike ranges that follow each other are one entry."""

    each: int
    ranges: int
    #: length: how many documents are longer, and how many have it.
    docs: list[tuple[int, int, int]]
    #: gap, first rank, gaps for each range, first range, number of ranges.
    gaps: list[tuple[int, int, int, int, int]]
    #: first range, sequences that it and those up to the next entry may open each.
    opens: list[tuple[int, int]]

    def opening(self, part: int) -> int:
        return self.opens[bisect_right(self.opens, (part, 1 << 62)) - 1][1]


def _alike(docs: list[tuple[int, int, int]], each: int, total: int):
    """(first range, ranges, documents of each, their tokens, longest, shortest): ranges of one length alone that
    follow each other together, others one by one."""
    part, i = 0, 0
    while part * each < total:
        start, end = part * each, min(total, (part + 1) * each)
        while docs[i][1] + docs[i][2] <= start:
            i += 1
        length, before, n = docs[i]
        whole = (before + n - start) // each
        if whole:
            yield part, whole, each, each * length, length, length
            part += whole
            continue
        own, j = [], i
        while j < len(docs) and docs[j][1] < end:
            length, before, n = docs[j]
            own.append((length, min(end, before + n) - max(start, before)))
            j += 1
        yield part, 1, sum(n for _, n in own), sum(x * n for x, n in own), own[0][0], own[-1][0]
        part += 1


def _needed(docs: list[tuple[int, int]], free: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(gap, how many) of the gaps that best-fit over one range's lengths (length, n, from long to short) uses, by counts
    alone; capacity: what a sequence holds that is opened where no gap fits, 0 if none may be."""
    left, cut, used = dict(free), {}, {}
    sizes = sorted(g for g, n in left.items() if n)
    for length, n in docs:
        while n:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                if not capacity:
                    break
                gap, take = capacity, 1 if 2 * length <= capacity else n
            else:
                gap = sizes[at]
                spare = cut.get(gap, 0)
                # One at a time while another fits in what the first leaves: that is then the smallest gap.
                take = 1 if 2 * length <= gap else min(n, spare + left.get(gap, 0))
                old = min(take, spare)
                if old:
                    cut[gap] -= old
                if take > old:
                    used[gap] = used.get(gap, 0) + take - old
                    left[gap] -= take - old
                if not cut.get(gap) and not left.get(gap):
                    del sizes[at]
            n -= take
            if gap > length:
                if not cut.get(gap - length) and not left.get(gap - length):
                    insort(sizes, gap - length)
                cut[gap - length] = cut.get(gap - length, 0) + take
    return sorted(used.items())


def _plan(counts: dict[int, int], gaps: dict[int, int], rows: int, capacity: int) -> Plan:
    """Ranges of about `rows` documents (more where so many are short that they fill fewer than FULL sequences) over lengths from long to short, and a successor sweep over them: each takes the
    smallest gaps that hold some of its documents, as many as its tokens ask for; the last those that its documents use. What is
    left belongs to no range. A gap that several ranges could take is settled by rank. A range may open what its
    documents fill beyond those gaps, as whole sequences, if no gap is left above it; a single range what it needs."""
    total, tokens = sum(counts.values()), sum(length * n for length, n in counts.items())
    rows = max(rows, FULL * capacity * total // tokens)
    each = -(-total // max(1, total // rows))
    docs, before = [], 0
    for length in sorted(counts, reverse=True):
        docs.append((length, before, counts[length]))
        before += counts[length]
    ranges, free, sizes, out, opens = -(-total // each), dict(gaps), sorted(gaps), [], []
    for first, alike, n, tokens, long, short in _alike(docs, each, total):
        mean, part, end, found, taken = tokens / n, first, first + alike, 0.0, 0
        for gap in sizes[bisect_left(sizes, short) :]:
            holds = max(1, int(gap / mean)) * mean
            while free[gap] and part < min(end, ranges - 1):
                need = int((tokens - found) / holds) + 1
                at = gaps[gap] - free[gap]
                many = 0 if found else min(min(end, ranges - 1) - part, free[gap] // need)
                if many:
                    out.append((gap, at, need, part, many))
                    free[gap] -= need * many
                    opens.append((part, 0))
                    part += many
                    continue
                take = min(free[gap], need)
                out.append((gap, at, take, part, 1))
                free[gap] -= take
                found += take * holds
                if found >= tokens:
                    opens.append((part, 0))
                    part, found = part + 1, 0.0
        if part == ranges - 1:
            last = [(length, min(total, before + n) - max(part * each, before)) for length, before, n in docs if before + n > part * each]
            for gap, take in _needed(last, free, capacity if ranges == 1 else 0):
                take = min(free[gap], take + 4 * isqrt(take) + 8)  # ranks are drawn, so as many more as chance may withhold
                out.append((gap, gaps[gap] - free[gap], take, part, 1))
                free[gap] -= take
                found += take * max(1, int(gap / mean)) * mean
        if part < end:  # what is left of the gaps holds no document of these
            whole = int(capacity / mean) * mean
            above = any(n for g, n in free.items() if g >= long)
            for at, had in ((part, found), (part + 1, 0.0)):
                if at < end:
                    opens.append((at, 0 if above else max(0, int((tokens - had) / whole))))
    if ranges == 1:
        opens = [(0, total)]
    return Plan(each, ranges, docs, out, opens)


def _rank(n: str) -> Column:
    """A row's rank among the n of its size, by a hash over SLOTS slots."""
    return F.least(F.floor(F.pmod(F.xxhash64("row"), F.lit(SLOTS)) * (F.col(n) / F.lit(float(SLOTS)))), F.col(n) - 1)


def _placeless(rows: DataFrame) -> DataFrame:
    return rows.select("*", *(F.lit(None).cast("long").alias(n) for n in ("sequence_id", "offset")))


def _deal_docs(rows: DataFrame, plan: Plan) -> DataFrame:
    """Documents with their range. The plan's table has a row for each length, so it is sent by broadcast."""
    table = rows.sparkSession.createDataFrame(plan.docs, "size long, before long, n long")
    part = F.floor((F.col("before") + _rank("n")) / plan.each).cast("int")
    return _placeless(rows.join(F.broadcast(table), "size").withColumn("range", part).select(*rows.columns, "range"))


def _deal_gaps(rows: DataFrame, plan: Plan, free: dict[int, int]) -> DataFrame:
    """Gaps with their range, null where none takes them. The table has a few rows for each length and gap."""
    spark = rows.sparkSession
    numbered = rows.join(F.broadcast(spark.createDataFrame(list(free.items()), "size long, n long")), "size", "left").withColumn("rank", _rank("n"))
    table = spark.createDataFrame(plan.gaps, "of long, first long, per long, part long, many long")
    mine = (F.col("size") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("per") * F.col("many"))
    dealt = numbered.join(F.broadcast(table), mine, "left").withColumn("range", (F.col("part") + F.floor((F.col("rank") - F.col("first")) / F.col("per"))).cast("int"))
    return _placeless(dealt.select(*rows.columns, "range"))


def _sweep(rows: DataFrame, plan: Plan, tasks: int, capacity: int) -> DataFrame:
    """Each range's documents, from long to short, each into the smallest gap of the range that holds it; what a gap
    has left is a gap again. Where none fits, a range opens a sequence (named by its first document's row), as many as
    the plan allows it. A task sweeps its ranges one after another, so what it places does not depend on how many it has."""
    kinds = {f.name: f.dataType for f in rows.schema}

    def sweep(batches):
        _tokenizer.cache_clear()  # the ids are made by now: a worker that goes on need not keep what it learnt for them
        now, more, sizes, held, schema = None, 0, [], {}, None
        spare: tuple[list, list] = ([], [])

        def put(gap, sequence):
            if gap not in held:
                held[gap] = []
                insort(sizes, gap)
            held[gap].append(sequence)

        def close():
            for gap in sizes:
                spare[0].extend([gap] * len(held[gap]))
                spare[1].extend(held[gap])
            sizes.clear()
            held.clear()

        def gaps():
            n = len(spare[0])
            known = {"is_doc": pa.array([False] * n), "size": pa.array(spare[0], pa.int64()), "row": pa.array(spare[1], pa.int64())}
            out = pa.RecordBatch.from_arrays([known.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)
            spare[0].clear()
            spare[1].clear()
            return out

        for batch in batches:
            schema = batch.schema
            place = {n: i for i, n in enumerate(schema.names)}
            is_doc = batch.column(place["is_doc"])
            sequence, offset = [], []
            for part, doc, size, row in zip(*(batch.column(place[n]).to_pylist() for n in ("range", "is_doc", "size", "row"))):
                if part != now:
                    close()
                    now, more = part, plan.opening(part)
                if not doc:
                    put(size, row)
                    continue
                at = bisect_left(sizes, size)
                if at < len(sizes):
                    gap = sizes[at]
                    own = held[gap].pop()
                    if not held[gap]:
                        del held[gap], sizes[at]
                elif more:
                    gap, own, more = capacity, row, more - 1
                else:
                    sequence.append(None)
                    offset.append(None)
                    continue
                sequence.append(own)
                offset.append(capacity - gap)
                if gap > size:
                    put(gap - size, own)
            of = batch.filter(is_doc)
            yield pa.RecordBatch.from_arrays([pa.array({"sequence_id": sequence, "offset": offset}[n], pa.int64()) if n in ("sequence_id", "offset") else of.column(i) for n, i in place.items()], schema=schema)
            if len(spare[0]) > 50_000:
                yield gaps()
        close()
        if spare[0]:
            yield gaps()

    sorted_rows = rows.repartitionById(tasks, F.pmod("range", F.lit(tasks)).cast("int")).sortWithinPartitions("range", F.desc("size"), "is_doc", "row")
    return sorted_rows.mapInArrow(sweep, ", ".join(f"{n} {t.simpleString()}" for n, t in kinds.items()))


def fit(pieces: DataFrame, capacity: int, rows: int = 5_000, rounds: int = 3) -> DataFrame:
    """Places rows of PIECE and `row` (unique), each of at most capacity tokens: PIECE, sequence_id, offset. A range
    has about `rows` documents, however many ranges that makes; at most spark.sql.shuffle.partitions tasks sweep them.
    What a superstep leaves is ranged anew; in a band's last of `rounds` supersteps every range may open what it needs."""
    most = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    half = capacity // 2
    alone = pieces.filter(F.col("length") > half).select(*PIECE, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = [alone]
    gaps = alone.filter(F.col("length") < capacity).select((capacity - F.col("length")).alias("size"), F.col("sequence_id").alias("row"))
    free = {capacity - length: n for length, n in counts.items() if half < length < capacity}
    for low, high in _bands(capacity):
        left = {length: n for length, n in counts.items() if low <= length <= high}
        docs = pieces.filter(F.col("length").between(low, high)).select(F.lit(True).alias("is_doc"), F.col("length").alias("size"), "row", *PIECE)
        for step in range(rounds):
            if not left:
                break
            fitting = {g: n for g, n in free.items() if g >= low}
            plan = _plan(left, fitting, rows, capacity)
            if step == rounds - 1:
                plan.opens = [(0, sum(left.values()))]
            ranged = _deal_docs(docs, plan)
            dealt = _deal_gaps(gaps.select(F.lit(False).alias("is_doc"), "size", "row", *(F.lit(None).cast(pieces.schema[n].dataType).alias(n) for n in PIECE)), plan, fitting)
            swept = _sweep(ranged.unionByName(dealt.filter("range is not null")), plan, min(plan.ranges, most), capacity)
            swept = stage(swept.unionByName(dealt.filter("range is null")).drop("range"), "sweep")
            placed.append(swept.filter("sequence_id is not null").select(*PIECE, "sequence_id", "offset"))
            docs = swept.filter("is_doc and sequence_id is null").drop("sequence_id", "offset")
            gaps = swept.filter("not is_doc").select("size", "row")
            found = swept.filter("sequence_id is null").groupBy("is_doc", "size").count().collect()  # at most capacity rows of each kind
            left = {r["size"]: r["count"] for r in found if r["is_doc"]}
            free = {r["size"]: r["count"] for r in found if not r["is_doc"]}
    return reduce(DataFrame.unionByName, placed)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, rows: int = 5_000) -> DataFrame:
    """Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. rows: documents of a range, about."""
    return fit(stage(pieces(docs, tokenizer_path, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces"), capacity, rows)
