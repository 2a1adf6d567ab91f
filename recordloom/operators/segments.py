"""A keyword index in segments: increments of added and deleted rows, sorted blocks of postings, early-ending top-k.

An increment writes one segment: its rows' words (forward: id, len, terms, tfs, by id) and its postings in blocks. Postings are
ranged over files by (term, impact), as many files as the postings need, so every file holds a stretch of the sorted
terms, and the manifest has the stretch's bounds: a word or a prefix opens the files of its stretch only. Within a
term, postings go from the strongest to the weakest and are cut into blocks; a block has the pairs of frequency and
length that no other posting of it beats, from which its greatest possible share follows for any mean length.

Deleted rows stay in their segment. A deletion writes the pairs (segment, id), and the words that these rows held with
their number, so that statistics are sums over segments less the deleted: scores are those of an index built anew.
compact() writes small segments, without their deleted rows, as one. Changes are versions of a TableLog: readers see
whole increments, a batch is applied once, and two writers at once do not lose each other's.

A search for words reads blocks from the strongest on. It ends when the best sum that any unread row could reach is
less than the k-th best row found, whose rows' whole scores come from the forward files. Ties at the cut are not cut.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import tokens
from ..sources import store
from ..sources.tablelog import Conflict, State, TableLog
from . import search

BLOCK = "term string, seg string, part int, block int, n int, sky_tf array<int>, sky_len array<int>, ids array<bigint>, tfs array<int>, lens array<int>"
PIECE = "term string, weak double, ids array<bigint>, tfs array<int>, lens array<int>"
FORWARD = "id bigint, seg string, project string, len int, terms array<string>, tfs array<int>"
DEAD, LOST = "seg string, id bigint", "term string, n bigint"
#: Postings that are grouped by term before they are shuffled, about.
TOGETHER = 1 << 20
#: Ids that are sent to all executors, so that the words of the other rows are not shuffled; more are joined by shuffle.
SENT = 4_000_000
SCHEMAS = {"blocks": BLOCK, "forward": FORWARD, "dead": DEAD, "lost": LOST}


def share(tf: Column, length: Column, mean: float) -> Column:
    """A word's part of a row's score, but for the word's weight."""
    return tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / F.lit(mean)))


def _few(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= SENT else ids


def _weight(n: int, df: int) -> float:
    ratio = (n - df + 0.5) / (df + 0.5)
    return math.log(ratio) if ratio > 1 else 1e-6


def _weak(tfs: np.ndarray, lens: np.ndarray, mean: float) -> np.ndarray:
    """-share(): smaller is stronger."""
    return tfs * -2.2 / (tfs + 1.2 * (0.25 + 0.75 * lens / mean))


def _lists(starts: np.ndarray, total: int, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, total].astype(np.int32)), pa.array(values))


def _pieces(rows: pa.RecordBatch, mean: float, most: int) -> pa.RecordBatch:
    """The postings of some rows (id, len, terms, tfs) in pieces of one term, at most `most` postings each, from the strongest on."""
    flat = rows.column(2).flatten().dictionary_encode()
    code, tfs = flat.indices.to_numpy().astype(np.int64), rows.column(3).flatten().to_numpy()
    row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column(2)).to_numpy())
    ids, lens = rows.column(0).to_numpy()[row], rows.column(1).to_numpy()[row]
    weak = _weak(tfs, lens, mean)
    order = np.lexsort((ids, weak, code))
    code, n = code[order], len(order)
    first = np.flatnonzero(np.r_[True, np.diff(code) != 0][:n])
    at = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    starts = np.flatnonzero(at % most == 0)
    return pa.RecordBatch.from_arrays(
        [flat.dictionary.take(pa.array(code[starts])), pa.array(weak[order][starts]), _lists(starts, n, ids[order]), _lists(starts, n, tfs[order]), _lists(starts, n, lens[order])], ["term", "weak", "ids", "tfs", "lens"]
    )


def _complete(pieces: pa.RecordBatch, mean: float) -> tuple[pa.RecordBatch | None, pa.RecordBatch]:
    """Sorted pieces as those whose order no later piece changes, and the rest. A later piece may be of the last term and
    begins no stronger than the last piece does, so that of a long term what is stronger is complete."""
    terms, n = pieces.column(0), pieces.num_rows
    same = pc.equal(terms, terms[n - 1]).to_numpy(zero_copy_only=False)
    own = int(same.argmax())
    if pc.sum(pc.list_value_length(pieces.column(2)).slice(own)).as_py() <= TOGETHER:
        return (pieces.slice(0, own) if own else None), pieces.slice(own)
    tail = pieces.slice(own)
    ids, tfs, lens = (tail.column(c).flatten().to_numpy() for c in ("ids", "tfs", "lens"))
    ready = _weak(tfs, lens, mean) < tail.column("weak")[tail.num_rows - 1].as_py()
    if not ready.any():
        return (pieces.slice(0, own) if own else None), tail

    def piece(of: np.ndarray) -> pa.RecordBatch:
        weakest = [tail.column("weak")[tail.num_rows - 1].as_py()]
        return pa.RecordBatch.from_arrays([terms.slice(n - 1), pa.array(weakest, pa.float64()), *(_lists(np.array([0]), int(of.sum()), x[of]) for x in (ids, tfs, lens))], schema=pieces.schema)

    done = pa.Table.from_batches([pieces.slice(0, own), piece(ready)]).combine_chunks().to_batches()[0]
    return done, piece(~ready)


def _blocks(pieces: pa.RecordBatch, mean: float, size: int, seg: str, part: int, known: dict[str, int]) -> pa.RecordBatch:
    """The blocks of sorted pieces. known: the last term and how many blocks it has by now; it is brought up to date."""
    term = pieces.column(0).dictionary_encode()
    code = np.repeat(term.indices.to_numpy().astype(np.int64), pc.list_value_length(pieces.column(2)).to_numpy())
    ids, tfs, lens = (pieces.column(c).flatten().to_numpy() for c in ("ids", "tfs", "lens"))
    order = np.lexsort((ids, _weak(tfs, lens, mean), code))
    code, ids, tfs, lens, n = code[order], ids[order], tfs[order], lens[order], len(order)
    first = np.flatnonzero(np.r_[True, np.diff(code) != 0][:n])
    at = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    starts = np.flatnonzero(at % size == 0)
    sizes = np.diff(np.r_[starts, n])
    number = at[starts] // size
    number[code[starts] == 0] += known.get(term.dictionary[0].as_py(), 0)
    last = term.dictionary[len(term.dictionary) - 1].as_py()
    known.clear()
    known[last] = int(number[-1]) + 1
    # Of each block the postings that no shorter row's is as frequent as: short and frequent beats the rest.
    block = np.repeat(np.arange(len(starts)), sizes)
    short = np.lexsort((-tfs, lens, block))
    key = block[short] * (int(tfs.max()) + 1) + tfs[short]
    sky = short[np.r_[True, key[1:] > np.maximum.accumulate(key)[:-1]]]
    of = np.searchsorted(block[sky], np.arange(len(starts)))
    same = lambda value, kind: pa.array(np.full(len(starts), value), kind)
    return pa.RecordBatch.from_arrays(
        [
            term.dictionary.take(pa.array(code[starts])), same(seg, pa.string()), same(part, pa.int32()), pa.array(number, pa.int32()), pa.array(sizes, pa.int32()), _lists(of, len(sky), tfs[sky]), _lists(of, len(sky), lens[sky]),
            _lists(starts, n, ids), _lists(starts, n, tfs), _lists(starts, n, lens),
        ],
        ["term", "seg", "part", "block", "n", "sky_tf", "sky_len", "ids", "tfs", "lens"],
    )


@dataclass
class Found:
    """rows: id, rank (lower is better), best first. read and blocks: blocks of postings read, and there for the query's words."""

    rows: DataFrame
    read: int
    blocks: int
    opened: int


class SegmentIndex:
    """rows have id (long), the text columns and, if named, project."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str], project: str | None = None, block: int = 256, per_file: int = 1_000_000):
        self.spark, self.log, self.columns, self.project, self.block, self.per_file = spark, TableLog(spark, path), columns, project, block, per_file

    # Reading

    def _files(self, state: State, kind: str, wanted=lambda about: True) -> list[str]:
        return [p for p, about in state.files.items() if about["kind"] == kind and wanted(about)]

    def _frame(self, state: State, kind: str, wanted=lambda about: True) -> DataFrame:
        return self.log.files(self._files(state, kind, wanted), StructType.fromDDL(SCHEMAS[kind]))

    def _alive(self, state: State, rows: DataFrame) -> DataFrame:
        if not state.facts.get("n_dead"):
            return rows
        return rows.join(_few(self._frame(state, "dead"), state.facts["n_dead"]), ["seg", "id"], "left_anti")

    def live(self, state: State | None = None) -> DataFrame:
        """The words of every row that is not deleted."""
        state = state or self.log.state()
        return self._alive(state, self._frame(state, "forward"))

    def totals(self, state: State | None = None) -> tuple[int, float]:
        facts = (state or self.log.state()).facts
        n = facts.get("n", 0)
        return n, facts["len"] / n if n and facts["len"] else 1.0

    def terms(self) -> DataFrame:
        """term, df of the whole table."""
        state = self.log.state()
        counts = self._frame(state, "blocks").select("term", F.col("n").cast("long").alias("n")).unionByName(self._frame(state, "lost").select("term", (-F.col("n")).alias("n")))
        return counts.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")

    # Writing

    def _forward(self, rows: DataFrame, seg: str) -> DataFrame:
        def count(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    words = [Counter(x) for x in part.column(2).to_pylist()]
                    yield pa.RecordBatch.from_arrays([
                        part.column(0), pa.array([seg] * len(words)), part.column(1), pa.array([sum(c.values()) for c in words], pa.int32()), pa.array([list(c) for c in words], pa.list_(pa.string())),
                        pa.array([list(c.values()) for c in words], pa.list_(pa.int32())),
                    ], ["id", "seg", "project", "len", "terms", "tfs"])

        project = F.lit(None) if self.project is None else F.col(self.project)
        cut = store.spread(rows).select(F.col("id").cast("long").alias("id"), project.cast("string").alias("project"), F.concat(*(tokens(F.col(c)) for c in self.columns)).alias("t"))
        return cut.mapInArrow(count, FORWARD)

    def _write_forward(self, forward: DataFrame, seg: str) -> tuple[dict, dict]:
        """Files, and the sums that are known of them."""
        files = self.log.write(forward, kind="forward", seg=seg)
        held = self.log.files(list(files), StructType.fromDDL(FORWARD))
        sums = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings"), F.count_distinct("id").alias("ids")).first().asDict()
        if sums.pop("ids") != sums["n"]:
            raise ValueError("two rows have the same id, or a row has none")
        return files, sums

    def _write_blocks(self, forward: DataFrame, seg: str, postings: int, mean: float) -> dict:
        size = self.block

        def group(batches):
            for batch in batches:
                part = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy()) // TOGETHER
                for some in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(part)) + 1):
                    if len(some):
                        yield _pieces(batch.slice(some[0], len(some)), mean, max(1, size // 4))

        def cut(batches):
            from pyspark import TaskContext

            part, held, at = TaskContext.get().partitionId(), None, {}
            for batch in batches:
                held = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
                done, held = _complete(held, mean)
                if done is not None:
                    yield _blocks(done, mean, size, seg, part, at)
            if held is not None:
                yield _blocks(held, mean, size, seg, part, at)

        found = forward.select("id", "len", "terms", "tfs").mapInArrow(group, PIECE)
        blocks = found.repartitionByRange(max(1, -(-postings // self.per_file)), "term", "weak").sortWithinPartitions("term", "weak").mapInArrow(cut, BLOCK)
        files = self.log.write(blocks, kind="blocks", seg=seg)
        bounds = self.log.files(list(files), StructType.fromDDL(BLOCK)).groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).agg(F.min("term").alias("low"), F.max("term").alias("high"), F.count("*").alias("blocks"), F.sum("n").alias("postings"))
        known = {r["file"]: r for r in bounds.collect()}  # one row a file
        return {p: about | {c: known[name][c] for c in ("low", "high", "blocks", "postings")} for p, about in files.items() if (name := p.rsplit("/", 1)[1]) in known}

    def change(self, rows: DataFrame | None = None, deleted: DataFrame | None = None, batch: tuple[str, int] | None = None, retries: int = 3) -> int:
        """One increment: rows are added, or take the place of those with their id; ids in deleted (id) go. Writes what
        these rows need and reads of the rest the forward rows with such an id. If another writer was first, it is made again on what that one left."""
        for attempt in range(retries + 1):
            try:
                return self._change(self.log.state(), rows, deleted, batch)
            except Conflict:
                if attempt == retries:
                    raise
        raise AssertionError

    def _change(self, state: State, rows: DataFrame | None, deleted: DataFrame | None, batch: tuple[str, int] | None) -> int:
        if batch and state.batches.get(batch[0], -1) >= batch[1]:
            return state.version
        seg, add = uuid.uuid4().hex, {}
        made = {"n": 0, "len": 0, "postings": 0}
        written = None
        if rows is not None:
            files, made = self._write_forward(self._forward(rows, seg), seg)
            add |= files
            written = self.log.files(list(files), StructType.fromDDL(FORWARD))
        gone = [x.select(F.col("id").cast("long").alias("id")) for x in (written, deleted) if x is not None]
        lost = {"n": 0, "len": 0}
        if state.facts.get("n") and gone:
            wanted = (gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])).distinct()
            # Which rows they are is told by their numbers; the words of these are read where they lie.
            old = store.staged(self.live(state).select("seg", "id", "len").join(wanted, "id", "left_semi"), "dead-rows")
            lost = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")).first().asDict()
            if lost["n"]:
                add |= self.log.write(old.select("seg", "id"), kind="dead")
                held = self._frame(state, "forward").join(_few(old.select("seg", "id"), lost["n"]), ["seg", "id"], "left_semi")
                add |= self.log.write(held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).sortWithinPartitions("term"), kind="lost")
            store.drop_staged(old)
        facts = {"n": state.facts.get("n", 0) + made["n"] - lost["n"], "len": state.facts.get("len", 0) + made["len"] - lost["len"], "n_dead": state.facts.get("n_dead", 0) + lost["n"]}
        if written is not None:
            add |= self._write_blocks(written, seg, made["postings"], facts["len"] / facts["n"] if facts["n"] and facts["len"] else 1.0)
        return self.log.commit(state, add, batch=batch, facts=facts)

    def compact(self, most: int = 8) -> int:
        """Where there are more than `most` segments or a fifth of the rows is deleted: all segments but those that are
        larger than the rest together, and any with deleted rows, become one. Each row is so written anew about as often as the table doubles."""
        state = self.log.state()
        sizes = Counter()
        for about in state.files.values():
            if about["kind"] == "blocks":
                sizes[about["seg"]] += about["postings"]
        dead = {r["seg"] for r in self._frame(state, "dead").select("seg").distinct().collect()} if state.facts.get("n_dead") else set()  # one row a segment
        many, rotten = len(sizes) > most, 5 * state.facts.get("n_dead", 0) > state.facts.get("n", 0)
        if not (many or rotten):
            return state.version
        rest, chosen = sum(sizes.values()), set(dead if rotten else ())
        for seg, n in sizes.most_common():
            rest -= n
            if many and n <= rest:
                chosen.add(seg)
        if many:
            chosen |= {seg for seg, _ in sizes.most_common()[-2:]}
        seg = uuid.uuid4().hex
        forward = self._alive(state, self._frame(state, "forward", lambda a: a["seg"] in chosen)).withColumn("seg", F.lit(seg))
        files, made = self._write_forward(forward, seg)
        add = files | self._write_blocks(self.log.files(list(files), StructType.fromDDL(FORWARD)), seg, made["postings"], self.totals(state)[1])
        remove = [p for p, a in state.files.items() if a.get("seg") in chosen]
        facts = {}
        if dead & chosen:  # what is left of the deletions: those in segments that stay
            left = self._frame(state, "dead").filter(~F.col("seg").isin(*chosen))
            n_left = left.count()
            remove += self._files(state, "dead") + self._files(state, "lost")
            if n_left:
                add |= self.log.write(left, kind="dead")
                held = self._frame(state, "forward", lambda a: a["seg"] not in chosen).join(left, ["seg", "id"], "left_semi")
                add |= self.log.write(held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).sortWithinPartitions("term"), kind="lost")
            facts = {"n_dead": n_left}
        return self.log.commit(state, add, remove, facts=facts)

    # Searching

    def search(self, query: str, limit: int = 10, project: str | None = None, hidden: DataFrame | None = None, first: int = 1) -> Found:
        """The best rows for a query of words, prefixes, AND, OR, NOT and parentheses; phrases and places need the index
        with positions (operators.index). project and hidden (id) restrict what is returned, not the statistics. first: blocks of each
        word that are read at first, four times as many each time after."""
        tree = search.Parser(query, self.columns).parse()
        leaves = search.leaves(tree)
        if any(isinstance(x, search.Near) for x in _nodes(tree)) or any(len(x.words) != 1 or x.first or x.columns is not None for x in leaves):
            raise search.QueryError("this index has no positions: words, prefixes, AND, OR and NOT only")
        state = self.log.state()
        n, mean = self.totals(state)
        specs = list(dict.fromkeys((x.words[0], x.prefix) for x in leaves))
        files = self._files(state, "blocks", lambda a: any(a["high"] >= w and (a["low"] <= w or a["low"].startswith(w) and p) for w, p in specs))
        of = lambda w, p: F.col("term").startswith(w) if p else F.col("term") == w
        held = self.log.files(files, StructType.fromDDL(BLOCK)).filter(search._some([of(w, p) for w, p in specs]))
        bare = Found(self.spark.createDataFrame([], "id long, rank double"), 0, 0, len(files))
        if not files or not n:
            return bare
        if any(p for _, p in specs):
            return self._whole(state, held, tree, specs, n, mean, limit, project, hidden, len(files))
        heads = held.groupBy("term", "seg", "part").agg(F.count("*").alias("blocks"), F.sum("n").alias("n")).collect()  # one row for each word and file
        lost = {r["term"]: r["n"] for r in self._frame(state, "lost").filter(F.col("term").isin(*(w for w, _ in specs))).groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row a word
        df = Counter({w: -lost.get(w, 0) for w, _ in specs})
        runs: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for r in sorted(heads, key=lambda r: r["part"]):
            df[r["term"]] += r["n"]
            runs.setdefault((r["term"], r["seg"]), []).append((r["part"], r["blocks"]))
        weights = {w: _weight(n, df[w]) for w, _ in specs}
        times = Counter(x.words[0] for x in leaves)
        total = sum(b for own in runs.values() for _, b in own)
        depth = {w: first for w, _ in specs}
        while True:
            seen_if, read = _until(runs, depth)
            rest = {} if read == total else {r["term"]: r["best"] for r in held.filter(~seen_if).groupBy("term").agg(F.max(F.array_max(F.zip_with("sky_tf", "sky_len", lambda t, x: share(t, x, mean)))).alias("best")).collect()}  # one row a word
            bound = {w: weights[w] * rest.get(w, 0.0) for w, _ in specs}
            rows = self._counts(state, held.filter(seen_if), specs, project, hidden)
            if read == total:
                matched, score = _score(tree, specs, {w: F.lit(weights[w]) for w, _ in specs}, mean)
                best = rows.filter(matched).select("id", (-score).alias("rank"))
                return Found(best.orderBy("rank", "id").limit(limit), read, total, len(files))
            most = sum((times[w] * F.when(F.col(f"_f{i}") > 0, weights[w] * share(F.col(f"_f{i}"), F.col("_len"), mean)).otherwise(bound[w]) for i, (w, _) in enumerate(specs)), F.lit(0.0))
            rows = rows.withColumn("most", most)
            tried = rows.orderBy(F.desc("most"), "id").limit(4 * limit)
            sure = self._judged(state, tried, tree, specs, weights, mean).orderBy("rank", "id").limit(limit).collect()  # limit rows
            unseen = sum(times[w] * bound[w] for w, _ in specs)
            if len(sure) == limit and unseen < -sure[-1]["rank"] - 1e-9:
                open_ = rows.filter(F.col("most") >= -sure[-1]["rank"] - 1e-9)
                best = self._judged(state, open_, tree, specs, weights, mean)
                return Found(best.orderBy("rank", "id").limit(limit), read, total, len(files))
            # Deepen what could add most; a word of little weight is seldom worth its blocks.
            top = max(times[w] * bound[w] for w, _ in specs)
            depth = {w: d * 4 if 4 * times[w] * bound[w] >= top else d for w, d in depth.items()}

    def _counts(self, state, blocks, specs, project, hidden) -> DataFrame:
        """id, _len and each word's frequency (_f0, ...) of the rows in these blocks that may be returned."""
        flat = blocks.select("term", "seg", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p")).select("term", "seg", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))
        flat = self._alive(state, flat)
        if hidden is not None:
            flat = flat.join(hidden.select("id").distinct(), "id", "left_anti")
        if project is not None:
            flat = flat.join(self._frame(state, "forward").filter(F.col("project") == project).select("seg", "id"), ["seg", "id"], "left_semi")
        is_ = lambda w, p: F.col("term").startswith(w) if p else F.col("term") == w
        return flat.groupBy("id").agg(F.max("len").alias("_len"), *(F.sum(F.when(is_(w, p), F.col("tf")).otherwise(0)).alias(f"_f{i}") for i, (w, p) in enumerate(specs)))

    def _judged(self, state, candidates, tree, specs, weights, mean) -> DataFrame:
        """id, rank of the candidates that match, by their whole words."""
        chosen = store.staged(candidates.select("id"), "candidates")
        held = self._alive(state, self._frame(state, "forward").join(_few(chosen, chosen.count()), "id", "left_semi"))
        tf = lambda w: F.coalesce(F.get("tfs", (F.array_position("terms", F.lit(w)) - 1).cast("int")), F.lit(0))
        counted = held.select("id", F.col("len").alias("_len"), *(tf(w).alias(f"_f{i}") for i, (w, _) in enumerate(specs)))
        matched, score = _score(tree, specs, {w: F.lit(weights[w]) for w, _ in specs}, mean)
        return counted.filter(matched).select("id", (-score).alias("rank"))

    def _whole(self, state, held, tree, specs, n, mean, limit, project, hidden, opened) -> Found:
        """With prefixes: how many rows hold one is known only when all its words' rows are, so all blocks are read."""
        every = self._counts(state, held, specs, None, None)
        stats = every.agg(F.count("*").alias("rows"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in range(len(specs)))).first()
        weights = {w if not p else w + "*": F.lit(_weight(n, stats[f"d{i}"])) for i, (w, p) in enumerate(specs)}
        rows = self._counts(state, held, specs, project, hidden) if project is not None or hidden is not None else every
        matched, score = _score(tree, specs, weights, mean)
        blocks = held.count()
        return Found(rows.filter(matched).select("id", (-score).alias("rank")).orderBy("rank", "id").limit(limit), blocks, blocks, opened)


def _nodes(node) -> list:
    return [node, *(x for p in getattr(node, "parts", ()) for x in _nodes(p))]


def _until(runs: dict, depth: dict[str, int]) -> tuple[Column, int]:
    """Whether a block is among the first of its word and segment, and how many are."""
    known, read = [], 0
    for (term, seg), parts in runs.items():
        left = depth[term]
        for part, blocks in parts:
            take = min(left, blocks)
            if not take:
                break
            here = (F.col("term") == term) & (F.col("seg") == seg) & (F.col("part") == part)
            known.append(here if take == blocks else here & (F.col("block") < take))
            left, read = left - take, read + take
    return search._some(known), read


def _score(tree, specs, weights: dict[str, Column], mean: float) -> tuple[Column, Column]:
    """(matched, score) over _f0, ... and _len."""
    place = {s: i for i, s in enumerate(specs)}

    def walk(node):
        if isinstance(node, search.Phrase):
            f = F.col(f"_f{place[node.words[0], node.prefix]}")
            return f > 0, weights[node.words[0] + "*" * node.prefix] * share(f, F.col("_len"), mean)
        made = [walk(p) for p in node.parts]
        if node.kind == "or":
            return search._some([m for m, _ in made]), sum((F.when(m, s).otherwise(0.0) for m, s in made), F.lit(0.0))
        if node.kind == "and":
            return search._every([m for m, _ in made]), sum((s for _, s in made), F.lit(0.0))
        return made[0][0] & ~made[1][0], made[0][1]

    return walk(tree)
