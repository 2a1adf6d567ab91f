"""Prefix trie of conversations, as succinct level-order tries over ranges of the sorted conversations.

A turn is named by the MD5 of its role and text, so that no text is sorted or grouped. Conversations of the same turns
become one row with their number and smallest id before anything is dealt out. The rows are sorted by their turns'
names over all tasks, so a prefix's conversations stand together, and a task's range of rows is a shard: numpy finds
where neighbours part, lays the shard's nodes out level by level as a LOUDS bitvector (each node's children as ones,
then a zero) with an array of labels, and sums from the deepest level up. Only the paths of a shard's first and last row can go on
in another shard. These upper levels are merged by name and summed apart, two paths a shard, whatever the number of
conversations below them; so a prefix that very many conversations share is no hot key.

A conversation of more than `width` turns is cut into bands of that many. A band is a trie of its own below the node
where the one before it ends; bands are worked from the deepest up, and each hands its totals to that node. No task
holds more than a band of a conversation and the rows of its own range; turns are numbered by their place in the sorted
table, not in a window over the conversation.

Null role or text is empty. Turns are ordered by number (null first), then by name, so repeated rows give the same
result each time. Rows without a conv_id belong to no conversation and take no part. An empty table has no node, not
even a root. Other columns are not read, whatever their names. Texts of any length are read once, by their own task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

#: Characters of a turn's name.
NAME = 32
NONE = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
#: What a shard tells: nodes that are whole; those whose parent is an upper node; its part of the upper nodes; the totals below a band's root.
WHOLE, BELOW, UPPER, ROOT = range(4)
TOLD = "kind int, name string, parent string, conv long, depth long, parent_conv long, n long, children long, leaves long, saved long, words long, ends string"


def _told(turns: DataFrame) -> DataFrame:
    """conv, turn, label, words of every turn, without its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    label = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", label.alias("label"), words.alias("words"))


def _sorted(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns in their order with task and id, and for each conversation and task the id that its place 0 has or
    would have (zero) and its number of turns in that task."""
    order = ["conv", "turn", "label"]
    dealt = stage(_told(turns), "turn-names").repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stage(dealt.select("conv", "label", "words", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("id")), "turns-sorted")
    stretches = kept.groupBy("conv", "task").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv").orderBy("task")) - F.col("n")  # as many rows of a conversation as tasks hold it
    return kept, stretches.select("conv", "task", (F.col("first") - before).alias("zero"), "n")


def sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth from 1, label, words) of every turn, and all conversations (conv, length)."""
    kept, begun = _sorted(turns)
    rows = kept.join(begun.select("conv", "task", "zero"), ["conv", "task"]).select("conv", (F.col("id") - F.col("zero") + 1).alias("depth"), "label", "words")
    return rows, begun.groupBy("conv").agg(F.sum("n").alias("length"))


def rebuilt(turns: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The same after the first h turns of every conversation c are those of conversation c - c % block, where h is the
    CRC-32 of c's decimal modulo `most`; all conversations, turnless ones too."""
    kept, begun = _sorted(turns)
    convs = begun.groupBy("conv").agg(F.sum("n").alias("n"))
    known = convs.select("conv", "n", (F.col("conv") - F.col("conv") % block).alias("of"), (F.crc32(F.col("conv").cast("string")) % most).alias("h"))
    lent = convs.filter(F.col("conv") % block == 0).select(F.col("conv").alias("of"), F.col("n").alias("there"))
    shift = known.join(lent, "of", "left").select("conv", "n", "of", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("head"))
    placed = begun.drop("n").join(shift.drop("n"), "conv")
    rows = kept.join(placed, ["conv", "task"]).withColumn("place", F.col("id") - F.col("zero"))
    own = rows.filter("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("head") + 1).alias("depth"), "label", "words")
    # At most most - 1 turns of each block's first conversation, each for at most 2 * block conversations.
    heads = rows.filter((F.col("place") < most - 1) & (F.col("conv") == F.col("of"))).select("of", "place", "label", "words")
    borrowed = shift.filter("head > 0").join(heads, "of").filter("place < head").select("conv", (F.col("place") + 1).alias("depth"), "label", "words")
    return own.unionByName(borrowed), shift.select("conv", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def _ends(segments: DataFrame) -> DataFrame:
    """gid, ends: the SHA-256 of the ids of the conversations that end with a group's last turn, ascending, joined by
    commas. Ids are sorted and written in blocks of 65,536 numbers; a group's blocks are then read one after another, as the hash demands."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = segments.filter("last").groupBy("gid", F.shiftright("conv", 16).alias("block")).agg(text.alias("ids"))

    def chain(batches):
        now, state, out = None, None, ([], [])
        for batch in batches:
            for gid, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if gid != now:
                    if now is not None:
                        out[0].append(now)
                        out[1].append(state.hexdigest())
                    now, state = gid, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["gid", "ends"])
            out = ([], [])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["gid", "ends"])

    return blocks.repartition("gid").sortWithinPartitions("gid", "block").select("gid", "ids").mapInArrow(chain, "gid string, ends string")


def _groups(rows: DataFrame, convs: DataFrame, width: int) -> tuple[DataFrame, int | None]:
    """One row for all conversations that have the same turns in a band below the same node: band, start (that node's
    name), key (the turns' names), words, next (the name of the node at its end), conv (smallest), n, ends; and the deepest band."""
    last_turn = F.col("depth") - 1
    cut = (
        rows.groupBy("conv", F.floor(last_turn / width).cast("int").alias("band"))
        .agg(F.array_sort(F.collect_list(F.struct("depth", "label", "words"))).alias("t"))  # at most width turns
        .select("conv", "band", F.array_join(F.col("t.label"), "").alias("key"), F.col("t.words").alias("words"))
    )
    turnless = convs.filter("length = 0").select("conv", F.lit(0).alias("band"), F.lit("").alias("key"), F.array().cast("array<bigint>").alias("words"))
    held = stage(cut.unionByName(turnless), "segments")
    top = held.agg(F.max("band")).first()[0]
    if not top:
        chained = held.withColumns({"start": F.lit(""), "next": F.lit(""), "last": F.lit(True)})
    else:
        own = W.partitionBy("conv").orderBy("band")  # one row for each band of a conversation
        names = lambda until: F.array_join(F.collect_list("k").over(own.rowsBetween(W.unboundedPreceding, until)), "")
        chained = held.withColumn("k", F.md5(F.col("key").cast("binary"))).withColumns({
            "start": F.when(F.col("band") == 0, "").otherwise(F.md5(names(-1).cast("binary"))), "next": F.md5(names(0).cast("binary")),
            "last": F.col("band") == F.max("band").over(W.partitionBy("conv")),
        }).drop("k")
    segments = chained.withColumn("gid", F.md5(F.concat("start", F.lit("|"), "key").cast("binary")))
    grouped = segments.groupBy("band", "start", "key", "words", "next", "gid").agg(F.min("conv").alias("conv"), F.count("*").alias("n"))
    return stage(grouped.join(_ends(segments), "gid", "left").drop("gid"), "groups"), top


class Shard:
    """The trie over sorted rows (start, key): nodes in level order, those of a level by their first row."""

    def __init__(self, starts: list[str], keys: list[str], words: np.ndarray):
        m = len(keys)
        lens = np.array([len(k) // NAME for k in keys], np.int64)
        self.names = np.frombuffer("".join(keys).encode(), f"S{NAME}")
        offsets = np.concatenate(([0], np.cumsum(lens)))
        rows = np.repeat(np.arange(m), lens)
        place = np.arange(offsets[-1]) - offsets[rows]
        # How many turns a row shares with the row before it.
        same = np.array([False] + [a == b for a, b in zip(starts, starts[1:])], bool)
        before = np.maximum(rows - 1, 0)
        fits = same[rows] & (place < lens[before])
        other = np.where(fits, offsets[before] + place, 0)
        differs = ~fits | (self.names != self.names[other]) if len(rows) else np.zeros(0, bool)
        shared = np.where(same, lens, 0)
        np.minimum.at(shared, rows[differs], place[differs])
        new = np.concatenate((~same, place >= shared[rows]))
        self.row, depth = np.concatenate((np.arange(m), rows)), np.concatenate((np.zeros(m, np.int64), place + 1))
        order = np.lexsort((self.row, depth))
        self.node = np.empty(len(order), np.int64)
        self.node[order] = np.cumsum(new[order]) - 1
        self.size = int(self.node.max()) + 1
        above = np.concatenate((np.full(m, -1), np.where(place == 0, rows, np.arange(m, m + len(rows)) - 1)))  # the element one level up
        born = np.flatnonzero(new)
        turns = born[born >= m]
        self.roots = len(born) - len(turns)
        degree = np.bincount(self.node[above[turns]], minlength=self.size)
        #: LOUDS: each node's children as ones, then a zero.
        self.bits = np.ones(self.size + len(turns), np.uint8)
        self.bits[np.cumsum(degree + 1) - 1] = 0
        # The k-th one is node roots + k, and the zeros before it are the nodes before its parent.
        self.parent = np.concatenate((np.full(self.roots, -1), (np.cumsum(self.bits == 0))[self.bits == 1]))
        self.depth, self.words, self.label = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64), np.zeros(self.size, f"S{NAME}")
        self.depth[self.node[born]] = depth[born]
        self.words[self.node[turns]] = words[turns - m]
        self.label[self.node[turns]] = self.names[turns - m]
        self.levels = np.concatenate((np.flatnonzero(np.diff(self.depth, prepend=-1)), [self.size]))
        self.end = self.node[np.where(lens > 0, m + offsets[1:] - 1, np.arange(m))]
        self.last = [self.node[np.concatenate(([r], m + np.arange(offsets[r], offsets[r + 1])))] for r in (0, m - 1)]  # both outer paths


def roll_up(parent: np.ndarray, levels: np.ndarray, *sums: np.ndarray, but: np.ndarray | None = None) -> None:
    """Adds every node's sums to its parent's, from the deepest level up; nodes under `but` keep theirs."""
    for a, b in zip(levels[-2:0:-1], levels[:0:-1]):
        own = np.arange(a, b)
        if but is not None:
            own = own[~but[a:b]]
        for s in sums:
            np.add.at(s, parent[own], s[own])


def _shards(groups: DataFrame, parts: int) -> DataFrame:
    return groups.repartitionByRange(parts, "start", "key").sortWithinPartitions("start", "key")


def tries(groups: DataFrame, parts: int) -> DataFrame:
    """The shards themselves: shard, n_nodes, n_roots, bits (LOUDS, packed from the highest bit of a byte), labels (the
    nodes' turn names in level order, roots empty)."""

    def build(batches):
        table = pa.Table.from_batches(list(batches))
        if table.num_rows:
            t = table.to_pydict()
            made = Shard(t["start"], t["key"], np.array([w for own in t["words"] for w in own], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([t["shard"][0]], pa.int32()), pa.array([made.size]), pa.array([made.roots]), pa.array([np.packbits(made.bits).tobytes()]), pa.array([[x.decode() for x in made.label.tolist()]])], ["shard", "n_nodes", "n_roots", "bits", "labels"])

    return _shards(groups, parts).select(F.spark_partition_id().alias("shard"), "start", "key", "words").mapInArrow(build, "shard int, n_nodes long, n_roots long, bits binary, labels array<string>")


def _tell(groups: DataFrame, parts: int, base: int) -> DataFrame:
    """TOLD of every shard of one band; base: the depth of its roots."""

    def build(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        starts = t.column("start").to_pylist()
        words = t.column("words").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        s = Shard(starts, t.column("key").to_pylist(), words)
        conv, n, root_conv = (t.column(c).to_numpy() for c in ("conv", "n", "root_conv"))
        members, least = np.zeros(s.size, np.int64), np.full(s.size, np.iinfo(np.int64).max)
        np.add.at(members, s.node, n[s.row])
        np.minimum.at(least, s.node, conv[s.row])
        ends = np.full(s.size, None, object)
        ends[s.end] = t.column("ends").to_numpy(zero_copy_only=False)
        children, leaves, saved = (np.zeros(s.size, np.int64) for _ in range(3))
        for into, c in ((children, "x_children"), (leaves, "x_leaves"), (saved, "x_saved")):
            into[s.end] = t.column(c).to_numpy()
        if base:  # a band's root is a node of the band before
            least[: s.roots] = root_conv[s.row[: len(starts)]][np.unique(s.node[: len(starts)], return_index=True)[1]]
            members[: s.roots] = 1
        upper, names = np.zeros(s.size, bool), {}
        for row, path in zip((0, len(starts) - 1), s.last):
            name = starts[row]
            for k, node in enumerate(path.tolist()):
                if k:
                    name = hashlib.md5(name.encode() + s.label[node]).hexdigest()
                names[node] = name
            upper[path] = True
        below = np.flatnonzero((s.parent >= 0) & ~upper)
        np.add.at(children, s.parent[below], 1)
        leaves += (children == 0) & ~upper
        saved += np.where(upper, 0, (members - 1) * s.words)
        roll_up(s.parent, s.levels, leaves, saved, but=upper)
        top = (s.parent >= 0) & upper[s.parent]
        is_root = s.parent < 0
        kind = np.where(upper, UPPER, np.where(is_root & (base > 0), ROOT, np.where(top, BELOW, WHOLE)))
        ids = range(s.size)
        named = [names.get(i) if upper[i] else None for i in ids]
        for row in range(len(starts)):
            node = int(s.node[row])
            if named[node] is None:
                named[node] = starts[row]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kind, pa.int32()), pa.array(named, pa.string()), pa.array([names.get(p) for p in s.parent.tolist()], pa.string()), pa.array(least), pa.array(s.depth + base),
                pa.array(np.where(is_root, 0, least[s.parent]), mask=is_root | top), pa.array(members), pa.array(children), pa.array(leaves), pa.array(saved), pa.array(s.words), pa.array(ends.tolist(), pa.string()),
            ],
            ["kind", "name", "parent", "conv", "depth", "parent_conv", "n", "children", "leaves", "saved", "words", "ends"],
        )

    return _shards(groups, parts).select("start", "key", "words", "conv", "n", "ends", "root_conv", "x_children", "x_leaves", "x_saved").mapInArrow(build, TOLD)


def _merged(told: DataFrame, base: int) -> DataFrame:
    """The upper nodes of all shards, as TOLD: parts of a node are summed by name, and the upper levels, at most two
    paths a shard, are summed in one place."""
    parts = told.filter(F.col("kind") == UPPER).groupBy("name").agg(
        F.max("parent").alias("parent"), F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.sum("n").alias("n"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.max("words").alias("words"), F.max("ends").alias("ends"),
    )

    def build(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches).sort_by([("depth", "ascending"), ("name", "ascending")])
        at = {name: i for i, name in enumerate(t.column("name").to_pylist())}
        depth = t.column("depth").to_numpy()
        parent = np.array([-1 if d == base else at[p] for d, p in zip(depth.tolist(), t.column("parent").to_pylist())], np.int64)
        levels = np.concatenate((np.flatnonzero(np.diff(depth, prepend=-1)), [len(depth)]))
        conv, n, children, leaves, saved, words = (t.column(c).to_numpy().copy() for c in ("conv", "n", "children", "leaves", "saved", "words"))
        is_root = parent < 0
        np.add.at(children, parent[~is_root], 1)
        leaves += children == 0
        if not base or not is_root.all():
            saved += np.where(is_root & (base > 0), 0, (n - 1) * words)
        roll_up(parent, levels, leaves, saved)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.where(is_root & (base > 0), ROOT, WHOLE), pa.int32()), t.column("name").combine_chunks(), t.column("parent").combine_chunks(), pa.array(conv), pa.array(depth),
                pa.array(np.where(is_root, 0, conv[parent]), mask=is_root), pa.array(n), pa.array(children), pa.array(leaves), pa.array(saved), pa.array(words), t.column("ends").combine_chunks(),
            ],
            ["kind", "name", "parent", "conv", "depth", "parent_conv", "n", "children", "leaves", "saved", "words", "ends"],
        )

    return stage(parts.coalesce(1).mapInArrow(build, TOLD), "upper")


def prefix_trie(rows: DataFrame, convs: DataFrame, width: int = 4096, shard_turns: int = 250_000, most_sent: int = 200_000) -> DataFrame:
    """NODE for every distinct sequence of first turns. rows: conv, depth (from 1, gapless), label, words; convs: conv
    and length of all conversations. A shard has about shard_turns distinct turns; up to most_sent upper nodes are sent to every
    task for their children's sake, more are joined by shuffle."""
    spark = rows.sparkSession
    groups, top = _groups(rows, convs, width)
    if top is None:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE))
    nodes, deeper = [], None
    sizes = {r["band"]: r["n"] for r in groups.groupBy("band").agg(F.sum(F.size("words") + 1).alias("n")).collect()}  # one row a band
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for band in range(top, -1, -1):
        own = groups.filter(F.col("band") == band)
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        if deeper is None:
            own = own.withColumns({c: F.lit(0).cast("long") for c in ("x_children", "x_leaves", "x_saved")})
        else:
            below = deeper.select(F.col("name").alias("next"), F.col("children").alias("x_children"), F.col("leaves").alias("x_leaves"), F.col("saved").alias("x_saved"))
            own = own.join(below, "next", "left").withColumns({c: zero(F.col(c)) for c in ("x_children", "x_leaves", "x_saved")})
        if band:
            over = groups.filter(F.col("band") == band - 1).select(F.col("next").alias("start"), F.col("conv").alias("root_conv"))
            own = own.join(over, "start")
        else:
            own = own.withColumn("root_conv", F.lit(0).cast("long"))
        told = stage(_tell(own, max(least, -(-sizes[band] // shard_turns)), band * width), "shards")
        upper = _merged(told, band * width)
        lent = upper.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv"))
        lent = F.broadcast(lent) if upper.count() <= most_sent else lent
        below = told.filter(F.col("kind") == BELOW).drop("parent_conv").join(lent, "parent")
        nodes += [x.select(*_columns()) for x in (told.filter(F.col("kind") == WHOLE), below, upper.filter(F.col("kind") == WHOLE))]
        if band:
            columns = ("name", "children", "leaves", "saved")
            deeper = told.filter(F.col("kind") == ROOT).select(*columns).unionByName(upper.filter(F.col("kind") == ROOT).select(*columns))
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    return out


def _columns() -> list[Column]:
    names = ("conv", "depth", "parent_conv", "n", "children", "leaves", "saved")
    return [*(F.col(c).alias(as_) for c, as_ in zip(names, NODE)), F.coalesce("ends", F.lit(NONE)).alias("ends_sha256")]


def oracle(crc: str) -> str:
    """The contract's nodes in SQL; crc: CRC-32 of a decimal."""
    return rf"""
WITH o AS (SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS label, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
     p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, label) - 1 AS place FROM o),
     k AS (SELECT DISTINCT c, c - c % 20 AS f, {crc} % 4 AS h FROM o),
     r AS (SELECT k.c, place, label, words FROM k JOIN p ON p.c = k.f WHERE place < h UNION ALL SELECT k.c, place + 4, label, words FROM k JOIN p ON p.c = k.c WHERE place >= h),
     s AS (SELECT k.c, coalesce(list(label ORDER BY place) FILTER (WHERE label IS NOT NULL), []) AS labels, coalesce(list(words ORDER BY place) FILTER (WHERE label IS NOT NULL), []) AS words FROM k LEFT JOIN r ON r.c = k.c GROUP BY k.c),
     m AS (SELECT c, d, array_to_string(labels[1:d], ',') AS key, array_to_string(labels[1:d - 1], ',') AS above, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words, d = len(labels) AS ends FROM (SELECT *, unnest(range(len(labels) + 1)) AS d FROM s)),
     n AS (SELECT d, key, min(above) AS above, min(c) AS conv_id, count(*) AS n_convs, min(words) AS words, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends) AS ends FROM m GROUP BY d, key),
     b AS (SELECT d, key, n_convs, words, NOT EXISTS (SELECT 1 FROM n x WHERE x.d = n.d + 1 AND x.above = n.key) AS leaf FROM n),
     t AS (SELECT u, substr(key, 1, greatest(33 * u - 1, 0)) AS key, CAST(sum(CAST(leaf AS INT)) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS u FROM b) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, a.conv_id AS parent_conv_id, n.n_convs, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.above = n.key) AS n_children, n_leaves, saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN t ON t.u = n.d AND t.key = n.key LEFT JOIN n a ON a.d = n.d - 1 AND a.key = n.above
"""
