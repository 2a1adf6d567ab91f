"""Multi-party perspective rotation of dialogues, by DataFrame functions alone.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, the others as named
users, and a mask that trains on the assistant's words only. System turns stay system turns and are nobody's perspective.

A dialogue of more than `turns_per_part` turns comes in consecutive parts, so that no task holds a whole conversation
however long it is: a perspective's parts, joined in order, are its whole dialogue, and their masks joined by commas are
its mask, whatever the size of the parts. Parts are cut by a turn's place in its conversation, not by its number: the
turns are sorted over all tasks, and a turn's place is its place in its task after the turns that earlier tasks hold.

Text and names cannot forge a turn: a backslash goes into every `<|` and `|>` that they hold (after the first sign, and
after any backslashes there), and line ends in names become blanks; taking one backslash out restores them.

A null role is the participant `unknown`; null text is empty; a null conv_id is a conversation of its own; turns without
a number come first. Equal turn numbers are ordered by role and text, so repeated rows give the same rendering each
time. A conversation of system turns alone has no perspective and no row; an empty table has none. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage


def _escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|"), r"\|(\\*)>", r"|$1\\>")


def _placed(turns: DataFrame, speakers: DataFrame) -> DataFrame:
    """conv, role, text, speakers and the place of each turn in its conversation, from 0. Only counts for each
    conversation and task meet in a window: as many rows of one conversation as there are tasks. The speakers come with
    those, so the texts need no further join; a conversation without speakers is left out."""
    order = ["conv", "turn", "role", "text"]
    # Rows that agree on all of these are alike, so it does not matter which comes first.
    dealt = turns.repartitionByRange("conv", "turn", "role", F.xxhash64("text")).sortWithinPartitions(*order)
    kept = stage(dealt.select(*order, F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("id")), "turns")
    stretches = kept.groupBy("conv", "task").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv").orderBy("task")) - F.col("n")
    begun = stretches.select(F.col("conv").alias("conv_"), F.col("task").alias("task_"), (F.col("first") - before).alias("zero"))
    begun = begun.join(speakers, F.col("conv_").eqNullSafe(F.col("of")))
    # One row of `begun` for each conversation of a task, so no key has more rows than a task.
    joined = kept.join(begun, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("task") == F.col("task_")))
    return joined.select("conv", "role", "text", "speakers", (F.col("id") - F.col("zero")).alias("place"))


def rotate(turns: DataFrame, turns_per_part: int = 1024, system: str = "system") -> DataFrame:
    """Returns conv_id, part (from 0), perspective, text, mask (lengths of the text's pieces in code points, each with 1
    if trained on, `length:flag` joined by commas), n_turns, n_trained, n_chars."""
    clean = turns.select(F.col("conv_id").alias("conv"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    speakers = clean.filter(F.col("role") != system).groupBy(F.col("conv").alias("of")).agg(F.array_sort(F.collect_set("role")).alias("speakers"))
    placed = _placed(clean, speakers)
    parts = (
        placed.withColumn("part", F.floor(F.col("place") / turns_per_part).cast("long"))
        .groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"), F.first("speakers").alias("speakers"))
        .withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), _escaped(t["text"]).alias("text"))))
    )
    seats = parts.select("conv", "part", "turns", F.explode("speakers").alias("perspective"))

    name = lambda role: _escaped(F.regexp_replace(role, r"[\r\n]", " "))
    head = lambda t: F.when(t["role"] == system, F.lit("<|system|>\n")).when(t["role"] == F.col("perspective"), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), name(t["role"]), F.lit("|>\n")))
    own = lambda t: (t["role"] == F.col("perspective")).cast("int")
    end = F.lit("<|end|>\n")
    text = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], end)), "")
    mask = F.array_join(F.transform("turns", lambda t: F.concat_ws(",", F.concat(F.length(head(t)).cast("string"), F.lit(":0")), F.concat((F.length(t["text"]) + F.length(end)).cast("string"), F.lit(":"), own(t).cast("string")))), ",")
    count = lambda f: F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + f(t))
    return seats.select(
        F.col("conv").alias("conv_id"), "part", "perspective", text.alias("text"), mask.alias("mask"), F.size("turns").cast("long").alias("n_turns"),
        count(own).alias("n_trained"), count(lambda t: F.length(head(t)) + F.length(t["text"]) + F.length(end)).alias("n_chars"),
    )


_SAFE = r"regexp_replace(regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g')"
ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
     n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM c),
     s AS (SELECT DISTINCT conv_id, role AS perspective FROM c WHERE role <> 'system'),
     r AS (SELECT n.conv_id, n.place // 1024 AS part, s.perspective, n.place, n.role, {_SAFE.format("n.text")} AS text,
                  CASE WHEN n.role = 'system' THEN '<|system|>' || chr(10) WHEN n.role = s.perspective THEN '<|assistant|>' || chr(10)
                       ELSE '<|user name=' || {_SAFE.format("regexp_replace(n.role, '[\r\n]', ' ', 'g')")} || '|>' || chr(10) END AS head
           FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id)
SELECT conv_id, part, perspective, string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY place) AS text,
       string_agg(length(head) || ':0,' || (length(text) + 8) || ':' || CASE WHEN role = perspective THEN '1' ELSE '0' END, ',' ORDER BY place) AS mask,
       count(*) AS n_turns, count(*) FILTER (WHERE role = perspective) AS n_trained, CAST(sum(length(head) + length(text) + 8) AS BIGINT) AS n_chars
FROM r GROUP BY conv_id, part, perspective
"""
