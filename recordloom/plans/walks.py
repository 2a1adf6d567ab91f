"""Registered queries over trees, ranges, SQLite files and session state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ranges import range_join
from ..sources import adapter as A
from ..sources import store, trees
from ..sources.sqlite import SqliteSource
from ..streaming import sessions
from .catalog import M, R, _query

#: A tree over each conversation's turns: every fourth turn (by conversation) hangs from the turn two before, so that the one between is a branch left.
_TREE = "SELECT c.conv_id, c.turn, c.role, c.text, CASE WHEN (c.conv_id + c.turn) % 4 = 0 AND c.turn - 2 >= lo THEN c.turn - 2 WHEN c.turn > lo THEN c.turn - 1 END AS parent, hi FROM conversations c JOIN (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY conv_id) b ON b.conv_id = c.conv_id"
_WALK = f"RECURSIVE t AS ({_TREE}), w AS (SELECT conv_id, turn, parent, role, text, 0 AS up FROM t WHERE turn = hi UNION ALL SELECT t.conv_id, t.turn, t.parent, t.role, t.text, up + 1 FROM w JOIN t ON t.conv_id = w.conv_id AND t.turn = w.parent)"


def _tree(spark, d):
    c = A.table(spark, d, "conversations")
    span = c.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    up = F.when(((F.col("conv_id") + F.col("turn")) % 4 == 0) & (F.col("turn") - 2 >= F.col("lo")), F.col("turn") - 2).when(F.col("turn") > F.col("lo"), F.col("turn") - 1)
    return c.join(span, "conv_id").withColumn("parent", up)


def _exports(spark, d):
    """Those trees as export files of one conversation each: the nodes as a map, the current node the last turn."""
    message = F.struct(F.struct("role").alias("author"), (F.col("turn") * 60).alias("create_time"), F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts")).alias("content"))
    node = F.struct(F.col("parent").cast("string").alias("parent"), message.alias("message"))
    maps = _tree(spark, d).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), node))).alias("mapping"), F.max("hi").cast("string").alias("current_node"))
    conv = F.struct(F.concat(F.lit("c"), "conv_id").alias("id"), F.concat(F.lit("talk "), "conv_id").alias("title"), "current_node", "mapping")
    return maps.select(F.concat(F.lit("/in/"), "conv_id", F.lit(".json")).alias("path"), F.to_json(F.array(conv)).alias("payload"))


@_query(f"WITH {_WALK} SELECT 'c' || conv_id AS session_id, 'talk ' || conv_id AS title, max(up) OVER (PARTITION BY conv_id) - up AS ordinal, role, CAST(turn * 60 AS DOUBLE) AS ts, text AS content FROM w WHERE role IN ('user', 'assistant', 'system') AND regexp_matches(text, '[^\\s]')")
def tree_sessions(spark, d):
    return trees.chat_sessions(_exports(spark, d))


_DOWN = f"RECURSIVE t AS ({_TREE}), n AS (SELECT conv_id, parent, max(turn) AS turn FROM t GROUP BY conv_id, parent), w AS (SELECT conv_id, turn, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.conv_id, n.turn, depth + 1 FROM w JOIN n ON n.conv_id = w.conv_id AND n.parent = w.turn)"


@_query(f"WITH {_DOWN} SELECT CAST(conv_id AS VARCHAR) AS path, CAST(turn AS VARCHAR) AS id, CAST(depth AS INTEGER) AS depth FROM w")
def tree_log_branch(spark, d):
    entries = _tree(spark, d).select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line"), F.col("turn").cast("string").alias("id"), F.col("parent").cast("string").alias("parent"))
    return trees.active_branch(entries).select("path", "id", "depth")


_RANGES = f"SELECT id AS entry, id * 7919 % 99000 AS range_start, id * 7919 % 99000 + (id * id) % 5000 AS range_end FROM {R}"


@_query(f"SELECT entry, count(id) AS n, min(id) AS first, max(id) AS last FROM ({_RANGES}) e JOIN {M} m ON id BETWEEN range_start AND range_end GROUP BY entry")
def message_ranges(spark, d):
    """Messages of each curated entry's range, by their ids alone."""
    rows = A.records(spark, d)
    start = F.col("id") * 7919 % 99000
    entries = rows.select(F.col("id").alias("entry"), start.alias("range_start"), (start + F.col("id") * F.col("id") % 5000).alias("range_end"))
    met = range_join(A.messages(spark, d).select("id"), entries, "id", "range_start", "range_end")
    return met.groupBy("entry").agg(F.count("id").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@_query(f"SELECT id, text, project, importance, provenance FROM {R}")
def sqlite_copy(spark, d):
    """The curated records through SQLite files and back."""
    spark.dataSource.register(SqliteSource)
    rows = A.records(spark, d).select("id", "text", "project", "importance", "provenance")
    path = f"{store.shared_dir(spark)}/recordloom-sqlite/{store.version_of(A.table(spark, d, 'documents'))}"
    rows.write.format("recordloom-sqlite").option("path", path).option("table", "records").mode("overwrite").save()
    back = spark.read.format("recordloom-sqlite").option("path", path).option("table", "records").schema(rows.schema).load()
    return back


#: Events as session events: every 97th ends a run; a prompt's label stands for the classifier's.
_EVENTS = "SELECT user_id AS session_id, event_id, ts, CASE WHEN event_id % 97 = 0 THEN 'done' WHEN event_type IN ('view', 'click') THEN 'prompt' ELSE 'tool' END AS kind, event_type = 'click' AND event_id % 3 = 0 AS fixes FROM events"
_STATE = f"""WITH RECURSIVE e AS (SELECT *, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY session_id ORDER BY epoch_ms(ts), event_id) AS i FROM ({_EVENTS})),
  w AS (SELECT session_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, 0 AS turns, 0 AS tools, 0 AS runs, CAST(-1 AS BIGINT) AS last, 0 AS prompts, 0 AS corrected, CAST(-1 AS BIGINT) AS until, FALSE AS closed, 0 AS shut, FALSE AS fixes, FALSE AS kept, FALSE AS fired, FALSE AS busy FROM (SELECT DISTINCT session_id FROM e)
    UNION ALL SELECT session_id, i, event_id, CASE WHEN fired THEN 0 ELSE turns END, CASE WHEN fired THEN 0 ELSE tools END, CASE WHEN fired AND NOT busy THEN runs + 1 ELSE runs END, ms, prompts, CASE WHEN kept THEN prompts ELSE corrected END,
           CASE WHEN kind = 'done' THEN -1 WHEN fired AND NOT busy THEN ms + 600000 ELSE until END, closed, shut, fixes, kept, fired, busy
    FROM (SELECT *, kind <> 'done' AND (turns >= 10 OR tools >= 15) AND turns >= 3 AND runs < 20 AS fired, until > ms AS busy, fixes AND (corrected = 0 OR prompts - corrected >= 3) AS kept
      FROM (SELECT e.session_id, e.i, e.event_id, e.ms, e.kind, e.kind = 'prompt' AND e.fixes AS fixes, w.corrected, w.prompts + CAST(e.kind = 'prompt' AS INT) AS prompts, w.prompts AS shut, w.last >= 0 AND e.ms - w.last >= 1800000 AS closed,
                   CASE WHEN w.last >= 0 AND e.ms - w.last >= 1800000 THEN 0 ELSE w.turns END + CAST(e.kind = 'prompt' AS INT) AS turns, CASE WHEN w.last >= 0 AND e.ms - w.last >= 1800000 THEN 0 ELSE w.tools END + CAST(e.kind = 'tool' AS INT) AS tools,
                   CASE WHEN w.last >= 0 AND e.ms - w.last >= 1800000 THEN 0 ELSE w.runs END AS runs, CASE WHEN w.last >= 0 AND e.ms - w.last >= 1800000 THEN -1 ELSE w.until END AS until
            FROM w JOIN e ON e.session_id = w.session_id AND e.i = w.i + 1)))
  SELECT session_id, CAST(NULL AS BIGINT) AS event_id, 'closed' AS outcome, CAST(shut AS BIGINT) AS n FROM w WHERE closed
  UNION ALL SELECT session_id, NULL, 'closed', prompts FROM w WHERE i > 0 AND i = (SELECT max(i) FROM e WHERE e.session_id = w.session_id)
  UNION ALL SELECT session_id, event_id, CASE WHEN kept THEN 'correction' ELSE 'rate_limited' END, prompts FROM w WHERE fixes
  UNION ALL SELECT session_id, event_id, CASE WHEN busy THEN 'lock_busy' ELSE 'run' END, runs FROM w WHERE fired"""


@_query(_STATE)
def session_outcomes(spark, d):
    """Cadence, lock, limit and closing of all sessions of the events, as the stream gives them."""
    e = A.table(spark, d, "events")
    kind = F.when(F.col("event_id") % 97 == 0, "done").when(F.col("event_type").isin("view", "click"), "prompt").otherwise("tool")
    fixes = (kind == "prompt") & (F.col("event_type") == "click") & (F.col("event_id") % 3 == 0)
    events = e.select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), F.when(fixes, "fix").alias("label"), F.lit(None).cast("string").alias("text"))
    return sessions.batch(events).select("session_id", "event_id", "outcome", "n")
