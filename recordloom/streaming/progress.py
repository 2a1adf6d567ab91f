"""Incremental session state: counters, cadence and rate limits as keyed streaming state, and event-time rollups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "turns int, tools int, runs int, prompts long"
FIRED = "session_id long, event_id long, run int, turns int, tools int"


def step(state: tuple[int, int, int, int], is_turn: bool) -> tuple[tuple[int, int, int, int], bool]:
    """One event on (turns, tools, runs, prompts). A run fires at 10 turns or 15 tools, with 3 turns at least and under
    20 runs; firing resets the window's counters, never the prompts."""
    turns, tools, runs, prompts = state
    turns, tools, prompts = turns + is_turn, tools + (not is_turn), prompts + is_turn
    if (turns >= 10 or tools >= 15) and turns >= 3 and runs < 20:
        return (0, 0, runs + 1, prompts), True
    return (turns, tools, runs, prompts), False


def _advance(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, out = state.get if state.exists else (0, 0, 0, 0), []
    events = pd.concat(list(pdfs)).sort_values("event_id")
    for event, is_turn in zip(events["event_id"], events["is_turn"]):
        before = now
        now, fired = step(tuple(int(x) for x in now), bool(is_turn))
        if fired:
            out.append((int(key[0]), int(event), now[2], before[0] + int(is_turn), before[1] + int(not is_turn)))
    state.update(now)
    yield pd.DataFrame(out, columns=["session_id", "event_id", "run", "turns", "tools"])


def cadence(events: DataFrame) -> DataFrame:
    """A row whenever a session's cadence fires; works on streams (session_id, event_id, is_turn)."""
    return events.groupBy("session_id").applyInPandasWithState(_advance, FIRED, STATE, "append", GroupStateTimeout.NoTimeout)


def cadence_batch(events: DataFrame) -> DataFrame:
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = (0, 0, 0, 0), []
        for r in pdf.sort_values("event_id").itertuples():
            before = state
            state, fired = step(state, bool(r.is_turn))
            if fired:
                out.append((r.session_id, r.event_id, state[2], before[0] + int(r.is_turn), before[1] + int(not r.is_turn)))
        return pd.DataFrame(out, columns=["session_id", "event_id", "run", "turns", "tools"])

    return events.groupBy("session_id").applyInPandas(fold, FIRED)


def correction_gate(prompts: DataFrame, gap: int = 3) -> DataFrame:
    """Corrections that are let through: the first, then one once `gap` prompts have passed. prompts: session_id, n
    (1, 2, ...), is_correction."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        last, out = None, []
        for r in pdf.sort_values("n").itertuples():
            if r.is_correction and (last is None or r.n - last >= gap):
                last = r.n
                out.append((r.session_id, r.n))
        return pd.DataFrame(out, columns=["session_id", "n"])

    return prompts.groupBy("session_id").applyInPandas(fold, "session_id long, n long")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Extension: counts for each event type and window; rows later than the watermark are dropped in streams."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ts.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: activity sessions of each user."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ts.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


GATE = "n long, last long"


def _gate(gap: int):
    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, -1)
        out = []
        for r in pd.concat(list(pdfs)).sort_values("event_id").itertuples():
            n += 1
            if r.is_correction and (last < 0 or n - last >= gap):
                last = n
                out.append((int(key[0]), int(n)))
        state.update((int(n), int(last)))
        yield pd.DataFrame(out, columns=["session_id", "n"])

    return run


def correction_gate_stream(prompts: DataFrame, gap: int = 3) -> DataFrame:
    """correction_gate() on streams (session_id, event_id, is_correction): the prompts' count is keyed state."""
    return prompts.groupBy("session_id").applyInPandasWithState(_gate(gap), "session_id long, n long", GATE, "append", GroupStateTimeout.NoTimeout)


def unread(messages: DataFrame, cursor: DataFrame) -> DataFrame:
    """Messages (session_id, offset) past their session's cursor (session_id, last); all, if it has none."""
    own = cursor.select(F.col("session_id").alias("_s"), "last")
    joined = messages.join(own, F.col("session_id") == F.col("_s"), "left")
    return joined.filter(F.col("offset") > F.coalesce("last", F.lit(-1))).select(*messages.columns)


def advanced(cursor: DataFrame, read: DataFrame, failed: DataFrame) -> DataFrame:
    """The cursor after a run: sessions that succeeded stand at their last message, failed ones (session_id) stay."""
    new = read.join(failed.select("session_id").distinct(), "session_id", "left_anti").groupBy("session_id").agg(F.max("offset").alias("_new"))
    return cursor.join(new, "session_id", "full_outer").select("session_id", F.greatest("last", "_new").alias("last"))


def append_once(path: str, keys: list[str]):
    """A foreachBatch sink that may see a batch again: rows whose keys the table at path holds are left out, and so are
    a batch's own repeats."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            new = new.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
        new.write.mode("append").parquet(path)

    return write
