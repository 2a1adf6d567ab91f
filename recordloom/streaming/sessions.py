"""Session state on streams: cadence under a lock that expires, corrections under a limit, closing by timer.

One processor keeps three values for each session, each with its own end: the window's counters go when the session
has been idle, the lock goes when its run is done or its time is over, and the number of prompts and the last correction never go.
Times are event times, so a stream gives the same rows however its events are cut into batches, across restarts, and as batch().

Events: session_id, event_id, at (timestamp), kind (prompt, tool, done), label (of a correction, else null), text
(scrubbed). classified() makes label and text: scrubbed whole first, then cut, so that a cut leaves no part of a secret.
Rows out: run (an extraction may start), lock_busy (its time had come, but one is running), correction (text is kept),
rate_limited, closed (n is the number of prompts so far). An event later than the watermark is dropped, as in any event-time operator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T

OUT = "session_id long, event_id long, outcome string, n long, text string"
WINDOW, FOREVER, LOCK = "turns int, tools int, runs int, last long", "prompts long, corrected long", "until long"


@dataclass(frozen=True)
class Rules:
    """Times are in milliseconds. A run starts at `turns` turns or `tools` tools, with `least` turns at least and fewer than `runs` runs."""

    turns: int = 10
    tools: int = 15
    least: int = 3
    runs: int = 20
    gap: int = 3
    lock: int = 600_000
    idle: int = 1_800_000


@dataclass
class Session:
    turns: int = 0
    tools: int = 0
    runs: int = 0
    last: int = -1
    prompts: int = 0
    corrected: int = 0
    until: int = -1

    def close(self) -> tuple:
        """Ends the window; what never goes stays."""
        self.turns = self.tools = self.runs = 0
        self.last = self.until = -1
        return None, "closed", self.prompts, None

    def take(self, event_id: int, at: int, kind: str, label: str | None, text: str | None, rules: Rules) -> Iterator[tuple]:
        """(event_id, outcome, n, text) of what one event brings about."""
        if self.last >= 0 and at - self.last >= rules.idle:
            yield self.close()
        self.last = max(self.last, at)
        if kind == "done":
            self.until = -1
            return
        if kind == "prompt":
            self.turns, self.prompts = self.turns + 1, self.prompts + 1
            if label is not None:
                if not self.corrected or self.prompts - self.corrected >= rules.gap:
                    self.corrected = self.prompts
                    yield event_id, "correction", self.prompts, text
                else:
                    yield event_id, "rate_limited", self.prompts, None
        else:
            self.tools += 1
        if (self.turns >= rules.turns or self.tools >= rules.tools) and self.turns >= rules.least and self.runs < rules.runs:
            self.turns = self.tools = 0  # a full window must build up again, whatever comes of this one
            if self.until > at:
                yield event_id, "lock_busy", self.runs, None
            else:
                self.runs, self.until = self.runs + 1, at + rules.lock
                yield event_id, "run", self.runs, None


def classified(events: DataFrame, text: Column, most: int = 2000) -> DataFrame:
    """session_id, event_id, at, kind with label and the text to keep."""
    said = F.when(F.col("kind") == "prompt", text)
    label = T.correction_label(said)
    return events.select("session_id", "event_id", "at", "kind", label.alias("label"), F.when(label.isNotNull(), F.substring(T.scrub(said), 1, most)).alias("text"))


def _folded(session: Session, key: int, events: pd.DataFrame, rules: Rules) -> list[tuple]:
    out = []
    for r in events.sort_values(["at", "event_id"]).itertuples():
        said = (None if pd.isna(r.label) else r.label), (None if pd.isna(r.text) else r.text)
        out += [(key, *x) for x in session.take(int(r.event_id), int(r.at.value // 1_000_000), r.kind, *said, rules)]
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["session_id", "event_id", "outcome", "n", "text"])
    return out.astype({"session_id": "Int64", "event_id": "Int64", "n": "Int64", "outcome": "object", "text": "object"})


class SessionProcessor(StatefulProcessor):
    def __init__(self, rules: Rules = Rules()):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window, self.forever, self.lock = (handle.getValueState(name, schema) for name, schema in (("window", WINDOW), ("forever", FOREVER), ("lock", LOCK)))

    def _load(self) -> Session:
        s = Session()
        if self.window.exists():
            s.turns, s.tools, s.runs, s.last = self.window.get()
        if self.forever.exists():
            s.prompts, s.corrected = self.forever.get()
        if self.lock.exists():
            (s.until,) = self.lock.get()
        return s

    def _store(self, s: Session) -> None:
        self.forever.update((int(s.prompts), int(s.corrected)))
        if s.last >= 0:
            self.window.update((int(s.turns), int(s.tools), int(s.runs), int(s.last)))
        else:
            self.window.clear()
        if s.until >= 0:
            self.lock.update((int(s.until),))
        else:
            self.lock.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self._load()
        before = s.last
        out = _folded(s, int(key[0]), pd.concat(list(rows)), self.rules)
        self._store(s)
        if s.last != before:  # one timer a session: for the end of its idle time
            if before >= 0:
                self.handle.deleteTimer(before + self.rules.idle)
            self.handle.registerTimer(s.last + self.rules.idle)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        out = [(int(key[0]), *s.close())] if s.last >= 0 else []
        self._store(s)
        yield _frame(out)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for r in initialState.itertuples():
            self.forever.update((int(r.prompts), int(r.corrected)))

    def close(self) -> None:
        pass


def stream(events: DataFrame, rules: Rules = Rules(), late: str = "10 minutes", before: DataFrame | None = None) -> DataFrame:
    """The rows as a stream of events goes by. before: session_id, prompts, corrected that a new query begins with. The
    session must use the RocksDB state store."""
    known = None if before is None else before.groupBy("session_id")
    return events.withWatermark("at", late).groupBy("session_id").transformWithStateInPandas(SessionProcessor(rules), OUT, "Append", "EventTime", initialState=known)


def batch(events: DataFrame, rules: Rules = Rules(), until: int | None = None) -> DataFrame:
    """The same of a whole table of events; sessions that have been idle by `until` (milliseconds) are closed, all if none is given."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = Session()
        out = _folded(s, int(key[0]), pdf, rules)
        if s.last >= 0 and (until is None or s.last + rules.idle <= until):
            out.append((int(key[0]), *s.close()))
        return _frame(out)

    return events.groupBy("session_id").applyInPandas(fold, OUT)
