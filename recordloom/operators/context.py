"""A context in one call: what a task needs, found by keywords and vectors, with the newest and best records and a hint.

The driver keeps two small things between calls: vectors of the last queries, so that a repeated query is not embedded
again, and whether the embedding service answered lately. Without the service the keyword list alone is fused, so the
score keeps its unit, and the tier says so."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hybrid, records


class QueryVectors:
    """Vectors of the `most` last asked queries, for each model; the least lately asked goes first. What fails is not kept."""

    def __init__(self, embedder: Callable[[str], list[float]], model: str = "model", most: int = 256):
        self.embedder, self.model, self.most = embedder, model, most
        self.held: OrderedDict[tuple[str, str], list[float]] = OrderedDict()

    def __call__(self, query: str) -> list[float]:
        key = (self.model, query)
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        vector = list(self.embedder(query))
        self.held[key] = vector
        if len(self.held) > self.most:
            self.held.popitem(last=False)
        return vector


class Lately:
    """An answer that is asked for again only after `seconds`; a check that fails counts as no."""

    def __init__(self, check: Callable[[], bool], seconds: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.check, self.seconds, self.clock = check, seconds, clock
        self.until, self.said = float("-inf"), False

    def __call__(self) -> bool:
        if self.clock() >= self.until:
            try:
                self.said = bool(self.check())
            except Exception:
                self.said = False
            self.until = self.clock() + self.seconds
        return self.said


def gather(task: str, keyword: DataFrame, near: Callable[[list[float]], DataFrame], docs: DataFrame, curated: DataFrame, decisions: DataFrame, vectors: QueryVectors | None = None, alive: Callable[[], bool] | None = None, limit: int = 5, few: int = 3) -> tuple[DataFrame, str]:
    """(part, place, line) and the tier that answered (hybrid or keyword). keyword: table, id, rank of the task's words;
    near: table, id, similarity of a query's vector; docs as hybrid.search_docs(); curated: id, minute, title; decisions:
    id, created, status, confidence, decision. The hint, why the task should also look in the web, is a row where there is one."""
    spark, tier, close = keyword.sparkSession, "keyword", None
    if vectors is not None and (alive is None or alive()):
        try:
            close = near(vectors(task))
            tier = "hybrid"
        except Exception:  # an embedding that fails leaves the keywords
            close = None
    if close is None:
        close = spark.createDataFrame([], "table string, id long, similarity double")
    found = hybrid.hybrid(keyword, close, docs, limit).collect()  # `limit` rows
    key = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "low", 2).otherwise(1)
    newest = curated.orderBy(F.desc("minute"), F.desc("id")).limit(few).select("title").collect()
    best = decisions.filter("status = 'active'").orderBy(key, F.desc("created"), F.desc("id")).limit(few).select("id", "decision").collect()
    rows = [("relevant", i, f"{r['table']}#{r['id']}") for i, r in enumerate(found)] + [("curated", i, r["title"]) for i, r in enumerate(newest)] + [("decisions", i, f"{r['decision']} {r['id']}") for i, r in enumerate(best)]
    out = spark.createDataFrame(rows, "part string, place int, line string")
    hint = spark.range(1).select(F.lit("hint").alias("part"), F.lit(0).alias("place"), records.web_hint(F.lit(task), F.lit(len(found))).alias("line"))
    return out.unionByName(hint.filter("line IS NOT NULL")), tier
