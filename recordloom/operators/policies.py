"""Budgets of a rendered context, guarded consolidation, evidence rules, and pruning by age and number."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import lifecycle


def days_of(text: str) -> int:
    """The number of days of `90d`."""
    if not re.fullmatch(r"[0-9]+d", text):
        raise ValueError(f"{text!r} is no number of days such as 90d")
    return int(text[:-1])


@dataclass(frozen=True)
class Budget:
    """Lengths in characters: of a preview, of the ranked part, of the whole; `least` lines stay whatever their length."""

    preview: int = 220
    identity: int = 1200
    ranked: int = 6000
    total: int = 8000
    least: int = 4


#: Headings and notes of a rendered context.
HEAD, IDENTITY, RANKED = "## Session memory (tiered)", "### L0: identity", "### L1: records by importance"
MORE, CUT = "_More is there on demand: recent records, keyword search, hybrid search._", "\n\n[truncated]"


def context_text(best: DataFrame, identity: str = "", project: str | None = None, budget: Budget = Budget()) -> DataFrame:
    """text, lines, kept of a context: identity, then a line for each of the best rows (place, table, id, project, importance, day,
    content), whose number a tiered context bounds. If the lines are over the ranked budget, the first max(least, n * budget /
    length) of them stay; what is then over the total is cut, with a note."""
    line = F.concat(
        F.lit("- **["), "table", F.lit("#"), F.col("id").cast("string"), F.lit("]** "), F.when(F.coalesce("project", F.lit("")) == "", "").otherwise(F.concat(F.lit("["), "project", F.lit("]"))), F.lit(" "),
        F.coalesce(F.concat(F.lit("★"), F.col("importance").cast("string")), F.lit("")), F.lit(" "), F.coalesce("day", F.lit("")), F.lit(": "),
        F.when(F.length("content") > budget.preview, F.concat(F.substring("content", 1, budget.preview), F.lit("…"))).otherwise(F.col("content")),
    )
    one = best.agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l")).select(F.col("l.line").alias("l"))
    n = F.size("l")
    whole = one.withColumn("ranked", F.when(n > 0, F.concat_ws("\n", F.lit(RANKED), F.array_join("l", "\n"))).otherwise(""))
    kept = F.when(F.length("ranked") > budget.ranked, F.greatest(F.lit(budget.least), F.floor(n * (F.lit(float(budget.ranked)) / F.length("ranked"))).cast("int"))).otherwise(n)
    shown = whole.withColumn("lines", n).withColumn("kept", F.least(kept, n)).withColumn("ranked", F.when(n > 0, F.concat_ws("\n", F.lit(RANKED), F.array_join(F.slice("l", 1, F.col("kept")), "\n"))).otherwise(""))
    own = identity[: budget.identity]
    before = [HEAD, *([f"**Project:** {project}"] if project else []), "", *([IDENTITY, own, ""] if own else [])]
    text = F.concat(F.lit("\n".join(before) + "\n"), F.when(F.col("ranked") != "", F.concat("ranked", F.lit("\n\n"))).otherwise(""), F.lit("---\n" + MORE))
    return shown.select(F.when(F.length(text) > budget.total, F.concat(F.substring(text, 1, budget.total), F.lit(CUT))).otherwise(text).alias("text"), "lines", "kept")


def consolidation_plan(rows: DataFrame, marked: DataFrame, survivors: DataFrame, days: int, before: int, threshold: int = 5, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Clusters as lifecycle.consolidate() makes them, of rows that are neither marked duplicates nor recorded survivors
    (id each), and one row: matched (old and unimportant), eligible, protected (those that a guard holds back)."""
    low = rows.filter((F.col("minute") < before) & (F.coalesce("importance", F.lit(5)) < min(threshold, 10)))
    held = marked.select("id").unionByName(survivors.select("id")).distinct().withColumn("_held", F.lit(True))
    told = low.join(held, "id", "left")
    free = told.filter("_held IS NULL").drop("_held")
    report = told.agg(F.count("*").alias("matched"), F.count_if(F.col("_held").isNull()).alias("eligible")).withColumn("protected", F.col("matched") - F.col("eligible"))
    return lifecycle.consolidate(free, days, before, threshold, least), report


#: table, value, category that is evidence for it (any row's, if none). Fixed values.
EVIDENCE = (("messages", "verbatim", None), ("curated", "extracted", None), ("decisions", "extracted", "auto-extracted"), ("learnings", "extracted", "auto-extracted"), ("breadcrumbs", "extracted", "extracted-idea"))


def provenance_rules(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """table, id, provenance of the rows (id, category, provenance) that a rule classifies, and for each table what the
    rules leave: value, unknown_before, classified, remaining. Known provenance never changes; none is guessed."""
    plans, reports = [], []
    for table, value, category in EVIDENCE:
        if table not in tables:
            continue
        unknown = tables[table].filter("provenance IS NULL")
        sure = F.lit(True) if category is None else F.coalesce(F.col("category") == category, F.lit(False))
        plans.append(unknown.filter(sure).select(F.lit(table).alias("table"), "id", F.lit(value).alias("provenance")))
        counts = unknown.agg(F.count("*").alias("unknown_before"), F.count_if(sure).alias("classified"))
        reports.append(counts.select(F.lit(table).alias("table"), F.lit(value).alias("value"), "unknown_before", "classified", (F.col("unknown_before") - F.col("classified")).alias("remaining")))
    plan, report = plans[0], reports[0]
    for p, r in zip(plans[1:], reports[1:]):
        plan, report = plan.unionByName(p), report.unionByName(r)
    return plan, report


def prune_tracker(tracker: DataFrame, now: Column, age: str) -> DataFrame:
    """path of the entries that were extracted over `age` (such as 180d) ago; entries never extracted stay."""
    return tracker.filter(F.col("extracted_at") < now - F.make_dt_interval(F.lit(days_of(age)))).select("path")


def prune_sessions_over(sessions: DataFrame, most: int = 500) -> DataFrame:
    """session_id of all but the newest `most`. The cut is found by a limit, so no window sorts the whole table."""
    newest = sessions.orderBy(F.desc("timestamp"), "session_id").limit(most)
    return sessions.join(newest.select("session_id"), "session_id", "left_anti").select("session_id")


def by_type(rows: DataFrame, each: int = 5) -> DataFrame:
    """type, n, codes: rows (code, type) grouped by their type, with the first codes of each."""
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy("type").orderBy("code")))
    return ranked.groupBy("type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= each, F.col("code")))), ",").alias("codes"))
