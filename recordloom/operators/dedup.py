"""Non-destructive duplicate marking: exact groups, survivors, semantic pairs, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise
from . import rounds

#: From the most to the least trusted; null last.
PROVENANCE = ("user_authored", "verbatim", "extracted", "derived")


def provenance_rank(c: Column) -> Column:
    out = F.when(c == PROVENANCE[0], 0)
    for i, p in enumerate(PROVENANCE[1:], 1):
        out = out.when(c == p, i)
    return out.otherwise(len(PROVENANCE))


def candidates(rows: DataFrame, text: Column, least: int = 20) -> DataFrame:
    """Rows whose normal form has `least` characters, with key (its hash) and length of the text. The normal form passes
    through a one-row generator, so that it is made once and not in every place that reads it."""
    held = rows.withColumn("_t", F.explode(F.array(F.struct(normalise(text).alias("n"), F.length(text).alias("chars")))))
    fit = held.filter(F.length("_t.n") >= least)
    return fit.withColumn("key", F.sha2("_t.n", 256)).withColumn("chars", F.col("_t.chars")).drop("_t")


def survivor_order() -> list[Column]:
    """Trust, longer text, importance (5 if null), newer, lower id."""
    return [provenance_rank(F.col("provenance")), F.desc("chars"), F.desc(F.coalesce("importance", F.lit(5))), F.desc("minute"), F.col("id")]


def _order_struct() -> Column:
    """survivor_order() as one value whose least is the survivor's."""
    newer = lambda c: F.coalesce(-F.col(c).cast("double"), F.lit(float("inf")))
    return F.struct(provenance_rank(F.col("provenance")).alias("p"), newer("chars").alias("c"), (-F.coalesce("importance", F.lit(5))).alias("i"), newer("minute").alias("m"), F.col("id").alias("id"))


def plan_exact(rows: DataFrame, kept: DataFrame | None = None, marked: DataFrame | None = None) -> DataFrame:
    """table, survivor, id (the duplicate): in each (table, project, key) the first by survivor_order stays. Rows that
    earlier runs recorded as survivors (kept: id) never become duplicates, and rows marked before (marked: id) take no
    part, so that a later deletion does not reach them. A group's survivor comes from an aggregate, which splits a
    group of any size, and only groups of two and more meet their rows again."""
    if marked is not None:
        rows = rows.join(marked.select("id").distinct(), "id", "left_anti")
    own = rows.select("table", F.coalesce("project", F.lit("")).alias("project"), "key", "id", _order_struct().alias("o"))
    groups = own.groupBy("table", "project", "key").agg(F.count("*").alias("n"), F.min("o").alias("best")).filter("n > 1")
    out = own.join(groups, ["table", "project", "key"]).select("table", F.col("best.id").alias("survivor"), "id").filter("id <> survivor")
    if kept is not None:
        out = out.join(kept.select("id").distinct(), "id", "left_anti")
    return out


def sticky_skipped(rows: DataFrame, kept: DataFrame) -> int:
    """How many rows would be duplicates but are recorded survivors."""
    return plan_exact(rows).join(kept.select("id").distinct(), "id", "left_semi").count()


def cross_table(rows: DataFrame) -> DataFrame:
    """Keys that several tables share in a project: a report, nothing is marked."""
    return rows.groupBy("project", "key").agg(F.array_sort(F.collect_set("table")).alias("tables"), F.count("*").alias("n")).filter(F.size("tables") >= 2)


def edges(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) with the row to keep and the one to drop."""
    order = rows.select("id", _order_struct().alias("o"))
    a, b = (order.select(F.col("id").alias(c), F.col("o").alias(f"o{c}")) for c in "ab")
    worse = F.col("ob") < F.col("oa")
    keep, drop = F.when(worse, F.col("b")).otherwise(F.col("a")), F.when(worse, F.col("a")).otherwise(F.col("b"))
    return pairs.join(a, "a").join(b, "b").withColumns({"keep": keep, "drop": drop}).drop("oa", "ob")


def mark_greedily(pairs: DataFrame, rows: DataFrame, finish: int = 100_000) -> DataFrame:
    """survivor, id, similarity: strongest pair first; the worse row of a pair is marked unless either side is a duplicate
    or (as the one to be marked) a survivor already. Pairs (a, b, similarity) are the sparse list above the threshold."""
    return rounds.marks(edges(pairs, rows), finish)


def apply_marks(lineage: DataFrame, plan: DataFrame, reason: str) -> DataFrame:
    """The lineage with the plan's marks appended."""
    return lineage.unionByName(plan.select(F.col("survivor").alias("survivor_id"), F.col("id").alias("duplicate_id"), F.lit(reason).alias("reason"), F.lit("marked").alias("status")))


def visible(rows: DataFrame, lineage: DataFrame) -> DataFrame:
    marked = lineage.filter("status = 'marked'").select(F.col("duplicate_id").alias("id")).distinct()
    return rows.join(marked, "id", "left_anti")


def delete_duplicates(rows: DataFrame, plan: DataFrame, lineage: DataFrame) -> DataFrame:
    """Rows without the planned duplicates; refused if one of them is a recorded survivor."""
    recorded = lineage.filter("status IN ('marked', 'deleted')").select(F.col("survivor_id").alias("id"))
    if not plan.join(recorded, "id", "left_semi").isEmpty():
        raise ValueError("a planned duplicate is a recorded survivor")
    return rows.join(plan.select("id"), "id", "left_anti")
