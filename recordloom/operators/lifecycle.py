"""Retention, ageing, consolidation, tiers, frecency, clustering and backfills. Time is always a parameter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rounds


def prune_messages(messages: DataFrame, curated_sessions: DataFrame, survivors: DataFrame, before: int) -> DataFrame:
    """Messages older than `before` of sessions that have a curated record, unless a recorded survivor."""
    return messages.filter(F.col("minute") < before).join(curated_sessions.select("session_id").distinct(), "session_id", "left_semi").join(survivors.select("id").distinct(), "id", "left_anti")


def prune_decisions(decisions: DataFrame, now: str, days: int, survivors: DataFrame | None = None) -> DataFrame:
    """Superseded and reverted decisions older than min(days, 90)."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(min(days, 90)))
    out = decisions.filter(F.col("status").isin("superseded", "reverted") & (F.col("created") < cutoff))
    return out if survivors is None else out.join(survivors.select("id").distinct(), "id", "left_anti")


def prune_sessions(sessions: DataFrame, messages: DataFrame, curated: DataFrame, before: int) -> DataFrame:
    return sessions.filter(F.col("minute") < before).join(messages.select("session_id").distinct(), "session_id", "left_anti").join(curated.select("session_id").distinct(), "session_id", "left_anti")


def plan_age(rows: DataFrame, guarded: DataFrame, delete_before: int, threshold: int = 5, pin: int = 10) -> DataFrame:
    """Old rows of importance under the threshold: matched, those that a guard protects, those eligible; pinned rows
    never match."""
    matched = rows.filter((F.col("minute") < delete_before) & (F.coalesce("importance", F.lit(5)) < threshold) & (F.coalesce("importance", F.lit(5)) < pin))
    guard = guarded.select(F.col("id").alias("g")).distinct()
    return matched.join(guard, F.col("id") == F.col("g"), "left").withColumn("protected", F.col("g").isNotNull()).drop("g")


def demote(rows: DataFrame, plan: DataFrame, floor: int = 1) -> DataFrame:
    """Importance of the planned rows goes down to the floor, never up: max(1, min(floor, importance))."""
    ids = plan.select(F.col("id").alias("p")).distinct()
    lower = F.greatest(F.lit(1), F.least(F.lit(floor), F.col("importance")))
    return rows.join(ids, F.col("id") == F.col("p"), "left").withColumn("importance", F.when(F.col("p").isNotNull(), lower).otherwise(F.col("importance"))).drop("p")


#: What ageing does to each table: action and, for a demotion, the floor. Fixed values.
AGEING = {"messages": ("delete", None), "breadcrumbs": ("expire", None), "decisions": ("demote", 1), "learnings": ("demote", 1), "curated": ("demote", 5)}


def plan_ageing(table: str, rows: DataFrame, guards: DataFrame, now: int, days: int = 180, horizon: int = 14, threshold: int = 5, pin: int = 10, curated_sessions: DataFrame | None = None) -> DataFrame:
    """id, importance, action, new_importance, protected of the rows that ageing reaches: old messages of curated
    sessions go, breadcrumbs past the horizon expire, old unimportant rows above their floor are demoted. Pinned rows
    never match; guards (id: survivors, marked duplicates, rows that others point at) protect."""
    action, floor = AGEING[table]
    if action == "expire":
        alive = F.col("expires_at").isNull() | (F.col("expires_at") > now)
        matched = rows.filter((F.col("minute") < now - horizon * 1440) & (F.col("importance") < pin) & alive)
    elif action == "demote":
        matched = rows.filter((F.col("minute") < now - days * 1440) & (F.col("importance") < threshold) & (F.col("importance") > floor))
    else:
        matched = rows.filter((F.col("minute") < now - days * 1440) & (F.col("importance") < pin)).join(curated_sessions.select("session_id").distinct(), "session_id", "left_semi")
    guard = guards.select(F.col("id").alias("_g")).distinct()
    joined = matched.join(guard, F.col("id") == F.col("_g"), "left")
    return joined.select("id", "importance", F.lit(action).alias("action"), F.lit(floor).cast("int").alias("new_importance"), F.col("_g").isNotNull().alias("protected"))


def apply_ageing(rows: DataFrame, plan: DataFrame, now: int) -> DataFrame:
    """The rows after the plan: deleted, expired now, or demoted to their floor."""
    own = plan.filter("NOT protected").select(F.col("id").alias("_p"), F.col("action").alias("_a"), F.col("new_importance").alias("_i"))
    out = rows.join(own, F.col("id") == F.col("_p"), "left").filter("_a IS NULL OR _a <> 'delete'")
    if "expires_at" in rows.columns:
        out = out.withColumn("expires_at", F.when(F.col("_a") == "expire", F.lit(now).cast(rows.schema["expires_at"].dataType)).otherwise(F.col("expires_at")))
    lower = F.greatest(F.lit(1), F.least("_i", "importance"))
    return out.withColumn("importance", F.when(F.col("_a") == "demote", lower).otherwise(F.col("importance"))).select(*rows.columns)


def set_importance(rows: DataFrame, ids: DataFrame, value: int | None, floor: int = 1, default: int = 5) -> DataFrame:
    """Pin or unpin: the value (None: the default) held in floor..10."""
    own, new = ids.select(F.col("id").alias("_p")).distinct(), max(floor, min(10, default if value is None else value))
    return rows.join(own, F.col("id") == F.col("_p"), "left").withColumn("importance", F.when(F.col("_p").isNotNull(), F.lit(new)).otherwise(F.col("importance"))).select(*rows.columns)


def add_record(rows: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """The rows and the new ones, which get the ids after the largest, in a total order. The batch is small: it is what
    one caller adds."""
    last = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    numbered = new.withColumn("_n", F.row_number().over(W.orderBy(*order))).join(F.broadcast(last))  # one number
    return rows.unionByName(numbered.withColumn("id", F.col("_last") + F.col("_n")).select(*rows.columns))


def delete_marked(rows: DataFrame, plan: DataFrame, lineage: DataFrame, embeddings: DataFrame, pointed_at: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows, lineage and embeddings after the planned duplicates (survivor, id) go. A planned duplicate that is a recorded
    survivor refuses it all; one that other rows point at (id) is only marked; embeddings go with their rows."""
    recorded = lineage.filter("status IN ('marked', 'deleted')").select(F.col("survivor_id").alias("id"))
    if not plan.join(recorded, "id", "left_semi").isEmpty():
        raise ValueError("a planned duplicate is a recorded survivor")
    held = pointed_at.select(F.col("id").alias("_f")).distinct()
    judged = plan.join(held, F.col("id") == F.col("_f"), "left").withColumn("status", F.when(F.col("_f").isNull(), "deleted").otherwise("marked"))
    gone = judged.filter("status = 'deleted'").select("id")
    entries = judged.select(F.col("survivor").alias("survivor_id"), F.col("id").alias("duplicate_id"), F.lit("exact").alias("reason"), "status")
    return rows.join(gone, "id", "left_anti"), lineage.unionByName(entries), embeddings.join(gone, "id", "left_anti")


def apply_consolidation(clusters: DataFrame, rows: DataFrame, summarize, accept, scrub, target: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entries, rows, skipped after each cluster (project, bucket, ids, text) is summarised by an injected function: a
    summary that is there and accepted becomes a derived entry of importance 5 that names its sources, which are
    demoted; others are skipped with a reason. Clusters are summarised where they lie, one call each."""
    import pandas as pd

    def run(parts):
        for pdf in parts:
            out = []
            for project, bucket, ids, text in zip(pdf["project"], pdf["bucket"], pdf["ids"], pdf["text"]):
                made = summarize(text)
                reason = "extraction_failed" if not made else None if accept(made) else "quality_failed"
                out.append((project, bucket, list(ids), None if reason else scrub(made), reason))
            yield pd.DataFrame(out, columns=["project", "bucket", "ids", "summary", "reason"])

    id_type = clusters.schema["ids"].dataType.simpleString()
    done = clusters.select("project", "bucket", "ids", "text").mapInPandas(run, f"project string, bucket long, ids {id_type}, summary string, reason string")
    entries = done.filter("reason IS NULL").select("project", "bucket", F.col("summary").alias("extract"), F.lit(5).alias("importance"), F.lit("derived").alias("provenance"), F.col("ids").alias("source_ids"))
    sources = entries.select(F.explode("source_ids").alias("id"))
    return entries, demote(rows, sources, target), done.filter("reason IS NOT NULL").select("project", "bucket", "reason")


def procedures(clusters: DataFrame, generate) -> DataFrame:
    """title, trigger, steps, sources, n, confidence of clusters (leader, ids, text) from an injected generator's answer
    (TITLE, TRIGGER, STEPS); an answer without title or steps gives none. Three members make the confidence high."""

    def ask(batches):
        for pdf in batches:  # a batch of clusters at a time; the generator sees one text after another
            yield pdf.assign(answer=[generate(t) for t in pdf["text"]])[["ids", "n", "answer"]]

    asked = clusters.select(F.col("ids").cast("array<string>").alias("ids"), F.size("ids").cast("long").alias("n"), "text").mapInPandas(ask, "ids array<string>, n long, answer string")
    read = lambda p: F.trim(F.regexp_extract("answer", p, 1))
    made = asked.select(read(r"TITLE:\s*(.+)").alias("title"), read(r"TRIGGER:\s*(.+)").alias("trigger"), F.regexp_replace(read(r"(?s)STEPS:\s*(.+)"), r"\s+\z", "").alias("steps"), F.array_join("ids", ",").alias("sources"), "n")
    return made.filter("title <> '' AND steps <> ''").withColumn("confidence", F.when(F.col("n") >= 3, "high").otherwise("medium"))


def importance_backfill(rows: DataFrame, force: bool = False) -> DataFrame:
    """Importance from confidence (high 7, low 3, else 5) for rows at 5, or all if forced; only rows that change."""
    target = F.when(F.col("confidence") == "high", 7).when(F.col("confidence") == "low", 3).otherwise(5)
    out = rows.withColumn("new_importance", target).filter(F.col("importance") != F.col("new_importance"))
    return out if force else out.filter("importance = 5")


def provenance_backfill(rows: DataFrame, evidence: Column, value: str) -> DataFrame:
    return rows.filter(F.col("provenance").isNull() & evidence).withColumn("new_provenance", F.lit(value))


def set_status(rows: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Supersede or revert: only active rows change."""
    own = ids.select(F.col("id").alias("s")).distinct()
    return rows.join(own, F.col("id") == F.col("s"), "left").withColumn("status", F.when(F.col("s").isNotNull() & (F.col("status") == "active"), status).otherwise(F.col("status"))).drop("s")


def consolidate(rows: DataFrame, days: int, before: int, threshold: int = 5, least: int = 3) -> DataFrame:
    """Tumbling buckets of old, unimportant rows for each project (null and empty are one): size, representative
    (longest, most important, newest, lowest id) and its window's first minute. Only buckets of `least` rows."""
    width = days * 1440
    low = rows.filter((F.col("minute") < before) & (F.coalesce("importance", F.lit(5)) < F.least(F.lit(threshold), F.lit(10))))
    best = F.struct(F.col("chars"), F.coalesce("importance", F.lit(5)), F.col("minute"), -F.col("id"))
    grouped = low.groupBy(F.coalesce("project", F.lit("")).alias("project"), F.floor(F.col("minute") / width).alias("bucket"))
    return grouped.agg(F.count("*").alias("n"), F.max_by("id", best).alias("representative")).filter(F.col("n") >= least).withColumn("from_minute", F.col("bucket") * width)


def tiered_context(curated: DataFrame, others: DataFrame, total: int = 12, reserved: int = 4, pools: tuple[int, int] = (6, 12)) -> DataFrame:
    """Reserved slots for the best curated records, the rest by importance, table priority and age. Rows: table,
    priority, id, importance, minute."""
    order = [F.desc("importance"), F.desc("minute"), F.desc("id")]
    first = curated.orderBy(*order).limit(pools[0]).withColumn("place", F.row_number().over(W.partitionBy("table").orderBy(*order)))
    pool = others.withColumn("place", F.row_number().over(W.partitionBy("table").orderBy(*order))).filter(F.col("place") <= pools[1])
    both = first.unionByName(pool).withColumn("reserved", (F.col("priority") == 0) & (F.col("place") <= reserved))
    return both.orderBy(F.desc("reserved"), F.desc("importance"), "priority", F.desc("minute"), F.desc("id")).limit(total).drop("place")


def render_context(lines: list[str], preview: int = 220, most: int = 6000, least: int = 4) -> str:
    """Cut previews; if too long, keep max(least, n * most / length) lines."""
    cut = [x if len(x) <= preview else x[:preview] + "…" for x in lines]
    text = "\n".join(cut)
    return text if len(text) <= most else "\n".join(cut[: max(least, len(cut) * most // len(text))])


def recency_multiplier(age_minutes: Column) -> Column:
    """Under an hour 4 (also the future), a day 2, a week 0.5, else 0.25."""
    return F.when(age_minutes < 60, 4.0).when(age_minutes < 1440, 2.0).when(age_minutes < 10080, 0.5).otherwise(0.25)


def frecency(count: Column, last_minute: Column, now: int) -> Column:
    return F.when((count > 0) & last_minute.isNotNull(), count * recency_multiplier(F.lit(now) - last_minute)).otherwise(0.0)


def age_scores(rows: DataFrame, cap: float, factor: float = 0.9) -> DataFrame:
    """If the scores' sum is over the cap, all shrink by the factor. The sum is one scalar, taken first."""
    total = rows.agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
    return rows.withColumn("score", F.col("score") * (factor if total > cap else 1.0))


def leader_clusters(pairs: DataFrame, least: int = 2, finish: int = 100_000) -> DataFrame:
    """leader, id: in id order an unassigned row becomes a leader and takes all later unassigned rows near it (pairs
    a < b); clusters of at least `least` rows, the leader included."""
    out = rounds.leaders(pairs, finish)
    if least <= 2:
        return out
    return out.join(out.groupBy("leader").count().filter(F.col("count") >= least).select("leader"), "leader", "left_semi")
