"""Upserts, access counts, extraction queues and index states: plans over record tables, with time as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens


def newest_wins(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The batch's first row of each key (by order) replaces the row that is there."""
    first = batch.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return existing.join(first.select(*keys), keys, "left_anti").unionByName(first)


def fill_in(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """A batch value replaces what is there unless it is null. Each side holds a key once."""
    old, new = existing.alias("old"), batch.alias("new")
    columns = [F.col(c) if c in keys else F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) for c in existing.columns]
    return old.join(new, keys, "full_outer").select(*columns)


def access_totals(events: DataFrame) -> DataFrame:
    """access_count and last_accessed of every (table, id) from appended access events; a row counts once in each
    result set it is part of."""
    once = events.select("table", "id", "result_set", "at").groupBy("table", "id", "result_set").agg(F.max("at").alias("at"))
    return once.groupBy("table", "id").agg(F.count("*").alias("access_count"), F.max("at").alias("last_accessed"))


def superseded_by(decisions: DataFrame, text: str, least: int = 3, longer_than: int = 4) -> DataFrame:
    """Active decisions that hold at least `least` of the new text's words of over `longer_than` characters; a word
    that the new text repeats counts each time."""
    own = [w for w in text.lower().split() if len(w) > longer_than]
    held = F.split(F.lower("decision"), r"\s+")
    shared = F.size(F.filter(F.array(*map(F.lit, own)).cast("array<string>"), lambda w: F.array_contains(held, w)))
    return decisions.filter(F.col("status") == "active").withColumn("shared", shared).filter(F.col("shared") >= least)


def similar_query(text: str, words: int = 10, longer_than: int = 3) -> str:
    """A search for any of the first words of more than `longer_than` characters; empty if there are none."""
    own = [w for w in text.replace('"', " ").split() if len(w) > longer_than]
    return " OR ".join(f'"{w}"' for w in own[:words])


def extraction_queue(files: DataFrame, tracker: DataFrame, now: Column, least: int = 2000, growth: float = 0.5, medium: int = 500_000) -> DataFrame:
    """path, size, reason of files to extract, medium sizes first, larger before smaller. tracker: path, seen_size,
    extracted_at, failed_at, retry_after."""
    t = tracker.select("path", F.lit(True).alias("known"), "seen_size", "extracted_at", "failed_at", "retry_after")
    waits = F.col("failed_at").isNotNull() & F.col("extracted_at").isNull()
    due = F.coalesce("retry_after", F.col("failed_at") + F.expr("INTERVAL 24 HOURS")) <= now
    grew = (F.col("seen_size") <= 0) | F.col("seen_size").isNull() | ((F.col("size") - F.col("seen_size")) / F.col("seen_size") > growth)
    reason = F.when(F.col("known").isNull(), "new").when(waits, F.when(due, "retry")).when(grew, "grew")
    first = F.when((F.col("size") > least) & (F.col("size") < medium), 0).otherwise(1)
    return files.filter(F.col("size") >= least).join(t, "path", "left").withColumn("reason", reason).filter("reason IS NOT NULL").select("path", "size", "reason").orderBy(first, F.desc("size"), "path")


def recent_mix(tables: dict[str, tuple[DataFrame, int]], time: str = "minute") -> DataFrame:
    """The newest rows of each table: table, id and time."""
    out = None
    for name, (rows, n) in tables.items():
        one = rows.orderBy(F.desc(time), F.desc("id")).limit(n).select(F.lit(name).alias("table"), "id", time)
        out = one if out is None else out.unionByName(one)
    return out


def since_last(messages: DataFrame, curated: DataFrame) -> DataFrame:
    """Messages after the last one that a curated entry covers (all, if there is none). One number is broadcast."""
    last = curated.agg(F.coalesce(F.max("range_end"), F.lit(-1)).alias("_last"))
    return messages.join(F.broadcast(last), F.col("id") > F.col("_last")).drop("_last")


def prune_expired(rows: DataFrame, now: Column, survivors: DataFrame) -> DataFrame:
    """Rows whose time to live is over and that are no duplicate's survivor."""
    return rows.filter(F.col("expires_at") < now).join(survivors.select("id"), "id", "left_anti")


def marker_state(embeddings: DataFrame, model: str, dimensions: int) -> DataFrame:
    """absent without embeddings, stale if any is of another model or length, else match."""
    other = F.count_if(~(F.col("model").eqNullSafe(F.lit(model)) & F.col("dimensions").eqNullSafe(F.lit(dimensions))))
    counted = embeddings.agg(F.count("*").alias("n"), other.alias("n_other"))
    return counted.withColumn("state", F.when(F.col("n") == 0, "absent").when(F.col("n_other") > 0, "stale").otherwise("match"))


def index_state(source: DataFrame, index: DataFrame | None, columns: list[str]) -> DataFrame:
    """Compares an index's rows (id, n_tokens, content hash h) with the source: ok, drift or missing-index, and the
    rows that lack, differ or are too many."""
    own = index_rows(source, columns).select("id", F.col("h").alias("own"))
    if index is None:
        return own.agg(F.count("*").alias("lacking"), F.lit(0).cast("long").alias("differing"), F.lit(0).cast("long").alias("surplus")).withColumn("state", F.lit("missing-index"))
    both = own.join(index.select("id", "h"), "id", "full_outer")
    counted = both.agg(F.count_if(F.col("h").isNull()).alias("lacking"), F.count_if(F.col("h") != F.col("own")).alias("differing"), F.count_if(F.col("own").isNull()).alias("surplus"))
    return counted.withColumn("state", F.when(F.col("lacking") + F.col("differing") + F.col("surplus") > 0, "drift").otherwise("ok"))


def index_rows(source: DataFrame, columns: list[str]) -> DataFrame:
    every = F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in columns))
    return source.select("id", F.size(tokens(every)).alias("n_tokens"), F.xxhash64(every).alias("h"))


def top_queries(usage: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent queries of the usage log with the rows they brought on average."""
    return usage.groupBy("query").agg(F.count("*").alias("n"), F.avg("results").alias("results")).orderBy(F.desc("n"), "query").limit(n)
