"""Lookups, file picks, rotating sinks, context assembly, integrity reports and dumps over record tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalise


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lookup(tables: dict[str, tuple[DataFrame, Column]], wanted: DataFrame, preview: int = 80) -> DataFrame:
    """table, id, content of the wanted (table, id) rows; those that are not there give no row."""
    parts = []
    for name, (rows, content) in tables.items():
        ids = wanted.filter(F.col("table") == name).select("id").distinct()
        parts.append(rows.join(ids, "id", "left_semi").select(F.lit(name).alias("table"), "id", F.substring(content, 1, preview).alias("content")))
    return union(parts)


def existing(batch: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The batch with `known`: whether rows hold its key."""
    held = rows.select(F.col(key).alias("_k")).distinct()
    return batch.join(held, F.col(key) == F.col("_k"), "left").withColumn("known", F.col("_k").isNotNull()).drop("_k")


def pick_files(files: DataFrame, now: Column, guard: int = 5) -> DataFrame:
    """folder, current, previous of log files (folder, name, modified in seconds): the newest, and the newest that is
    older than `guard` seconds, or the second newest if the newest is younger; a lone file is both. Sub-agents' files
    do not count."""
    logs = files.filter(F.col("name").endswith(".jsonl") & ~F.col("name").startswith("agent-"))
    place = F.row_number().over(W.partitionBy("folder").orderBy(F.desc("modified"), "name"))
    two = logs.withColumn("_n", place).filter("_n <= 2").groupBy("folder").agg(
        F.max(F.when(F.col("_n") == 1, F.col("name"))).alias("current"), F.max(F.when(F.col("_n") == 2, F.col("name"))).alias("second"), F.max("modified").alias("at")
    )
    young = (now - F.col("at")) < guard
    return two.select("folder", "current", F.when(young & F.col("second").isNotNull(), F.col("second")).otherwise(F.col("current")).alias("previous"))


def unseen(existing_rows: DataFrame, batch: DataFrame, text: str, order: list[Column]) -> DataFrame:
    """Rows of the batch whose normal form neither the table nor an earlier row of the batch has. The first row of a text
    comes from an aggregate, so a text that many rows share is no hot group."""
    keyed = batch.withColumn("_k", F.sha2(normalise(F.col(text)), 256))
    first = keyed.groupBy("_k").agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("_r"))
    held = existing_rows.select(F.sha2(normalise(F.col(text)), 256).alias("_k")).distinct()
    return first.join(held, "_k", "left_anti").select("_r.*")


def usage_rows(calls: DataFrame, most: int = 200) -> DataFrame:
    """Rows for the usage log: tool, query (cut), n, project."""
    return calls.select("tool", F.substring("query", 1, most).alias("query"), F.col("n").cast("long").alias("n"), "project")


def by_name(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Case does not matter."""
    return rows.filter(F.lower(column) == name.lower())


def tag(provenance: Column, shown: bool = False) -> Column:
    """`[unknown]` where there is none; others only if asked for."""
    return F.when(provenance.isNull(), "[unknown]").otherwise(F.concat(F.lit("["), provenance, F.lit("]")) if shown else F.lit(""))


def usable(rows: DataFrame, now: Column, marked: DataFrame) -> DataFrame:
    """Rows that a context may show: active, not of low confidence, alive, and no marked duplicate. A table that lacks
    one of the columns is not judged by it."""
    out = rows
    if "status" in rows.columns:
        out = out.filter(F.col("status") == "active")
    if "confidence" in rows.columns:
        out = out.filter(F.col("confidence").isNull() | (F.col("confidence") != "low"))
    if "expires_at" in rows.columns:
        out = out.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return out.join(marked.select("id").distinct(), "id", "left_anti")


def flat_bundle(tables: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """table, id, minute: the newest rows of each table, the baseline that tiers are held against."""
    newest = lambda rows, n: rows.orderBy(F.desc("minute"), F.desc("id")).limit(n)
    return union([newest(rows, n).select(F.lit(name).alias("table"), "id", "minute") for name, (rows, n) in tables.items()])


def last_window(messages: DataFrame, curated: DataFrame) -> DataFrame:
    """first, last, n: the messages after the last that a curated entry covers, with the earliest's and the latest's id."""
    last = curated.agg(F.coalesce(F.max("range_end"), F.lit(-1)).alias("_last"))
    after = messages.join(F.broadcast(last), F.col("id") > F.col("_last"))  # one number
    at = F.struct("minute", "id")
    return after.agg(F.min_by("id", at).alias("first"), F.max_by("id", at).alias("last"), F.count("*").alias("n"))


def quotes(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """id, expected, present, pruned of the message range of each entry (id, session_id, range_start, range_end)."""
    own = messages.select("session_id", F.col("id").alias("m"))
    joined = entries.join(own, (own["session_id"] == entries["session_id"]) & F.col("m").between(F.col("range_start"), F.col("range_end")), "left")
    expected = F.col("range_end") - F.col("range_start") + 1
    return joined.groupBy("id", expected.alias("expected")).agg(F.count("m").alias("present")).withColumn("pruned", F.col("expected") - F.col("present"))


def integrity(tables: dict[str, DataFrame], embeddings: DataFrame, lineage: DataFrame, sessions: DataFrame, messages: DataFrame, curated: DataFrame, samples: int = 5, searched: dict[str, DataFrame] | None = None) -> DataFrame:
    """check, n, samples of every check that finds something (searched: tables that have embeddings but no lineage): embeddings without their row and of unknown tables, marked
    lineage without its duplicate or survivor, messages without a session, curated entries with a broken message range
    or parent. Each check is an anti join; the samples are the smallest ids, kept by an aggregate."""

    def report(name: str, lost: DataFrame, column: str) -> DataFrame:
        few = lost.select(F.col(column).cast("long").alias("_id")).orderBy("_id").limit(samples).agg(F.array_join(F.array_sort(F.collect_list("_id")), ",").alias("samples"))
        return lost.agg(F.count("*").alias("n")).join(few).filter("n > 0").select(F.lit(name).alias("check"), "n", "samples")

    lacks = lambda rows, key, parent, other: rows.filter(F.col(key).isNotNull()).join(parent.select(F.col(other).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")
    parts = [report(f"orphaned-embeddings:{t}", lacks(embeddings.filter(F.col("source_table") == t), "source_id", rows, "id"), "source_id") for t, rows in (tables | (searched or {})).items()]
    parts.append(report("unknown-embedding-source", embeddings.filter(~F.col("source_table").isin(*tables, *(searched or {}))), "source_id"))
    marked = lineage.filter("status = 'marked'")
    for side in ("duplicate", "survivor"):
        parts += [report(f"lineage-missing-{side}:{t}", lacks(marked.filter(F.col(f"{side}_table") == t), f"{side}_id", rows, "id"), "id") for t, rows in tables.items()]
    parts.append(report("messages-without-session", lacks(messages, "session_id", sessions, "session_id"), "id"))
    ends = union([lacks(curated, c, messages, "id").select("id") for c in ("range_start", "range_end")]).distinct()
    parts.append(report("curated-broken-message-range", ends, "id"))
    parts.append(report("curated-broken-parent", lacks(curated, "parent", curated, "id"), "id"))
    return union(parts)


def health(checks: DataFrame) -> DataFrame:
    """score (percent of checks that pass or inform), n, failed of check states (PASS, INFO, WARN, FAIL)."""
    good = F.count_if(F.col("state").isin("PASS", "INFO"))
    return checks.agg(F.round(100.0 * good / F.count("*"), 1).alias("score"), F.count("*").alias("n"), F.count_if(F.col("state") == "FAIL").alias("failed"))


def transcript(messages: DataFrame) -> DataFrame:
    """session_id, transcript: `[ROLE HH:MM:SS]` and the content of each message (time: a timestamp), in order."""
    block = F.concat(F.lit("["), F.upper("role"), F.lit(" "), F.date_format("time", "HH:mm:ss"), F.lit("]\n"), "content")
    rows = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("time", "id", block.alias("b")))).alias("l"))
    return rows.select("session_id", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n---\n\n").alias("transcript"))


def basic_summary(messages: DataFrame, most: int = 200) -> DataFrame:
    """session_id, summary: what a session gets when no extraction is to be had."""
    at = F.struct("minute", "id")
    cut = lambda who, pick: F.coalesce(F.substring(pick(F.when(F.col("role") == who, F.col("content")), F.when(F.col("role") == who, at)), 1, most))
    g = messages.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"), cut("user", F.min_by).alias("first"), cut("assistant", F.max_by).alias("last"))
    shown = lambda c, other: F.concat(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other)), F.when(F.length(c) >= most, "...").otherwise(""))
    lines = F.concat(
        F.lit("## ONE SENTENCE SUMMARY\n\nSession with "), F.col("n"), F.lit(" messages.\n\n## MAIN IDEAS\n\n- User started with: "), shown("first", "No user messages"), F.lit("\n- Final response covered: "), shown("last", "No assistant messages"),
        F.lit("\n\n## TOPICS\n\n- "), F.col("n"), F.lit(" total messages ("), F.col("u"), F.lit(" user, "), F.col("a"), F.lit(" assistant)\n"),
    )
    return g.select("session_id", lines.alias("summary"))


def cut_lines(text: str, size: int = 80_000) -> list[str]:
    """A long text in pieces of whole lines: a piece ends before the line that would take it over `size`."""
    out, now = [], ""
    for line in text.split("\n"):
        if now and len(now) + len(line) > size:
            out.append(now)
            now = ""
        now += line + "\n"
    return [*out, now] if now.strip() else out


def extract_long(text: str, extract: Callable[[str], str | None], merge: Callable[[str], str | None], longest: int = 120_000, size: int = 80_000) -> str | None:
    """extract(text), or for a longer one the merged extracts of its pieces; if the merge fails, the extracts themselves."""
    if len(text) <= longest:
        return extract(text)
    pieces = cut_lines(text, size)
    found = [(i, e) for i, p in enumerate(pieces, 1) if (e := extract(p))]
    if len(found) < 2:
        return found[0][1] if found else None
    return merge("\n\n".join(f"--- Chunk {i}/{len(pieces)} ---\n{e}" for i, e in found)) or "\n\n".join(e for _, e in found)


def dump_session(sessions: DataFrame, messages: DataFrame, curated: DataFrame, session_id: int, batch: DataFrame, title: str, entry_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sessions, messages and curated entries after a session is dumped (again): its old messages, and the entries that
    lie in its message range with all that hang below them, go; the batch and one entry over it come."""
    old = messages.filter(F.col("session_id") == session_id)
    span = old.agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    inside = curated.join(F.broadcast(span), F.col("range_start").between(F.col("lo"), F.col("hi"))).select("id")  # two numbers
    kept = delete_tree(curated, inside)
    bounds = batch.agg(F.min_by("id", F.struct("minute", "id")).alias("range_start"), F.max_by("id", F.struct("minute", "id")).alias("range_end"), F.min("minute").alias("minute"))
    entry = bounds.select(F.lit(entry_id).cast("long").alias("id"), F.lit(title).alias("title"), F.lit(None).cast("long").alias("parent"), F.lit(session_id).cast("long").alias("session_id"), "range_start", "range_end", "minute")
    started = batch.agg(F.lit(session_id).cast("long").alias("session_id"), F.min("minute").alias("started"), F.max("minute").alias("ended"))
    return (
        sessions.filter(F.col("session_id") != session_id).unionByName(started),
        messages.filter(F.col("session_id") != session_id).unionByName(batch),
        kept.select(*entry.columns).unionByName(entry),
    )


def delete_tree(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries (id, parent) without the roots and all that hang below them."""
    from ..plans.graph import descendants

    gone = descendants(entries.select("id", "parent"), "parent", roots)
    return entries.join(gone.select("id"), "id", "left_anti")


#: Words that make a task need a search of the web. Fixed values.
TIMELY = ("latest", "current", "recent", "new", "2025", "2026", "today", "now", "updated")
OUTSIDE = ("documentation", "docs", "api", "how to", "best practice", "example", "tutorial", "guide", "official", "release", "version", "library", "package", "framework")


def web_hint(task: Column, results: Column) -> Column:
    """Why a task should also look in the web, or null."""
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(task), w))
    return F.when(holds(TIMELY), "time-sensitive").when(holds(OUTSIDE), "external knowledge").when(results == 0, "no local results")
