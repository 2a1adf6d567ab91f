"""Imports that can be run again: documents by path, archives scrubbed and without what is known, sessions without known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import scrub
from . import formats, ingest, store
from .tablelog import TableLog


def import_documents(log: TableLog, files: DataFrame, batch: tuple[str, int] | None = None, least: int = 500) -> int:
    """Titles, summaries and scrubbed texts of files (path, text) into a table by path: a path that is there is replaced
    if its text is another, and left as it is if not. Each text is scrubbed once, and what is new or changed is staged, as
    a merge reads its changes several times."""
    about = ingest.documents(files.filter("path IS NOT NULL"), least, scrub(F.col("text")).alias("content"))
    rows = about.select("path", "title", "summary", "content", F.sha2("content", 256).alias("digest"))
    state = log.state()
    if batch and state.batches.get(batch[0], -1) >= batch[1]:
        return state.version
    if "schema" in state.facts:
        known = log.frame().select(F.col("path").alias("_p"), F.col("digest").alias("_d"))
        rows = rows.join(known, (F.col("path") == F.col("_p")) & (F.col("digest") == F.col("_d")), "left_anti")
    staged = store.staged(rows, "documents")
    try:
        return log.merge(staged, ["path"], batch)
    finally:
        store.drop_staged(staged)


def import_archive(files: DataFrame, existing: DataFrame) -> DataFrame:
    """day, project, title, content of archive sections that existing (title, day) lacks. They are scrubbed first, so
    that a section that was stored scrubbed is known again; of the same title and day the first content counts."""
    clean = formats.archive_sections(files).select("day", "project", scrub(F.col("title")).alias("title"), scrub(F.col("content")).alias("content"))
    one = clean.groupBy("title", "day").agg(F.min(F.struct("project", "content")).alias("x")).select("day", "x.project", "title", "x.content")
    return one.join(existing.select("title", "day").distinct(), ["title", "day"], "left_anti").select("day", "project", "title", "content")


def import_sessions(messages: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sessions (session_id, started, ended, n) that known (session_id) lacks, and their messages as they were said
    (provenance verbatim). A session without a message that is not blank is none."""
    said = messages.filter(F.regexp_replace("content", r"\s", "") != "")
    new = said.join(known.select("session_id").distinct(), "session_id", "left_anti")
    return ingest.session_bounds(new), new.withColumn("provenance", F.lit("verbatim"))


def sweep_archive(files: DataFrame, backups: TableLog | None = None) -> DataFrame:
    """formats.sweep() of files (path, payload), and `unreadable` for those without a payload. What is going to change is
    kept in backups (path, payload) before; a payload that is there already is not kept twice."""
    readable = files.filter("payload IS NOT NULL")
    swept = formats.sweep(readable).unionByName(files.filter("payload IS NULL").select("path", F.lit("unreadable").alias("state"), "payload"))
    if backups is not None:
        changed = swept.filter("state = 'changed'").select("path")
        old = readable.join(changed, "path", "left_semi").select("path", "payload", F.sha2("payload", 256).alias("digest"))
        backups.merge(old, ["path", "digest"])
    return swept
