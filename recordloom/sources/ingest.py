"""Chat exports, transcripts, documents, and idempotent writes."""

from __future__ import annotations

import json
import math
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sanitise_id

#: Speaker names to roles; others are dropped.
ROLES = {"human": "user", "user": "user", "customer": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant", "bot": "assistant", "system": "system"}
MESSAGE = "session_id string, title string, ordinal long, role string, ts double, content string"


def role_of(name: Column) -> Column:
    low = F.lower(F.trim(name))
    out = None
    for k, v in ROLES.items():
        out = F.when(low == k, v) if out is None else out.when(low == k, v)
    return out


def detect_format(payload: Column) -> Column:
    """chatgpt before claude-ai before slack: the order decides where shapes overlap."""
    first = lambda p: F.coalesce(F.get_json_object(payload, f"$[0].{p}"), F.get_json_object(payload, f"$.{p}"))
    turns = F.coalesce(first("chat_messages[0]"), first("messages[0]"))
    speaks = F.coalesce(F.get_json_object(turns, "$.sender"), F.get_json_object(turns, "$.role")).isNotNull()
    slack = first("ts").isNotNull() & F.coalesce(first("text"), first("blocks"), first("attachments")).isNotNull()
    return F.when(first("mapping").startswith("{"), "chatgpt").when(speaks, "claude-ai").when(slack, "slack")


def flatten_text(value) -> str:
    """Text of any JSON value: arrays by lines, objects by text, value, result, else parts, content, blocks."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int, float)):
        return str(value)
    if isinstance(value, list):
        return "\n".join(x for x in map(flatten_text, value) if x)
    for key in ("text", "value", "result"):
        if isinstance(value.get(key), str):
            return value[key]
    for key in ("parts", "content", "blocks"):
        if key in value:
            return flatten_text(value[key])
    return ""


def seconds(value, fallback: float = 0.0) -> float:
    """Numbers over 1e12 are milliseconds; numeric strings are seconds; other strings are dates."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return fallback if not math.isfinite(value) else value / 1000 if value > 1e12 else float(value)
    try:
        if math.isfinite(number := float(value)):
            return number
        return fallback
    except (TypeError, ValueError):
        pass
    try:
        when = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
        return (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp()
    except ValueError:
        return fallback


def _chatgpt(conv: dict):
    nodes, chain, seen, at = conv.get("mapping") or {}, [], set(), conv.get("current_node")
    while at in nodes and at not in seen:
        seen.add(at)
        chain.append(nodes[at])
        at = nodes[at].get("parent")
    if not chain:
        chain = sorted(nodes.values(), key=lambda n: -seconds((n.get("message") or {}).get("create_time")))
    for node in reversed(chain):
        m = node.get("message") or {}
        if m and not (m.get("metadata") or {}).get("is_visually_hidden_from_conversation"):
            yield (m.get("author") or {}).get("role"), seconds(m.get("create_time")), flatten_text(m.get("content"))


def _claude(conv: dict):
    for m in conv.get("chat_messages") or conv.get("messages") or []:
        yield m.get("sender") or m.get("role"), seconds(m.get("created_at") or m.get("timestamp")), flatten_text(m.get("text") or m.get("content"))


def _first(*values):
    """The first that is a filled string."""
    return next((v.strip() for v in values if isinstance(v, str) and v.strip()), None)


def _slack(m: dict):
    if _first(m.get("subtype")) == "message_deleted":
        return
    text = flatten_text(m.get("text"))
    if not text.strip():
        # Of an attachment the first field that is there counts.
        shown = [flatten_text(next((a[k] for k in ("pretext", "title", "text", "fallback") if a.get(k) is not None), None)) for a in m.get("attachments") or [] if isinstance(a, dict)]
        text = "\n".join(x for x in shown if x)
    if not text.strip():
        text = flatten_text(m.get("blocks"))
    profile, bot = (x if isinstance(x, dict) else {} for x in (m.get("user_profile"), m.get("bot_profile")))
    sender = _first(profile.get("real_name"), profile.get("display_name"), profile.get("name"), m.get("username"), bot.get("name"), m.get("user"), m.get("bot_id")) or "unknown"
    is_bot = bool(m.get("bot_id")) or _first(m.get("subtype")) == "bot_message"
    at = m.get("ts") if m.get("ts") is not None else m.get("thread_ts")
    yield "assistant" if is_bot else "user", seconds(at), f"[{sender}] {text}" if text.strip() else ""


def parse_export(payload: str, kind: str, path: str) -> list[tuple]:
    """Messages of one export file; what is no JSON, or no object where one is meant, gives none."""
    try:
        data = json.loads(payload)
    except ValueError:
        return []
    if kind == "slack" and isinstance(data, dict) and isinstance(data.get("messages"), list):
        data = data["messages"]
    items = data if isinstance(data, list) else [data]
    out = []
    for n, conv in enumerate(items):
        if not isinstance(conv, dict):
            continue
        if kind == "slack":
            session, title, turns = "/".join(path.rsplit("/", 2)[-2:]).removesuffix(".json"), None, _slack(conv)
        else:
            session, title = str(conv.get("id") or conv.get("uuid") or f"{path}-{n}"), conv.get("title") or conv.get("name")
            turns = (_chatgpt if kind == "chatgpt" else _claude)(conv)
        for i, (name, ts, text) in enumerate(turns):
            role = ROLES.get(str(name).strip().lower())
            if role and text.strip():
                out.append((session, title, (n << 32) + i, role, ts, text))
    return out


def chat_exports(files: DataFrame) -> DataFrame:
    """Messages of export files (path, payload), ordered by time within a session; unknown shapes give none."""
    known = files.withColumn("kind", detect_format(F.col("payload"))).filter("kind IS NOT NULL").select("path", "payload", "kind")

    def parse(parts):
        for pdf in parts:
            rows = [r for p, t, k in zip(pdf["path"], pdf["payload"], pdf["kind"]) for r in parse_export(t, k, p)]
            yield pd.DataFrame(rows, columns=["session_id", "title", "ordinal", "role", "ts", "content"])

    found = known.mapInPandas(parse, MESSAGE).withColumn("session_id", sanitise_id(F.col("session_id")))
    return found.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("ts", "ordinal")))


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row for each user or assistant line of JSONL transcripts; corrupt lines are skipped."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    g = lambda p: F.get_json_object("value", p)
    blocks = F.from_json(g("$.message.content"), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    plain = F.when(g("$.message.content").startswith("["), joined).otherwise(g("$.message.content"))
    return raw.filter(g("$.type").isin("user", "assistant")).select("path", g("$.sessionId").alias("session_id"), g("$.timestamp").alias("timestamp"), g("$.type").alias("role"), plain.alias("content")).filter(F.length(F.trim("content")) > 0)


def transcript_slice(messages: DataFrame, most: int = 4000) -> DataFrame:
    """A session's text for extraction: user and assistant turns of 10 characters that are no tool output, each cut
    at `most`, joined by blank lines in order."""
    fit = messages.filter(F.col("role").isin("user", "assistant") & (F.length("content") >= 10) & ~F.col("content").startswith("[{") & ~F.col("content").startswith('{"tool_use_id"'))
    cut = F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit("...[truncated]"))).otherwise(F.col("content"))
    line = F.concat(F.upper("role"), F.lit(": "), cut)
    rows = fit.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("minute", "id", line.alias("line")))).alias("l"))
    return rows.select("session_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("transcript"), F.size("l").cast("long").alias("n"))


def session_bounds(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.min("minute").alias("started"), F.max("minute").alias("ended"), F.count("*").alias("n"))


def append_new(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of the batch whose keys (null equals null) neither the table nor an earlier row of the batch has."""
    first = batch.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    e = existing.select(*(F.col(k).alias(f"_e_{k}") for k in keys)).distinct()
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_e_{k}"))
        same = one if same is None else same & one
    return first.join(e, same, "left_anti")


def documents(files: DataFrame, least: int = 500, *more: Column) -> DataFrame:
    """path, title, summary of text files (path, text): first H1, else bold Title, else the name; summary: a Purpose
    line, else the first line of over 30 characters among 20. `more` are further columns over files."""
    big = files.filter(F.length("text") >= least)
    h1, bold = F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1), F.regexp_extract("text", r"\*\*Title:?\*\*:?\s*(.+)", 1)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    title = F.when(h1 != "", h1).when(bold != "", bold).otherwise(name)
    purpose = F.regexp_extract("text", r"(?im)^\**Purpose:?\**:?\s*(.+)$", 1)
    lines = F.filter(F.slice(F.split("text", "\n"), 1, 20), lambda x: (F.length(F.trim(x)) > 30) & ~x.startswith("#"))
    return big.select("path", F.trim(title).alias("title"), F.when(purpose != "", purpose).otherwise(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))).alias("summary"), *more)


#: File name (upper case, without ending) to type; others are `other`. Fixed values.
PURPOSES = {"GOALS": "goal", "PROBLEMS": "problem", "MISSION": "mission", "CHALLENGES": "challenge", "STRATEGIES": "strategy", "PROJECTS": "project", "TELOS": "identity"}


def purposes(files: DataFrame) -> DataFrame:
    """code, type, title, content of purpose files (path, text): the code is the file's name, the title its first
    heading; empty files give none."""
    code = F.upper(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", ""))
    kinds = F.create_map(*(F.lit(x) for pair in PURPOSES.items() for x in pair))
    clean = F.regexp_replace("text", r"\A\s+|\s+\z", "")
    rows = files.filter(F.col("path").endswith(".md")).select(code.alias("code"), clean.alias("content")).filter("content <> ''")
    head = F.trim(F.regexp_extract("content", r"(?m)^#\s+(.+)$", 1))
    return rows.select("code", F.coalesce(F.try_element_at(kinds, F.col("code")), F.lit("other")).alias("type"), F.when(head == "", F.col("code")).otherwise(head).alias("title"), "content")


def tracker_state(payloads: DataFrame) -> DataFrame:
    """path, size, extracted_at, failed_at, retry_after, error of a state file's object of objects (payload)."""
    kind = "map<string,struct<size:bigint,extractedAt:string,failedAt:string,retryAfter:string,error:string>>"
    rows = payloads.select(F.explode(F.from_json("payload", kind)).alias("path", "s"))
    return rows.select("path", F.coalesce("s.size", F.lit(0)).alias("size"), F.col("s.extractedAt").alias("extracted_at"), F.col("s.failedAt").alias("failed_at"), F.col("s.retryAfter").alias("retry_after"), F.col("s.error").alias("error"))


def session_index(payloads: DataFrame, most: int = 500) -> DataFrame:
    """session_id, project, timestamp, summary, topics: the newest of an index file's entries; those without a time go."""
    kind = "array<struct<sessionId:string,project:string,timestamp:string,summary:string,topics:array<string>>>"
    rows = payloads.select(F.inline(F.from_json("payload", kind))).filter("timestamp IS NOT NULL")
    shown = rows.select(F.col("sessionId").alias("session_id"), "project", "timestamp", "summary", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))
    return shown.orderBy(F.desc("timestamp"), "session_id").limit(most)


def error_patterns(payloads: DataFrame, now: str) -> DataFrame:
    """error, fix, context, first_seen, last_seen: a later entry of an error replaces an earlier one."""
    kind = "struct<patterns:array<struct<error:string,fix:string,context:string,cause:string,date:string,firstSeen:string,lastSeen:string>>>"
    rows = payloads.select(F.posexplode(F.from_json("payload", kind)["patterns"]).alias("n", "p")).select("n", "p.*")
    newest = rows.groupBy("error").agg(F.max_by(F.struct("fix", F.coalesce("context", "cause").alias("context"), F.coalesce("firstSeen", "date", F.lit(now)).alias("first_seen"), F.coalesce("lastSeen", "date", F.lit(now)).alias("last_seen")), "n").alias("x"))
    return newest.select("error", "x.*")


def coerce_time(value: Column, fallback: Column) -> Column:
    """Seconds since 1970 of a time given as JSON: a number above 10^12 is in milliseconds, other numbers and numbers in
    quotes in seconds, all else a date; the fallback where it is none."""
    bare = F.regexp_replace(value, '^"|"$', "")
    number = bare.try_cast("double")
    quoted = value.startswith('"')
    date = F.unix_millis(F.try_to_timestamp(bare)) / 1000.0
    return F.coalesce(F.when(number.isNotNull(), F.when(~quoted & (number > 1e12), number / 1000).otherwise(number)).otherwise(date), fallback)


def free_name(taken: set[str], name: str) -> str:
    """The name, or with -1, -2, ... before its ending the first that is not taken."""
    stem, dot, end = name.rpartition(".")
    stem, end = (stem, dot + end) if dot else (end, "")
    n, out = 0, name
    while out in taken:
        n += 1
        out = f"{stem}-{n}{end}"
    return out
