"""Further sources (markdown drops, tool session exports, tree-shaped logs, archives) and text sinks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import quality

_MARK = r"\[(USER|ASSISTANT)(?:\s+[\d:]+)?\]:"
_HEAD = r"^##?[ \t]*(User|Assistant|Human)[ \t]*$"
_NAME = r"\.[^.]*$"


def _base(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), _NAME, "")


def markdown_drops(files: DataFrame, longer_than: int = 10) -> DataFrame:
    """session_id, ordinal, role, content of files (path, text) with `[USER 12:00]:` marks or, without any, role headings."""
    marked = F.col("text").rlike("(?i)" + _MARK)
    pieces = F.when(marked, F.split("text", f"(?i)(?={_MARK})")).otherwise(F.split("text", f"(?im)(?={_HEAD})"))
    rows = files.filter(F.col("text").isNotNull()).select(_base(F.col("path")).alias("session_id"), marked.alias("marked"), F.posexplode(pieces).alias("ordinal", "piece"))
    start = F.when(F.col("marked"), F.regexp_extract("piece", f"(?i)^{_MARK}", 1)).otherwise(F.regexp_extract("piece", rf"(?im)\A{_HEAD}", 1))
    body = F.when(F.col("marked"), F.regexp_replace("piece", f"(?i)^{_MARK}", "")).otherwise(F.regexp_replace("piece", rf"(?im)\A{_HEAD}", ""))
    role = F.when(F.lower(start) == "human", "user").otherwise(F.lower(start))
    said = rows.filter(start != "").select("session_id", "ordinal", role.alias("role"), F.regexp_replace(body, r"\A\s+|\s+\z", "").alias("content"))
    return said.filter(F.length("content") > longer_than)


_PARTS = "struct<info:struct<id:string,title:string>,messages:array<struct<info:struct<role:string>,parts:array<struct<text:string,state:struct<title:string,output:string>,description:string,prompt:string,filename:string>>>>>"


def tool_sessions(files: DataFrame) -> DataFrame:
    """session_id, ordinal, role, content of session exports (path, payload) whose messages hold parts: text, tool
    states, sub-tasks and files. Messages without readable parts are left out."""
    filled = lambda c, before="", after="": F.when(F.trim(c) != "", F.concat(F.lit(before), c, F.lit(after)))
    texts = lambda p: F.array(filled(p["text"]), filled(p["state"]["title"], "[tool: ", "]"), filled(p["state"]["output"]), filled(p["description"]), filled(p["prompt"]), filled(p["filename"], "[file: ", "]"))
    read = files.select("path", F.from_json("payload", _PARTS).alias("e"))
    rows = read.select(F.coalesce("e.info.id", _base(F.col("path"))).alias("session_id"), F.posexplode("e.messages").alias("ordinal", "m"))
    content = F.array_join(F.array_compact(F.flatten(F.transform("m.parts", texts))), "\n\n")
    return rows.select("session_id", "ordinal", F.coalesce("m.info.role", F.lit("unknown")).alias("role"), content.alias("content")).filter("content != ''")


def archive_sections(files: DataFrame) -> DataFrame:
    """day, project, title, content of `## Extracted: DAY | PROJECT` sections."""
    head = r"\A## Extracted:[ \t]*([0-9-]+)[ \t]*\|[ \t]*([^\n]+)\n"
    parts = files.select(F.explode(F.split("text", "(?m)(?=^## Extracted:)")).alias("s")).filter(F.col("s").rlike(head))
    content = F.regexp_replace(F.regexp_replace(F.regexp_replace("s", head, ""), r"(?:\A|\n)---\s*\z", ""), r"\A\s+|\s+\z", "")
    rows = parts.select(F.to_date(F.regexp_extract("s", head, 1)).alias("day"), F.trim(F.regexp_extract("s", head, 2)).alias("project"), content.alias("content")).filter("content != ''")
    summary, named = F.regexp_extract("content", r"(?i)ONE SENTENCE SUMMARY[ \t]*\n([^\n]+)", 1), F.regexp_extract("content", r"SESSION:[ \t]*([^\n]+)", 1)
    title = F.when(summary != "", F.trim(summary)).when(named != "", F.trim(named)).otherwise(F.concat(F.lit("Legacy extract from "), F.col("project")))
    return rows.withColumn("title", title)


def sql_lines(rows: DataFrame, table: str) -> DataFrame:
    """One INSERT statement for each row."""

    def literal(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            text = c.cast("string")
        else:
            shown = F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")
            text = F.concat(F.lit("'"), F.replace(shown, F.lit("'"), F.lit("''")), F.lit("'"))
        return F.coalesce(text, F.lit("NULL"))

    values = F.concat_ws(", ", *(literal(n, k) for n, k in rows.dtypes))
    return rows.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(rows.columns)}) VALUES ("), values, F.lit(");")).alias("line"))


def markdown_sections(rows: DataFrame, table: str) -> DataFrame:
    """One section for each row: its id as heading, its other filled columns as a list."""
    item = lambda n: F.when(F.col(n).isNotNull(), F.concat(F.lit(f"- **{n}**: "), F.col(n).cast("string")))
    return rows.select(F.concat_ws("\n", F.concat(F.lit(f"## {table} "), F.col("id").cast("string")), F.lit(""), *(item(n) for n in rows.columns if n != "id"), F.lit("")).alias("line"))


def export(tables: dict[str, DataFrame], path: str, form: str = "json") -> DataFrame:
    """Write each table below path as json, markdown, sql or parquet (a snapshot that keeps vectors) and return the
    manifest, which is written last. What exists is never overwritten."""
    if form not in ("json", "markdown", "sql", "parquet"):
        raise ValueError(f"unknown format {form}")
    for name, rows in tables.items():
        out = {"sql": sql_lines, "markdown": markdown_sections}[form](rows, name) if form in ("sql", "markdown") else rows
        writer = out.write.mode("errorifexists")
        (writer.text if form in ("sql", "markdown") else writer.json if form == "json" else writer.parquet)(f"{path}/{name}")
    made = quality.manifest(tables)
    made.coalesce(1).write.mode("errorifexists").json(f"{path}/_manifest")
    return made


def scrub_tree(value, clean):
    """A JSON value with every key and string cleaned; keys that become alike get a number."""
    if isinstance(value, str):
        return clean(value)
    if isinstance(value, list):
        return [scrub_tree(x, clean) for x in value]
    if not isinstance(value, dict):
        return value
    out: dict = {}
    for key, inner in value.items():
        name = new = clean(key)
        n = 2
        while new in out:
            new, n = f"{name}~{n}", n + 1
        out[new] = scrub_tree(inner, clean)
    return out


def sweep(files: DataFrame) -> DataFrame:
    """path, state (clean, changed, parse-error), payload of JSON files (path, payload) after redaction."""
    from ..functions.text import redact_text

    def run(parts):
        for pdf in parts:
            rows = []
            for path, payload in zip(pdf["path"], pdf["payload"]):
                try:
                    before = json.loads(payload)
                except (TypeError, ValueError):
                    rows.append((path, "parse-error", payload))
                    continue
                after = scrub_tree(before, lambda s: redact_text(s)[0])
                rows.append((path, "clean", payload) if after == before else (path, "changed", json.dumps(after, ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["path", "state", "payload"])

    return files.select("path", "payload").mapInPandas(run, "path string, state string, payload string")
