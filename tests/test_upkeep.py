"""Extraction markdown, further source formats, sinks and the state of an index on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from recordloom.functions import extraction
from recordloom.operators import upkeep
from recordloom.sources import formats, trees

TEXT = """## ONE SENTENCE SUMMARY

Moved the cache.

## DECISIONS MADE

- Use **one** table | not two (confidence: HIGH)
- Keep the old path: for now

## ERRORS FIXED

- Lock "timeout": raise the limit: twice
- no colon here

## MAIN IDEAS

- Batches are small
- tiny

## INSIGHTS
- Batches are small
"""


def test_extraction_parts(spark):
    c = F.col("x")
    row = spark.createDataFrame([(TEXT,), (None,), ("",)], "x string").select(
        extraction.summary_line(c, "p").alias("s"), extraction.decisions(c).alias("d"), extraction.lessons(c).alias("l"), extraction.ideas(c).alias("i"), extraction.topics(c).alias("t"), extraction.token_estimate(c).alias("n")
    ).collect()
    assert row[0]["s"] == "Moved the cache."
    assert [tuple(x) for x in row[0]["d"]] == [("Use one table / not two", "high"), ("Keep the old path: for now", "medium")]
    assert [tuple(x) for x in row[0]["l"]] == [('Lock "timeout"', "raise the limit: twice", "lock timeout")]
    assert row[0]["i"] == ["Batches are small"] and "Keep the old path" in row[0]["t"] and row[0]["t"].count("Batches are small") == 1
    for other in row[1:]:
        assert other["s"] == "p session" and not other["d"] and not other["l"] and not other["t"] and other["n"] == 0


def test_markdown_drops(spark):
    files = [("/a/one.md", "intro\n[USER 12:00]: please move the cache\n[assistant]: done, moved it now\n[USER]: ok"), ("/a/two.md", "# T\n## User\nplease move the cache\n\n## Assistant\ndone, moved it now\n"), ("/a/none.md", "only text"), ("/a/null.md", None)]
    got = [tuple(r) for r in formats.markdown_drops(spark.createDataFrame(files, "path string, text string")).orderBy("session_id", "ordinal").drop("ordinal").collect()]
    assert got == [(s, r, t) for s in ("one", "two") for r, t in (("user", "please move the cache"), ("assistant", "done, moved it now"))]


def test_tool_sessions(spark):
    payload = {"info": {"id": "s1"}, "messages": [{"info": {"role": "user"}, "parts": [{"text": "hello"}, {"filename": "a.txt"}]}, {"info": {"role": "assistant"}, "parts": [{"text": " "}]}, {"parts": [{"state": {"title": "ls", "output": "a.txt"}}]}]}
    df = spark.createDataFrame([("/x/f.json", json.dumps(payload)), ("/x/bad.json", "{")], "path string, payload string")
    assert [tuple(r) for r in formats.tool_sessions(df).orderBy("ordinal").collect()] == [("s1", 0, "user", "hello\n\n[file: a.txt]"), ("s1", 2, "unknown", "[tool: ls]\n\na.txt")]


def test_active_branch(spark):
    rows = [("f", 0, "a", None), ("f", 1, "b", "a"), ("f", 2, "c", "a"), ("f", 3, "d", "b"), ("f", 4, "e", "c"), ("g", 0, "z", None)]
    got = trees.active_branch(spark.createDataFrame(rows, "path string, line int, id string, parent string")).orderBy("path", "depth").collect()
    assert [(r["path"], r["id"]) for r in got] == [("f", "a"), ("f", "c"), ("f", "e"), ("g", "z")]


def test_archive_sections(spark):
    text = "# Archive\n\n## Extracted: 2026-01-02 | alpha\nONE SENTENCE SUMMARY\nFirst thing\nbody\n---\n## Extracted: 2026-01-03 | beta\nplain\n---\n## Extracted: 2026-01-04 | empty\n\n---\n"
    got = formats.archive_sections(spark.createDataFrame([(text,)], "text string")).orderBy("day").collect()
    assert [(str(r["day"]), r["project"], r["title"]) for r in got] == [("2026-01-02", "alpha", "First thing"), ("2026-01-03", "beta", "Legacy extract from beta")]
    assert got[1]["content"] == "plain"


def test_export_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "it's", None), (2, None, [1.5])], "id long, name string, v array<double>")
    for form in ("json", "markdown", "sql", "parquet"):
        made = formats.export({"t": rows}, str(tmp_path / form), form).first()
        assert made["n"] == 2
        with pytest.raises(Exception):
            formats.export({"t": rows}, str(tmp_path / form), form)
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "sql" / "t")).collect())
    assert lines == ["INSERT INTO t (id, name, v) VALUES (1, 'it''s', NULL);", "INSERT INTO t (id, name, v) VALUES (2, NULL, '[1.5]');"]
    assert spark.read.parquet(str(tmp_path / "parquet" / "t")).exceptAll(rows).count() == 0
    with pytest.raises(ValueError):
        formats.export({"t": rows}, str(tmp_path / "x"), "xml")


def test_sweep(spark):
    df = spark.createDataFrame([("a", json.dumps({"k": "plain"})), ("b", json.dumps({"k": ["password = hunter22x", 1]})), ("c", "{")], "path string, payload string")
    got = {r["path"]: (r["state"], r["payload"]) for r in formats.sweep(df).collect()}
    assert got["a"][0] == "clean" and got["c"] == ("parse-error", "{")
    assert got["b"][0] == "changed" and "hunter22x" not in got["b"][1]
    assert formats.scrub_tree({"x1": "a", "x2": "b"}, lambda s: "x" if s.startswith("x") else s) == {"x": "a", "x~2": "b"}


def test_index_state(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "id long, text string")
    index = upkeep.index_rows(rows, ["text"])
    assert upkeep.index_state(rows, index, ["text"]).first()["state"] == "ok"
    assert upkeep.index_state(rows, None, ["text"]).first()["state"] == "missing-index"
    changed = upkeep.index_state(rows.filter("id < 3").withColumn("text", F.lit("z")), index, ["text"]).first()
    assert (changed["lacking"], changed["differing"], changed["surplus"], changed["state"]) == (0, 2, 1, "drift")


def test_similar_query():
    assert upkeep.similar_query('use the "new cache layer') == '"cache" OR "layer"'
    assert upkeep.similar_query("a b") == ""
