import os

import duckdb
import pytest
from pyspark.sql import functions as F

from recordloom.functions import extraction
from recordloom.operators import policies
from recordloom.plans import catalog

DIR = "/root/testdata/sf0.001"

BEST = "place int, table string, id long, project string, importance int, day string, content string"


def test_days():
    assert policies.days_of("90d") == 90 and policies.days_of("0d") == 0
    for bad in ("90", "d", "-1d", "90 d", "9w", "", "٣d"):
        with pytest.raises(ValueError):
            policies.days_of(bad)


def test_a_context_within_its_budgets(spark):
    rows = [(1, "loa", 7, "p", 9, "2024-01-02", "x" * 221), (2, "messages", 8, None, None, None, "short")]
    r = policies.context_text(spark.createDataFrame(rows, BEST), "I am", "p").first()
    lines = r["text"].split("\n")
    assert lines[:7] == [policies.HEAD, "**Project:** p", "", policies.IDENTITY, "I am", "", policies.RANKED]
    assert lines[7] == f"- **[loa#7]** [p] ★9 2024-01-02: {'x' * 220}…" and lines[8] == "- **[messages#8]**   : short"
    assert lines[-2:] == ["---", policies.MORE] and (r["lines"], r["kept"]) == (2, 2)


def test_budgets_cut(spark):
    rows = [(i, "loa", i, "p", 5, "2024-01-01", "y" * 200) for i in range(12)]
    df = spark.createDataFrame(rows, BEST)
    r = policies.context_text(df, "z" * 5000, None, policies.Budget(ranked=700, total=50_000)).first()
    assert r["kept"] == 4 and r["text"].count("- **[") == 4 and r["text"].count("z") == 1200  # the reserved lines stay
    cut = policies.context_text(df, "", None, policies.Budget(total=300)).first()["text"]
    assert cut == policies.context_text(df).first()["text"][:300] + policies.CUT
    none = policies.context_text(df.limit(0)).first()
    assert (none["lines"], none["kept"]) == (0, 0) and policies.RANKED not in none["text"]


def test_guards_hold_rows_back(spark):
    rows = spark.createDataFrame([(i, "p", 10 + i, 3, 5 * i) for i in range(5)] + [(9, None, 10, None, 7), (10, "p", 10, 10, 7)], "id long, project string, minute long, importance int, chars int")
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    clusters, report = policies.consolidation_plan(rows, one(4), one(0, 99), 1, 1000)
    assert [(r["project"], r["n"], r["representative"]) for r in clusters.collect()] == [("p", 3, 3)]
    assert tuple(report.first()) == (5, 3, 2)


def test_known_provenance_never_changes(spark):
    rows = spark.createDataFrame([(1, "auto-extracted", None), (2, None, None), (3, "auto-extracted", "derived"), (4, "x", None)], "id long, category string, provenance string")
    plan, report = policies.provenance_rules({"decisions": rows, "messages": rows})
    assert sorted(tuple(r) for r in plan.collect()) == [("decisions", 1, "extracted"), ("messages", 1, "verbatim"), ("messages", 2, "verbatim"), ("messages", 4, "verbatim")]
    assert sorted(tuple(r) for r in report.collect()) == [("decisions", "extracted", 3, 1, 2), ("messages", "verbatim", 3, 3, 0)]


def test_import_outlines(spark):
    texts = ["## TOPICS\n- **A b**: c\n* a\n- A b\n\n## MAIN IDEAS\n- d: e\n## X\n- f", "## One Sentence Summary\n- said so\nmore\n## TOPICS\n" + "\n".join(f"- t{i}" for i in range(12)), None, ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(extraction.import_summary(F.col("t")).alias("s"), extraction.import_topics(F.col("t")).alias("x"), "i").orderBy("i").collect()
    assert [r["s"] for r in got] == ["Imported conversation", "said so", "Imported conversation", "Imported conversation"]
    assert got[0]["x"] == ["A b", "a", "d"] and got[1]["x"] == [f"t{i}" for i in range(8)] and got[2]["x"] == [] == got[3]["x"]


def test_broken_references_stay_broken_in_large_tables(spark, tmp_path):
    """Conversations of 50,000 and more, as at 60 times sf0.1: their messages' ids reach past 50,000,000."""
    db = duckdb.connect()
    for f in os.listdir(DIR):
        name = f.split(".")[0]
        os.symlink(f"{DIR}/{f}", tmp_path / f)
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{f}'")
    os.unlink(tmp_path / "conversations.parquet")
    db.execute(f"COPY (SELECT conv_id + k * 50000 AS conv_id, turn, role, text FROM conversations, range(2) t(k)) TO '{tmp_path}/conversations.parquet' (FORMAT parquet)")
    db.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    got = catalog.queries()["integrity_all_checks"](spark, str(tmp_path))
    result = db.execute(catalog.oracle_sql()["integrity_all_checks"])
    names = [c[0] for c in result.description]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(result.fetchall())
