"""Every registered query against its SQL at the smallest scale, and the search language against SQLite's FTS5."""

import os
import sqlite3

import duckdb
import pytest

from recordloom.operators import search
from recordloom.plans import catalog

DIR = "/root/testdata/sf0.001"


def _show(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(round(r[i], 6) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_same_as_sql(spark, db, name):
    df = catalog.queries()[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql:
        got = db.execute(sql)
        names = [c[0] for c in got.description]
        assert sorted(names) == sorted(df.columns)
        assert _show(rows, df.columns) == _show(got.fetchall(), names)


ROWS = [(1, "alpha beta gamma", "x"), (2, "beta alpha", "alpha"), (3, "Été naïve_x", "beta beta"), (4, "alpha gamma delta epsilon beta", None), (5, "", "delta"), (6, "zeta eta theta", "the alpha"), (7, "eta", "iota")]
QUERIES = ["alpha", "alpha OR delta", "alpha beta", '"alpha beta"', "alpha + beta", "alp*", "ete", "alpha NOT gamma", "alpha OR (beta AND zeta)", "a:alpha", "{a b} : beta", "^alpha", "alpha beta OR iota", "alpha alpha", "NEAR(alpha beta, 2)", "iota OR eta NOT zeta"]


@pytest.mark.parametrize("query", QUERIES)
def test_language_like_fts5(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(a, b)")
    con.executemany("INSERT INTO f (rowid, a, b) VALUES (?, ?, ?)", ROWS)
    expected = {r[0]: round(r[1], 6) for r in con.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (query,))}
    df = spark.createDataFrame(ROWS, "id long, a string, b string")
    got = {r["id"]: round(r["rank"], 6) for r in search.bm25(df, query, ["a", "b"]).collect()}
    assert got == expected


@pytest.mark.parametrize("query", ["foo-bar", "what?", "", "AND NOT", "(a", "nope:x", "a OR"])
def test_language_errors(query):
    with pytest.raises(search.QueryError):
        search.Parser(query, ["a", "b"]).parse()


def test_plans_keep_pushdown(spark, capsys):
    catalog.queries()["dedup_apply_visible"](spark, DIR).explain()
    plan = capsys.readouterr().out
    assert "LeftAnti" in plan and "CartesianProduct" not in plan
