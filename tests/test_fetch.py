import re
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from recordloom.operators import hybrid, index, vector

ROWS = [(i, f"p{i % 2}", f"word{i % 5} common " * (i % 7 + 1)) for i in range(200)]


def _index(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame(ROWS, "id long, project string, text string").repartition(2).write.parquet(path)
    rows = spark.read.parquet(path)
    return index.open_index(spark, "fetch", rows.select("id", "text"), ["text"], str(abs(hash(path)))), rows


def _read(df):
    """The scans of the plan: what they read and which filters reach them."""
    return [line for line in df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).split("\n") if "FileScan parquet" in line]


def test_texts_are_read_for_the_winners_alone(spark, tmp_path):
    held, rows = _index(spark, tmp_path)
    best = index.top(held, "word3 OR common", 5, rows=rows)
    scans = [x for x in _read(best) if "text:string" in x or "text#" in x.split("Batched")[0]]
    assert len(scans) == 1 and "In(id" in scans[0]
    plain = index.top(held, "word3 OR common", 5)
    assert [r["id"] for r in best.collect()] == [r["id"] for r in plain.collect()] and best.first()["text"].startswith("word3")
    one = index.top(held, "common", 4, rows=rows, project="p1").collect()
    assert len(one) == 4 and {r["project"] for r in one} == {"p1"} and all(r["text"] for r in one)
    assert index.top(held, "absent", 4, rows=rows).count() == 0


def test_hybrid_reads_the_winners_alone(spark, tmp_path):
    held, rows = _index(spark, tmp_path)
    keyword = index.top(held, "word1", 6).select(F.lit("documents").alias("table"), "id", "rank")
    near = spark.createDataFrame([("documents", 7, 0.9), ("documents", 999, 0.8)], "table string, id long, similarity double")
    docs = hybrid.search_docs({"documents": rows.select("id", "text", F.lit(None).cast("string").alias("provenance")), "others": rows.select("id", "text", F.lit("x").alias("provenance"))})
    got = hybrid.hybrid(keyword, near, docs, 5)
    scans = _read(got)
    assert len(scans) == 1 and "In(id" in scans[0]  # the other table has no winner, and is not read
    found = {r["id"]: r for r in got.collect()}
    assert len(found) == 5 and found[7]["source"] == "vec" and found[7]["content"] and found[999]["content"] == "" and found[999]["provenance"] == "unknown"


def test_hidden_rows_are_in_no_batch(spark, tmp_path):
    held, _ = _index(spark, tmp_path)
    hidden = spark.createDataFrame([(i,) for i in range(0, 200, 2)], "id long")
    queries = spark.createDataFrame([(1, ["word3", "common"])], "query_id long, terms array<string>")
    got = index.search_many(held, queries, 10, hidden).collect()
    every = [r for r in index.search_many(held, queries, 200).orderBy("place").collect() if r["id"] % 2]
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == [r["id"] for r in every][:10]
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "id long, embedding array<double>")
    near = vector.knn_many(vectors.filter("id = 4"), vectors, 3, hidden=spark.createDataFrame([(4,), (5,)], "id long")).orderBy("place").collect()
    assert {r["id"] for r in near} & {4, 5} == set() and len(near) == 3


def test_postings_travel_as_blocks_of_their_terms(spark):
    """Fewer rows are shuffled than there are postings, the postings are those of plain loops, and the terms' numbers of
    rows are right with one column, with two and with an id in two rows."""
    texts = [(i, "tie Été tie " + " ".join(f"w{i % 7}x{k % 5}" for k in range(i % 11)), None if i % 4 == 0 else "tie other") for i in range(300)]
    rows = spark.createDataFrame(texts + [(7, "tie twice", "")], "id long, a string, b string")
    for columns in (["a"], ["a", "b"]):
        got = index.postings(rows, columns)
        expected = []
        for r in rows.collect():
            own = [re.findall(r"\w+", (r[c] or "").lower().replace("é", "e")) for c in columns]
            expected += [(w, r["id"], k, words.count(w), [p for p, x in enumerate(words, 1) if x == w], sum(map(len, own))) for k, words in enumerate(own) for w in set(words)]
        assert sorted((r["term"], r["id"], r["col"], r["tf"], r["positions"], r["len"]) for r in got.collect()) == sorted(expected)
        opened = index.open_index(spark, "blocks" + "".join(columns), rows, columns, uuid.uuid4().hex)
        df = {}
        for w, i, *_ in expected:
            df.setdefault(w, set()).add(i)
        assert {r["term"]: r["df"] for r in opened.terms.collect()} == {w: len(x) for w, x in df.items()}
        assert opened.n == 301 and abs(opened.mean - sum(e[3] for e in expected) / 301) < 1e-9
    blocks = index._blocks(pa.array([5, 6, 7]), [pa.array([["a", "b", "a"], [], ["a"]])])
    assert blocks.num_rows == 2 and blocks.column("ids").to_pylist() == [[5, 7], [5]]
