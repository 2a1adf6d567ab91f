import json
import random
import sqlite3
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recordloom.operators.chains import walk
from recordloom.operators.ranges import range_join
from recordloom.sources import ingest, sqlite, trees
from recordloom.sources.sqlite import SqliteSource
from recordloom.streaming import sessions


def test_walk_equals_a_guarded_walk(spark):
    rng = random.Random(1)
    pointers, starts, want = [], [], {}
    for c in range(40):
        n = rng.choice((1, 2, 5, 33, 70))
        to = {i: rng.choice((i - 1, i - 1, rng.randrange(n))) if i and rng.random() < 0.97 else None for i in range(n)}
        if c % 5 == 0:
            to[0] = n - 1  # a circle
        pointers += [(c, str(i), None if t is None else str(t)) for i, t in to.items()]
        at, place = n - 1, 0
        starts.append((c, str(at)))
        while at is not None and (c, str(at)) not in want:
            want[c, str(at)] = place
            at, place = to.get(at), place + 1
    pointers.append((99, "x", "y"))
    starts += [(99, "x"), (100, "lone"), (101, None)]
    want |= {(99, "x"): 0, (99, "y"): 1, (100, "lone"): 0}
    got = walk(spark.createDataFrame(pointers, "chain long, node string, to string"), spark.createDataFrame(starts, "chain long, node string"))
    assert {(r["chain"], r["node"]): r["place"] for r in got.collect()} == want


def _export(rng, c):
    n = rng.choice((1, 3, 8))
    nodes = {}
    for i in range(n):
        message = {"author": {"role": rng.choice(["user", "assistant", "System", "tool", None])}, "create_time": rng.choice([i, 1.7e12 + i, None]), "content": rng.choice([{"parts": [f"m{i}", {"text": "x"}]}, "plain", {"parts": []}, None])}
        if rng.random() < 0.1:
            message["metadata"] = {"is_visually_hidden_from_conversation": True}
        nodes[f"n{i}"] = {"id": f"n{i}", "parent": f"n{rng.choice((i - 1, max(0, i - 2)))}" if i else rng.choice([None, "gone"]), "message": message if i or rng.random() < 0.5 else None}
    return {"id": f"s{c}", "title": f"t{c}", "current_node": f"n{n - 1}", "mapping": nodes}


def test_chat_trees_equal_the_parser(spark):
    rng = random.Random(4)
    files = [(f"/x/{k}.json", json.dumps([_export(rng, 10 * k + j) for j in range(3)])) for k in range(20)]
    files += [("/x/one.json", json.dumps(_export(rng, 900))), ("/x/bad.json", "{"), ("/x/other.json", '[{"chat_messages": []}]'), ("/x/null.json", None)]
    got = trees.chat_sessions(spark.createDataFrame(files, "path string, payload string")).orderBy("session_id", "ordinal").collect()
    want = sorted((r for p, t in files if t for r in ingest.parse_export(t, "chatgpt", p)), key=lambda r: (r[0], r[2]))
    assert [(r["session_id"], r["title"], r["role"], r["ts"], r["content"]) for r in got] == [(r[0], r[1], r[3], r[4], r[5]) for r in want] and len(want) > 30


def test_a_conversation_without_a_current_node_goes_by_time(spark):
    conv = _export(random.Random(9), 1)
    conv["current_node"] = "absent"
    conv["mapping"] = {f"k{i}": {"parent": None, "message": {"author": {"role": "user"}, "create_time": 10 - i, "content": f"m{i}"}} for i in range(4)}
    got = trees.chat_sessions(spark.createDataFrame([("/x", json.dumps([conv]))], "path string, payload string")).orderBy("ordinal").collect()
    assert [r["content"] for r in got] == ["m3", "m2", "m1", "m0"]


def test_range_join_equals_all_pairs(spark):
    rng = random.Random(6)
    most = 2**63 - 1
    spans = [(k, a, a + rng.choice((0, 1, 2, 7, 100, 5000, 10**12))) for k, a in enumerate(rng.randint(-6000, 6000) for _ in range(150))]
    spans += [(500, 9, 3), (501, None, 4), (502, 5, None), (503, -most - 1, most), (504, most, most), (505, -1, 0), (506, -most, 0)]
    values = [(rng.randint(-7000, 7000),) for _ in range(300)] + [(None,), (most,), (-most - 1,), (0,), (0,)]
    points, table = spark.createDataFrame(values, "v long"), spark.createDataFrame(spans, "k long, low long, high long")
    joined = range_join(points, table, "v", "low", "high")
    assert sorted((r["v"], r["k"]) for r in joined.collect()) == sorted((v, k) for (v,) in values for k, a, b in spans if None not in (v, a, b) and a <= v <= b)
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    few = spark.createDataFrame(spans[:60], "k long, low long, high long").filter("high - low < 200")
    held = [(a, b) for _, a, b in spans[:60] if b - a < 200]
    semi = sorted(r["v"] for r in range_join(points, few, "v", "low", "high", "left_semi").collect())
    assert semi == sorted(v for (v,) in values if v is not None and any(a <= v <= b for a, b in held))
    assert range_join(points, table.limit(0), "v", "low", "high").count() == 0 and range_join(points, table.limit(0), "v", "low", "high", "left_semi").count() == 0
    with pytest.raises(ValueError):
        range_join(points.withColumn("k", F.lit(1)), table, "v", "low", "high")


KINDS = "a long, b int, c double, d string, e binary, f boolean, g timestamp, h date"


def test_sqlite_round_trip(spark, tmp_path):
    spark.dataSource.register(SqliteSource)
    now = datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [(i, i % 7, i / 3, f"it's \"{i}\" ü", b"\x00\xff", i % 2 == 0, now + timedelta(days=i), now.date()) for i in range(250)] + [(None,) * 8]
    df = spark.createDataFrame(rows, KINDS).repartition(4)
    path = str(tmp_path / "copy")
    write = lambda d, mode: d.write.format("recordloom-sqlite").option("path", path).option("table", "odd \"name").mode(mode).save()
    read = lambda **o: spark.read.format("recordloom-sqlite").options(path=path, table="odd \"name", **o)
    write(df, "overwrite")
    back = read(rows="20").schema(KINDS).load()
    assert back.rdd.getNumPartitions() >= 12  # ranges of 20 rows
    key = lambda r: str(r[0])
    assert sorted(map(tuple, back.collect()), key=key) == sorted((tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in rows), key=key)
    assert sqlite.manifest(path)["rows"] == 251 and read().load().count() == 251
    write(df.limit(5), "append")
    assert sqlite.manifest(path)["rows"] == 256 and read().load().count() == 256
    write(df.limit(3), "overwrite")
    assert sqlite.manifest(path)["rows"] == 3 and read().load().count() == 3
    db = sqlite3.connect(next(iter(sorted((tmp_path / "copy").glob("*.sqlite")))))
    assert [c[1] for c in db.execute('PRAGMA table_info("odd ""name")')] == list("abcdefgh")


def test_sqlite_refuses_and_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(SqliteSource)
    path = str(tmp_path / "copy")
    with pytest.raises(Exception, match="no place in SQLite"):
        spark.range(3).select(F.array("id").alias("x")).write.format("recordloom-sqlite").option("path", path).mode("append").save()
    broken = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken row")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken row"):
        broken.write.format("recordloom-sqlite").option("path", path).mode("append").save()
    assert not list((tmp_path / "copy").glob("*")) and not list((tmp_path / "copy").glob(".*"))
    with pytest.raises(Exception, match="no SQLite file|No such file|FileNotFound"):
        spark.read.format("recordloom-sqlite").option("path", path).load()


RULES = sessions.Rules(turns=4, tools=5, least=2, runs=3, gap=3, lock=50_000, idle=300_000)
LONG = sessions.Rules(turns=4, tools=5, least=2, runs=30, gap=3, lock=280_000, idle=300_000)
START = datetime(2024, 1, 1)


def _events(n=400, seed=2):
    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += rng.choice((1, 5, 20, 20, 120))
        kind = rng.choice(("prompt", "prompt", "prompt", "tool", "done"))
        label = "fix" if kind == "prompt" and rng.random() < 0.4 else None
        rows.append((rng.randrange(4), i, START + timedelta(seconds=at), kind, label, f"text {i}" if label else None))
    return rows


SCHEMA = "session_id long, event_id long, at timestamp, kind string, label string, text string"


def test_outcomes_of_one_session():
    s = sessions.Session()
    take = lambda i, at, kind="prompt", label=None: [(o, n) for _, o, n, _ in s.take(i, at, kind, label, "t", RULES)]
    assert [take(i, i) for i in range(4)] == [[], [], [], [("run", 1)]]
    assert [take(i, i) for i in range(4, 8)] == [[], [], [], [("lock_busy", 1)]]
    assert take(8, 8, "done") == [] and [take(i, i) for i in range(9, 13)][-1] == [("run", 2)]
    assert [take(i, 60_000 + i) for i in range(4)][-1] == [("run", 3)]  # the lock's time is over
    assert take(20, 70_000, label="fix") == [("correction", 17)]
    assert take(21, 70_001, label="fix") == [("rate_limited", 18)] and take(22, 70_002) == [] and take(23, 70_003, "tool", None) == []
    assert ("correction", 20) in take(24, 70_004, label="fix")
    assert take(25, 400_000) == [("closed", 20)] and (s.runs, s.prompts, s.corrected) == (0, 21, 20)  # these never go


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, source, got = _events(), tmp_path / "in", []
    source.mkdir()

    def run(events=None):
        if events is not None:
            spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = sessions.stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source)), LONG, late="1 second")
        q = stream.writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()

    try:
        for cut in (rows[:150], rows[150:260], rows[260:]):
            run(cut)
        end = rows[-1][2] + timedelta(hours=1)
        run([(9, 1000, end, "prompt", None, None)])  # time goes on, so idle sessions close
        run([(9, 1001, end, "tool", None, None)])
    finally:
        spark.conf.unset(key)
    table = spark.createDataFrame([*rows, (9, 1000, end, "prompt", None, None), (9, 1001, end, "tool", None, None)], SCHEMA)
    until = int(end.timestamp() * 1000) - 1000
    want = [tuple(r) for r in sessions.batch(table, LONG, until).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in want} == {"run", "lock_busy", "correction", "rate_limited", "closed"}


def test_a_query_begins_with_known_values(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = []
    try:
        spark.createDataFrame([(1, 1, START, "prompt", "fix", "a"), (2, 2, START, "prompt", "fix", "b")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
        before = spark.createDataFrame([(1, 10, 9)], "session_id long, prompts long, corrected long")
        stream = sessions.stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), RULES, before=before)
        stream.writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key)
    assert sorted(got) == [(1, 1, "rate_limited", 11, None), (2, 2, "correction", 1, "b")]


def test_classified_scrubs_before_it_cuts(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    text = "No, don't use that, use " + "x" * 1965 + " " + key + " please"
    events = spark.createDataFrame([(1, 1, START, "prompt", text), (1, 2, START, "prompt", "thanks"), (1, 3, START, "tool", text), (1, 4, START, "prompt", None)], "session_id long, event_id long, at timestamp, kind string, said string")
    rows = {r["event_id"]: r for r in sessions.classified(events, F.col("said")).collect()}
    assert rows[1]["label"] is not None and len(rows[1]["text"]) == 2000 and "AKIA" not in rows[1]["text"]
    assert all(rows[i]["label"] is None and rows[i]["text"] is None for i in (2, 3, 4))
