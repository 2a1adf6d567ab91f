import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from recordloom.operators import cells, dedup, lifecycle
from recordloom.sources import store


def _swept(pairs, order):
    """The sequential sweep, in plain loops."""
    gone, kept, out = set(), set(), []
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        keep, drop = (a, b) if order[a] < order[b] else (b, a)
        if keep in gone or drop in gone or drop in kept:
            continue
        kept.add(keep)
        gone.add(drop)
        out.append((keep, drop, s))
    return sorted(out)


def _led(pairs):
    near, leader = {}, {}
    for a, b, _ in pairs:
        near.setdefault(a, []).append(b)
    for a in sorted(near):
        if a not in leader:
            new = [b for b in near[a] if b not in leader]
            leader.update((b, a) for b in new)
            if new:
                leader[a] = a
    return leader


def _graphs():
    rng = random.Random(21)
    out = []
    for n, edges in ((30, 60), (60, 70), (25, 200)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(edges)}
        out.append([(a, b, rng.choice((0.95, 0.96, 0.97, 1.0))) for a, b in pairs])
    out.append([(0, i, 0.99) for i in range(1, 30)] + [(i, i + 1, 0.96) for i in range(1, 6)])  # a hub
    out.append([(i, i + 1, 0.9 + i / 1000) for i in range(8)])  # a chain
    return out


@pytest.mark.parametrize("finish", [100_000, 0])
def test_rounds_equal_the_sweep(spark, finish):
    rng = random.Random(2)
    every, rows = [], []
    for k, pairs in enumerate(_graphs()):  # all graphs at once, as projects
        every += [(1000 * k + a, 1000 * k + b, s) for a, b, s in pairs]
    ids = sorted({x for a, b, _ in every for x in (a, b)})
    rows = [(i, f"p{i // 1000}", rng.choice(("verbatim", None, "derived")), rng.randint(1, 3), 5, rng.choice((1, 2, None))) for i in ids]
    rank = {"verbatim": 1, "derived": 3, None: 4}
    order = {r[0]: (rank[r[2]], -r[3], -(r[5] if r[5] is not None else -math.inf), r[0]) for r in rows}
    pairs = spark.createDataFrame(every, "a long, b long, similarity double")
    table = spark.createDataFrame(rows, "id long, project string, provenance string, chars int, importance int, minute int")
    got = sorted(tuple(r) for r in dedup.mark_greedily(pairs, table, finish).collect())
    assert got == _swept(every, order)
    assert {r["id"]: r["leader"] for r in lifecycle.leader_clusters(pairs, finish=finish).collect()} == _led(every)


def test_rounds_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b long, similarity double")
    rows = spark.createDataFrame([], "id long, project string, provenance string, chars int, importance int, minute int")
    assert dedup.mark_greedily(none, rows).count() == 0 and lifecycle.leader_clusters(none).count() == 0


def test_clusters_of_a_least_size(spark):
    pairs = spark.createDataFrame([(1, 2, 1.0), (3, 4, 1.0), (3, 5, 1.0)], "a long, b long, similarity double")
    assert sorted(r["id"] for r in lifecycle.leader_clusters(pairs, least=3).collect()) == [3, 4, 5]


def _vectors(n, dims, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    return [(centres[rng.integers(8)] + spread * rng.normal(size=dims)).tolist() for _ in range(n)]


@pytest.mark.parametrize(("threshold", "block", "per_cell"), [(0.95, 2048, 20), (0.95, 7, 20), (-0.2, 16, 50)])
def test_similar_pairs_equal_all_pairs(spark, threshold, block, per_cell):
    vectors = _vectors(160, 6, 5, 0.25)
    vectors[10], vectors[11] = vectors[12], vectors[12]
    rows = [(i, [None, "p", "q"][i % 3], f"k{i if i != 11 else 10}", v) for i, v in enumerate(vectors)]
    rows += [(900, "p", "z", [0.0] * 6), (901, "p", "n", None), (902, "p", "i", [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "id long, project string, key string, embedding array<double>").repartition(4)
    got = sorted((r["a"], r["b"]) for r in cells.similar_pairs(df, threshold, per_cell, block).collect())
    u = [np.array(v) / np.linalg.norm(v) for v in vectors]
    want = sorted((a, b) for a in range(160) for b in range(a + 1, 160) if rows[a][1] == rows[b][1] and rows[a][2] != rows[b][2] and round(float(u[a] @ u[b]), 12) >= threshold)
    assert got == want and len(want) > 10
    assert cells.similar_pairs(df.limit(0), threshold).count() == 0


def test_rows_visit_only_cells_they_can_meet(spark, monkeypatch):
    vectors = _vectors(800, 6, 9, 0.02)  # eight tight groups
    df = spark.createDataFrame([(i, "p", str(i), v) for i, v in enumerate(vectors)], "id long, project string, key string, embedding array<double>")
    copies, plain = [], store.staged
    monkeypatch.setattr(cells.store, "staged", lambda d, name: copies.append((name, plain(d, name))) or copies[-1][1])
    cells.similar_pairs(df, 0.995, 50).count()
    moved = dict(copies)["visits"]
    groups = moved.filter("home").count(), moved.filter("NOT home").count()
    assert groups[0] == 800 and groups[1] < 800 * 15 / 4  # of up to 15 other cells
    with pytest.raises(ValueError):
        cells.similar_pairs(df.unionByName(spark.createDataFrame([(9999, "p", "x", [1.0])], df.schema)), 0.9)


def test_visits_are_made_of_few_rows_at_a_time():
    """The same visits as plain loops, from arrays alone: no Python object for each row and cell."""
    rng, pivots = np.random.default_rng(3), cells._unit(np.array(_vectors(40, 6, 4, 0.6)))
    units = np.array(_vectors(200, 6, 5, 0.6))
    near = cells._angles(cells._unit(units), pivots)
    home, every = near.argmin(axis=1), [{"cell": int(c), "radius": float(rng.uniform(0, 1)), "blocks": int(c) + 1} for c in rng.permutation(40)]
    kind = pa.list_(pa.struct([("cell", pa.int32()), ("radius", pa.float64()), ("blocks", pa.int32())]))
    rows = pa.RecordBatch.from_pydict({"id": pa.array(range(200)), "project": ["p"] * 200, "key": ["k"] * 200, "embedding": pa.array(units.tolist(), pa.list_(pa.float64())), "cell": pa.array(home, pa.int32()), "angle": near.min(axis=1), "cells": pa.array([every] * 200, kind)})
    got = [r for at in range(0, 200, 64) for r in cells._visits(rows.slice(at, 64), pivots, 0.3).select(["id", "there", "blocks", "home"]).to_pylist()]
    want = [(i, o["cell"], o["blocks"], o["cell"] == home[i]) for i in range(200) for o in every if o["cell"] == home[i] or o["cell"] > home[i] and near[i, o["cell"]] <= o["radius"] + 0.3 and near[i, o["cell"]] - near[i, home[i]] <= 0.6]
    assert [tuple(r.values()) for r in got] == want and len(want) > 300
    assert 0 < cells.TRAVELLERS <= 256


def test_vector_index_equals_brute_force(spark):
    vectors = _vectors(1500, 8, 11, 0.1)
    rows = [(i, v) for i, v in enumerate(vectors)] + [(5000, [0.0] * 8), (5001, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    ix = cells.VectorIndex.build(spark, "test-tight", df, "v1", rows_per_cell=60)
    u = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    less = 0
    for q in (vectors[3], vectors[700], np.ones(8).tolist(), (-np.array(vectors[9])).tolist()):
        s = u @ (np.array(q) / np.linalg.norm(q))
        want = sorted(range(1500), key=lambda i: (-s[i], i))[:7]
        found = cells.search(ix, df, "v1", q, 7)
        assert found.tier == "knn" and [r["id"] for r in found.rows.orderBy("similarity", ascending=False).collect()] == want
        less += found.read < found.of / 2
        brute = cells.search(ix, df, "v2", q, 7)
        assert brute.tier == "bruteforce" and [r["id"] for r in brute.rows.collect()] == want
    assert less >= 2
    hidden = spark.createDataFrame([(i,) for i in range(0, 1500, 2)], "id long")
    s = u @ (np.array(vectors[3]) / np.linalg.norm(vectors[3]))
    assert [r["id"] for r in cells.search(ix, df, "v1", vectors[3], 5, hidden).rows.collect()] == sorted(range(1, 1500, 2), key=lambda i: (-s[i], i))[:5]


def test_tiers_fall_back(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    empty = cells.VectorIndex.build(spark, "test-empty", df.limit(0), "v1")
    assert cells.search(empty, df, "v1", [1.0, 0.1], 1).tier == "bruteforce"  # an empty index while vectors are there has failed
    assert cells.search(None, df, "v1", [1.0, 0.1], 1).rows.first()["id"] == 1
    assert cells.search(None, df.limit(0), "v1", [1.0, 0.1], 1).tier == "none"
    assert cells.search(None, df, "v1", [0.0, 0.0], 1).tier == "none"
    ix = cells.VectorIndex.build(spark, "test-two", df, "v1")
    assert cells.search(ix, df, "v1", [1.0, 0.0, 0.0], 1).tier == "none"  # no vector of that length
    assert cells.search(ix, df, "v1", [1.0, 0.1], 5).rows.count() == 2


def test_rows_without_clusters_are_copied_a_few_times(spark, monkeypatch):
    units = np.random.default_rng(6).normal(size=(12_000, 16))
    df = spark.createDataFrame([(i, f"p{i % 6}", str(i), v) for i, v in enumerate(units.tolist())], "id long, project string, key string, embedding array<double>")
    copies, plain = [], store.staged
    monkeypatch.setattr(cells.store, "staged", lambda d, name: copies.append((name, plain(d, name))) or copies[-1][1])
    found = cells.similar_pairs(df, 0.8)
    assert dict(copies)["visits"].count() < 2 * 12_000
    u = units / np.linalg.norm(units, axis=1, keepdims=True)
    p, q = np.nonzero(np.triu(u @ u.T >= 0.8, 1))
    assert sorted((r["a"], r["b"]) for r in found.collect()) == [(a, b) for a, b in zip(p.tolist(), q.tolist()) if a % 6 == b % 6]


def test_pairs_of_a_dense_tile_come_in_pieces_and_tie_as_in_sql():
    values = np.random.default_rng(4).normal(size=(40, 24)).astype(np.float32)
    values = values[np.arange(900) % 40]  # copies: all pairs of two vectors have one cosine, wherever they lie
    names = pa.array(["k"] * 900).dictionary_encode().cast(pa.string())
    t = pa.table({"id": pa.array(range(900)), "key": pc.binary_join_element_wise(names, pa.array(range(900)).cast(pa.string()), ""), "done": [False] * 900, "embedding": pa.array(values.tolist(), pa.list_(pa.float32())), "x": [0] * 900, "y": [0] * 900, "side": [1] * 900})
    parts = list(cells._met(t, -1.0))
    assert max(len(a) for a, _, _ in parts) <= cells.PIECE and sum(len(a) for a, _, _ in parts) == 900 * 899 // 2
    seen = {}
    for a, b, s in parts:
        for x, y, v in zip(a % 40, b % 40, s):
            seen.setdefault((min(x, y), max(x, y)), set()).add(v)
    assert all(len(v) == 1 for v in seen.values())
    x, y = values[3].astype(float), values[5].astype(float)

    def dot(u, v):  # sum() of floats would carry what is rounded off
        total = 0.0
        for c, d in zip(u.tolist(), v.tolist()):
            total += c * d
        return total

    assert seen[3, 5] == {dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y)))}
