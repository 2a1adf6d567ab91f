"""Greedy sweeps over a sparse list of pairs, as rounds of DataFrames that give what the sequential sweep gives.

A round decides whatever no undecided pair or row that comes before can change any more, and drops what that decides.
In each round at least the first of all is decided; with an order that has nothing to do with how rows hang together,
the number of rounds grows with the logarithm of the pairs. Once at most `finish` pairs are left, one task sweeps those:
that bound is checked by a count, and a chain that would take a round for each of its pairs ends there too. Every round
is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import drop_staged, staged


def _swept(left: DataFrame, sweep: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """sweep() over pairs whose number is known to be small, in one task."""

    def run(batches):
        parts = list(batches)
        if parts:
            yield sweep(pd.concat(parts, ignore_index=True))

    return left.coalesce(1).mapInPandas(run, schema)


def _mark(pairs: pd.DataFrame) -> pd.DataFrame:
    duplicates, survivors, out = set(), set(), []
    for r in pairs.sort_values(["similarity", "a", "b"], ascending=[False, True, True]).itertuples():
        if r.keep in duplicates or r.drop in duplicates or r.drop in survivors:
            continue
        survivors.add(r.keep)
        duplicates.add(r.drop)
        out.append((r.keep, r.drop, r.similarity))
    return pd.DataFrame(out, columns=["survivor", "id", "similarity"])


def marks(pairs: DataFrame, finish: int = 100_000) -> DataFrame:
    """survivor, id, similarity of the pairs (a, b, similarity, keep, drop) that mark `drop` a duplicate: strongest pair
    first (then smallest a, b), unless `keep` is a duplicate by then, or `drop` a duplicate or a survivor. A row's first mark is
    final, so a pair is decided when it is the strongest that `drop` has left, and `keep` is a survivor already or has no stronger pair either.
    If the pairs have a column `sure`, it says whose `keep` is a survivor from the start."""
    sure = F.col("sure") if "sure" in pairs.columns else F.lit(False).alias("sure")
    key: Column = F.struct((-F.col("similarity")).alias("s"), "a", "b")
    left = staged(pairs.select("a", "b", "similarity", "keep", "drop", sure, key.alias("key")), "pairs")
    out = []
    while (n := left.count()) > finish:
        best = staged(left.select(F.col("keep").alias("node"), "key").unionByName(left.select(F.col("drop").alias("node"), "key")).groupBy("node").agg(F.min("key").alias("best")), "best")
        of = lambda c: best.select(F.col("node").alias(c), F.col("best").alias(f"best_{c}"))
        acts = left.join(of("drop"), "drop").filter("key = best_drop").join(of("keep"), "keep").filter("sure OR key = best_keep")
        done = staged(acts.select(F.col("keep").alias("survivor"), F.col("drop").alias("id"), "similarity"), "marks")
        out.append(done)
        known = staged(done.select(F.col("survivor").alias("node"), F.lit(False).alias("gone")).distinct().unionByName(done.select(F.col("id").alias("node"), F.lit(True).alias("gone"))), "known")
        stays = left.join(known.select(F.col("node").alias("drop")), "drop", "left_anti").join(known.select(F.col("node").alias("keep"), "gone"), "keep", "left")
        after = staged(stays.filter("NOT coalesce(gone, false)").select("a", "b", "similarity", "keep", "drop", (F.col("sure") | F.col("gone").isNotNull()).alias("sure"), "key"), "pairs")
        drop_staged(left, best, known)
        left = after
    if n:
        out.append(_swept(left.select("a", "b", "similarity", "keep", "drop"), _mark, "survivor long, id long, similarity double"))
    return _union(out, pairs, "survivor long, id long, similarity double")


def _members(pairs: pd.DataFrame) -> pd.DataFrame:
    near, members = {}, set()
    for a, b in zip(pairs["a"], pairs["b"]):
        near.setdefault(a, []).append(b)
    for a in sorted(near):
        if a not in members:
            members.update(near[a])
    return pd.DataFrame({"id": sorted(members)})


def leaders(pairs: DataFrame, finish: int = 100_000) -> DataFrame:
    """leader, id: in id order a row that no leader has taken becomes a leader and takes the later rows near it that none
    has (pairs a < b). A row is a leader as soon as no earlier row near it is undecided, and taken as soon as one is a leader; whose
    it is, is known when all are decided: that of its smallest leader. Leaders are listed with themselves, if they have anyone."""
    every = staged(pairs.select("a", "b"), "pairs")
    left, taken = every, []
    while (n := left.count()) > finish:
        first = left.select(F.col("a").alias("id")).distinct().join(left.select(F.col("b").alias("id")), "id", "left_anti")
        first = staged(first, "leaders")
        now = staged(left.join(first.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "taken")
        taken.append(now)
        known = first.unionByName(now)
        after = staged(left.join(known.select(F.col("id").alias("a")), "a", "left_anti").join(known.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b"), "pairs")
        drop_staged(first, *([left] if left is not every else []))
        left = after
    if n:
        taken.append(_swept(left, _members, "id long"))
    members = staged(_union(taken, pairs, "id long"), "members")
    free = every.join(members.select(F.col("id").alias("a")), "a", "left_anti")  # pairs whose first row is a leader
    own = free.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    own = staged(own.select("leader", "id"), "clusters")
    return own.unionByName(own.select("leader", F.col("leader").alias("id")).distinct())


def _union(parts: list[DataFrame], like: DataFrame, schema: str) -> DataFrame:
    out = like.sparkSession.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out
