"""Walks along pointers by doubling: chains of any length in rounds that grow with the logarithm of the longest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import drop_staged, staged


def walk(pointers: DataFrame, starts: DataFrame, most_rounds: int = 62) -> DataFrame:
    """chain, node, place (0 for the start) of every node that the pointers (chain, node, to: one for each node) lead to
    from the chain's start (chain, node). A node without a pointer ends the walk, and so does one that was passed before: each keeps the place
    of its first visit, which is what a walk with a guard against circles gives.

    Each round doubles the pointers' reach and what has been reached. A round is one table in the shared folder; no task holds a chain."""
    jumps = staged(pointers.filter("to IS NOT NULL").select("chain", "node", "to"), "pointers")
    reached = staged(starts.filter("node IS NOT NULL").select("chain", "node", F.lit(0).cast("long").alias("place")), "reached")
    known = reached.count()
    for k in range(most_rounds):
        ahead = reached.join(jumps, ["chain", "node"]).select("chain", F.col("to").alias("node"), (F.col("place") + F.lit(1 << k)).alias("place"))
        after = staged(reached.unionByName(ahead).groupBy("chain", "node").agg(F.min("place").alias("place")), "reached")
        drop_staged(reached)
        reached, before, known = after, known, after.count()
        if known == before:
            break
        further = jumps.select("chain", F.col("node").alias("to"), F.col("to").alias("next"))
        doubled = staged(jumps.join(further, ["chain", "to"]).select("chain", "node", F.col("next").alias("to")), "pointers")
        drop_staged(jumps)
        jumps = doubled
    drop_staged(jumps)
    return reached
