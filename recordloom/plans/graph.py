"""Graph closures as DataFrame rounds, each staged in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import drop_staged, staged


def connected(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root (smallest node of its part): smallest labels spread and jump until nothing changes."""
    both = staged(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = staged(labels.join(near, "u").select("u", F.least("l", "m").alias("l")), "labels")
        jump = step.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        after = staged(step.join(jump, "l").select("u", F.least("l", "ll").alias("l")), "labels")
        settled = after.join(labels.withColumnRenamed("l", "old"), "u").filter("l <> old").isEmpty()
        drop_staged(labels, step)
        if settled:
            drop_staged(both)
            return after.select(F.col("u").alias("node"), F.col("l").alias("root"))
        labels = after
    raise RuntimeError("labels did not settle")


def descendants(rows: DataFrame, parent: str, roots: DataFrame, most_depth: int = 10_000) -> DataFrame:
    """id, depth: the roots and all that hang below them, each at its least depth. Deeper than most_depth is an error."""
    frontier = roots.select("id").distinct().withColumn("depth", F.lit(0))
    found = staged(frontier, "found")
    for depth in range(1, most_depth + 1):
        below = rows.join(frontier.select(F.col("id").alias(parent)), parent).select("id", F.lit(depth).alias("depth"))
        new = staged(below.join(found.select("id"), "id", "left_anti").distinct(), "frontier")
        if new.isEmpty():
            drop_staged(new)
            return found
        # Every eighth round the union is staged, so the plan stays short however deep the rows hang.
        frontier, found = new, found.unionByName(new) if depth % 8 else staged(found.unionByName(new), "found")
    raise RuntimeError(f"rows hang deeper than {most_depth}")
