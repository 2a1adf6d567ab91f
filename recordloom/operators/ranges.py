"""Join of points with the intervals that hold them, without an equality in the condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str, how: str = "inner") -> DataFrame:
    """points x intervals where the whole number `value` lies in low..high, both ends included; columns of both, whose
    names must differ. how: inner, or left_semi for the points in any interval.

    Each interval goes to the level of bins that are just wider than it, so it lies in two of them at most, and each
    point looks into its bin on every level that has intervals: an equi join on level and bin, checked exactly. Copies are
    bounded by two an interval and by the number of levels (at most 64, usually few) a point; nothing is joined by a
    nested loop, and a crowded bin is split as any hot key is. Null values, and intervals with a null end or the low end above the high one, meet nothing."""
    clash = set(points.columns) & set(intervals.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    width = f"(CAST({high} AS DECIMAL(20, 0)) - {low})"
    sound = intervals.filter(f"{low} <= {high}")
    # The number of bits of the width: 2^level is more than it. A width of 2^63 or more is one bin.
    level = F.expr(f"CASE WHEN {width} >= 9223372036854775807 THEN 63 WHEN {width} = 0 THEN 0 ELSE length(bin(CAST({width} AS BIGINT))) END")
    placed = sound.withColumn("_level", level)
    ends = F.when(F.col("_level") >= 63, F.array(F.lit(-1).cast("long"), F.lit(0).cast("long"))).otherwise(F.array_distinct(F.array(F.expr(f"shiftright(CAST({low} AS BIGINT), _level)"), F.expr(f"shiftright(CAST({high} AS BIGINT), _level)"))))
    binned = placed.withColumn("_bin", F.explode(ends))
    levels = [r["_level"] for r in placed.select("_level").distinct().collect()]  # at most 64 numbers
    if not levels:
        return points.join(intervals.limit(0), F.lit(False), how)
    looks = F.array(*(F.struct(F.lit(x).cast("int").alias("l"), (F.expr(f"shiftright(CAST({value} AS BIGINT), {x})") if x < 63 else F.expr(f"CASE WHEN {value} < 0 THEN -1L ELSE 0L END")).alias("b")) for x in levels))
    asked = points.filter(F.col(value).isNotNull()).withColumn("_look", F.explode(looks))
    met = (F.col("_look.l") == F.col("_level")) & (F.col("_look.b") == F.col("_bin")) & F.col(value).between(F.col(low), F.col(high))
    if how == "inner":
        return asked.join(binned, met).drop("_look", "_level", "_bin")
    if how != "left_semi":
        raise ValueError("inner or left_semi")
    # A point may find intervals on several levels: its rows are told apart by a number, and one of each is kept.
    numbered = points.filter(F.col(value).isNotNull()).select(value).distinct().withColumn("_look", F.explode(looks))
    inside = numbered.join(binned, met, "left_semi").select(F.col(value).alias("_v")).distinct()
    return points.join(inside, F.col(value) == F.col("_v"), "left_semi")
