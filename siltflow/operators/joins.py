"""Joins that Spark has no operator for, as compositions of the joins that it has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def left_with_default(left: DataFrame, right: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """Left join whose missing columns take named defaults."""
    return left.join(right, on, "left").fillna(defaults)


def range_join(points: DataFrame, ranges: DataFrame, value: str, lo: str, hi: str, width: float) -> DataFrame:
    """Points with the ranges [lo, hi) that hold them. Ranges are listed under the cells of `width` that they cross, so the join
    is an equi-join on cells that Spark can shuffle, instead of a nested loop; width should be near the usual length of a range."""
    cells = ranges.where(F.col(hi) > F.col(lo)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    own = points.withColumn("_cell", F.floor(F.col(value) / width))
    return own.join(cells, "_cell").where((F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi))).drop("_cell")


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, take: list[str]) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time. Both sides are unioned and the last seen right
    row carried forward: one shuffle and one sort by key, no product of the sides."""
    lead = left.withColumn("_side", F.lit(1)).withColumn("_got", F.lit(None).cast(right.select(F.struct(*take).alias("s")).schema["s"].dataType))
    follow = right.select(key, at, F.lit(0).alias("_side"), F.struct(*take).alias("_got"))
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = lead.unionByName(follow, allowMissingColumns=True).withColumn("_got", F.last("_got", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*left.columns, *[F.col("_got")[c].alias(c) for c in take])
