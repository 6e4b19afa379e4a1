"""Counting and ranking operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltflow.operators.lineage import cut


def top_counts(df: DataFrame, key: str, n: int, name: str = "n") -> DataFrame:
    """The n most frequent keys, ties to the smaller key; each task keeps only its n best for the merge."""
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key).limit(n)


def word_counts(df: DataFrame, col: str, sep: str = " ") -> DataFrame:
    """Counts of the pieces between separators, empty ones included; counted per task before the shuffle."""
    return df.select(F.explode(F.split(col, F.lit(f"\\Q{sep}\\E"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def error_histogram(df: DataFrame, predicted: str, actual: str, edges: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Rows per range of the absolute error: 0-1, 1-2, ... and the open last range."""
    error = F.abs(F.col(predicted) - F.col(actual))
    label, low = F.when(error < edges[0], f"0-{edges[0]}"), edges[0]
    for e in edges[1:]:
        label, low = label.when(error < e, f"{low}-{e}"), e
    return df.select(label.otherwise(f"{low}-inf").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def rmse(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(predicted) - F.col(actual), 2))).alias("rmse"))


def zscores(df: DataFrame, cols: list[str], keys: list[str], eps: float = 1e-8) -> DataFrame:
    """(x - mean) / (population deviation + eps) per column; the statistics are one row, whatever the input."""
    stats = df.agg(*[s for c in cols for s in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    return df.join(F.broadcast(stats)).select(*keys, *[((F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + eps)).alias(c) for c in cols])


def chunks(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """A chunk number 0..n-1 for each row by a seeded hash of its keys: a repeatable shuffle without a global sort."""
    return df.withColumn("chunk", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(n)).cast("int"))


def with_index(df: DataFrame, *order: str) -> DataFrame:
    """Row numbers from 0 in a total order, numbered within ranges and offset by the ranges' sizes, so that no task sees all rows.
    The ranges are written once: planned twice, for the rows and for the sizes, they would have other limits."""
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    ranged = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.join(F.broadcast(before), "_part").withColumn("index", F.col("_base") + F.col("_in")).drop("_part", "_in", "_base")
