"""Structured Streaming operators; each is a plan on a streaming or a static frame alike."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A file stream of a table, with its NTZ times as instants in UTC, which watermarks need."""
    static = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    schema = static.schema
    folder = spark.readStream.schema(schema)
    # a table may be one file or a folder of them
    path = f"{sf_dir}/{name}.parquet"
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jvm).isDirectory()
    df = folder.parquet(path) if is_folder else folder.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream yields from what is there now, as a static frame: the stream writes micro-batches into a table of the
    shared folder, or in complete mode its last full result, and stops at the end of its input."""
    spark = df.sparkSession
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="siltflow-stream-")
    out = f"{base}/stream-{uuid.uuid4().hex}"
    keep = "overwrite" if mode == "complete" else "append"
    schema = df.schema

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode(keep).parquet(f"{out}/rows")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")


def windowed_counts(df: DataFrame, at: str, keys: list[str], size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums per tumbling or sliding window and keys; with `late`, rows older than the watermark are dropped."""
    if late:
        df = df.withWatermark(at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(df: DataFrame, at: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    if late:
        df = df.withWatermark(at, late)
    return df.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))


def distinct_stream(df: DataFrame, cols: list[str], at: str, late: str) -> DataFrame:
    """First rows per key; the state forgets keys behind the watermark."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(cols)


def matched(left: DataFrame, right: DataFrame, key: str, within: str, late: str = "2 hours") -> DataFrame:
    """Pairs of rows (a, b) of a key with b at or after a and within a span: bounded state on both sides."""
    a = left.withWatermark("ts", late).alias("a")
    b = right.withWatermark("ts", late).alias("b")
    return a.join(b, F.expr(f"a.{key} = b.{key} AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL {within}"))


def running(df: DataFrame, key: str, update: Callable, schema: str, state: str) -> DataFrame:
    """Arbitrary state per key: update(key, batches of pandas, state) yields rows after each micro-batch."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return df.groupBy(key).applyInPandasWithState(update, schema, state, "update", GroupStateTimeout.NoTimeout)
