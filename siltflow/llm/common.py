"""What the corpus operators share: the shared folder, stable hashes of text, table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only where none is configured (tests) take a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="siltflow-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that a lost executor costs a read and not a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: like cut(), in columns and compressed, for results of many rows."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n = f"_{n}"
        out.append(n)
        taken.add(n)
    return out


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def utf8_size(col: str = "text"):
    """Bytes of the UTF-8 form; null counts none."""
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")


#: Partial sums that one task adds.
FAN_IN = 64


def tree_sum(parts: DataFrame, key: str, add: Callable, schema: str) -> DataFrame:
    """One row per key from rows of partial sums, by add(key, pandas) -> one row of the same schema. Levels of at most about
    FAN_IN rows a task, so that what a task holds doesn't grow with the number of tasks before it."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    parts = cut(parts.select(*names))
    n = parts.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        salted = parts.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(n)))
        parts = cut(salted.groupBy(key, "_salt").applyInPandas(add, schema))
    return parts.groupBy(key).applyInPandas(add, schema)


#: Rows of a batch that a worker turns at once.
ROWS = 1024


def small_batches(df: DataFrame) -> None:
    """Let Arrow batches of texts hold ROWS rows: at the usual ten thousand a batch of long texts fills a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name)) > ROWS:
        df.sparkSession.conf.set(name, str(ROWS))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str, carry: tuple[str, ...] = ("doc_id",), col: str = "text") -> DataFrame:
    """Columns of df that `carry` names, as they are, and those that make()(values of col) gives; make runs once a task.
    Batches stay in Arrow, so that null and large ids pass unharmed."""
    kinds = dict(x.strip().split(" ") for x in schema.split(","))
    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    types = dict(df.select(*carry).dtypes)
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                got = f(part.column(col).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *(pa.array(got[c], arrow[k]) for c, k in kinds.items())], [*carry, *kinds])

    return df.select(*carry, col).mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in carry), schema]))


# ---------------------------------------------------------------- vectorised hashing
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 2**64)
_cache: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand (16 bytes a byte of the longest buffer)."""
    have = _cache.get("pow")
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for base in (_MUL, _INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _cache["pow"] = have = tuple(both)
    return have[0][:n], have[1][:n]


def _byte_table() -> np.ndarray:
    if "bytes" not in _cache:
        _cache["bytes"] = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MUL)) | np.uint64(1)
    return _cache["bytes"]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of table[byte] * base**i over s <= i < e, modulo 2**64."""
    n = len(buf)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_table()[buf] * _powers(n)[0], out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], equal for equal bytes wherever they stand."""
    inv = _powers(len(p))[1]
    return mix64((p[end] - p[start]) * inv[start] + (end - start).astype(np.uint64))


def gram_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte windows of buf."""
    n = len(buf)
    if n < k:
        return np.zeros(0, np.uint64)
    p = prefix_hash(buf)
    return mix64((p[k:] - p[:-k]) * _powers(n)[1][: n - k + 1])
