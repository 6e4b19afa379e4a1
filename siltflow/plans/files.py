"""Round trips through the file sources and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from siltflow.registry import query
from siltflow.sources import files
from siltflow.tables import load


def _scratch(spark) -> str:
    """A new path in the shared folder."""
    sc = spark.sparkContext
    return f"{sc.getCheckpointDir() or sc.getConf().get('spark.checkpoint.dir') or tempfile.mkdtemp(prefix='siltflow-io-')}/io-{uuid.uuid4().hex}"


def _round_trip(fmt: str, **options):
    @query(f"io_{fmt}", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
    def run(spark, sf_dir):
        df, path = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), _scratch(spark)
        df.write.format(fmt).options(**options).save(path)
        return spark.read.format(fmt).options(**options).schema(df.schema).load(path)


for _fmt, _options in (("csv", {"header": True}), ("json", {}), ("orc", {}), ("parquet", {}), ("xml", {"rowTag": "row"})):
    _round_trip(_fmt, **_options)


@query("io_text", "SELECT r_name AS value FROM region")
def io_text(spark, sf_dir):
    path = _scratch(spark)
    files.write_lines(load(spark, sf_dir, "region").select("r_name"), path)
    return files.lines(spark, path)


@query("io_partitioned", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def io_partitioned(spark, sf_dir):
    """Read back under a partition filter, which prunes folders."""
    path = _scratch(spark)
    load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).where("o_orderstatus = 'F'")


@query("io_json_lines", "SELECT event_id, event_type FROM events")
def io_json_lines(spark, sf_dir):
    path = _scratch(spark)
    load(spark, sf_dir, "events").select("event_id", "event_type").write.json(path)
    return files.json_lines(spark, path, "event_id LONG, event_type STRING")


@query("io_merge_schema", "SELECT r_regionkey AS k, r_name AS name, CAST(NULL AS INTEGER) AS region FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def io_merge_schema(spark, sf_dir):
    path = _scratch(spark)
    load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).write.parquet(f"{path}/part=1")
    load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).write.parquet(f"{path}/part=2")
    return spark.read.option("mergeSchema", True).parquet(path).select("k", "name", "region")


@query("retail_etl", "SELECT strftime(o_orderdate, '%m/%d/') || substr(CAST(year(o_orderdate) AS VARCHAR), 3) || '-' || o_custkey AS basket, l_partkey AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def retail_etl(spark, sf_dir):
    """The orders as retail export lines, with zero-padded numbers, through the export's own reader."""
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = j.select(
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("TRANSACTION_DT"), F.format_string("%08d", "o_custkey").alias("CUSTOMER_ID"), F.lit("A").alias("AGE_GROUP"), F.lit("115").alias("PIN_CODE"),
        F.lit("1").alias("PRODUCT_SUBCLASS"), F.format_string("%013d", "l_partkey").alias("PRODUCT_ID"), F.lit("1").alias("AMOUNT"), F.lit("1").alias("ASSET"), F.lit("1").alias("SALES_PRICE"),
    )
    path = _scratch(spark)
    rows.write.options(header=True, quoteAll=True).csv(path)
    return files.retail_baskets(spark, path)
