"""The UDF surface: vectorised forms over Arrow, and a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from siltflow.registry import query
from siltflow.tables import load


@query("udf_scalar", "SELECT n_nationkey, lower(n_name) || '!' AS s FROM nation")
def udf_scalar(spark, sf_dir):
    shout = F.udf(lambda s: s.lower() + "!", "string", useArrow=True)
    return load(spark, sf_dir, "nation").select("n_nationkey", shout("n_name").alias("s"))


@query("udf_registered", "SELECT r_regionkey, CAST(length(r_name) * 2 AS INTEGER) AS n FROM region")
def udf_registered(spark, sf_dir):
    spark.udf.register("twice_len", lambda s: 2 * len(s), "int")
    load(spark, sf_dir, "region").createOrReplaceTempView("region")
    return spark.sql("SELECT r_regionkey, twice_len(r_name) AS n FROM region")


@query("udf_pandas", "SELECT o_orderkey, round(o_totalprice * 1.1, 4) AS p FROM orders")
def udf_pandas(spark, sf_dir):
    @F.pandas_udf("double")
    def more(x: pd.Series) -> pd.Series:
        return x * 1.1

    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(more("o_totalprice"), 4).alias("p"))


@query("udf_pandas_iter", "SELECT s_suppkey, round(s_acctbal + 100, 2) AS b FROM supplier")
def udf_pandas_iter(spark, sf_dir):
    @F.pandas_udf("double")
    def shifted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        add = 100
        for x in batches:
            yield x + add

    return load(spark, sf_dir, "supplier").select("s_suppkey", F.round(shifted("s_acctbal"), 2).alias("b"))


@query("udf_grouped_agg", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS m FROM customer GROUP BY 1")
def udf_grouped_agg(spark, sf_dir):
    @F.pandas_udf("double")
    def mean(x: pd.Series) -> float:
        return float(x.mean())

    return load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(mean("c_acctbal"), 4).alias("m"))


@query("udf_window_agg", "SELECT s_suppkey, round(avg(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS m FROM supplier")
def udf_window_agg(spark, sf_dir):
    @F.pandas_udf("double")
    def mean(x: pd.Series) -> float:
        return float(x.mean())

    return load(spark, sf_dir, "supplier").select("s_suppkey", F.round(mean("s_acctbal").over(Window.partitionBy("s_nationkey")), 4).alias("m"))


@query("udf_apply_in_pandas", "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS d FROM customer")
def udf_apply_in_pandas(spark, sf_dir):
    def centred(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c_custkey": pdf["c_custkey"], "d": (pdf["c_acctbal"] - pdf["c_acctbal"].mean()).round(4)})

    return load(spark, sf_dir, "customer").groupBy("c_nationkey").applyInPandas(centred, "c_custkey long, d double")


@query("udf_cogroup", "SELECT n_nationkey AS nation, CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS BIGINT) AS customers, CAST((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS BIGINT) AS suppliers FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def udf_cogroup(spark, sf_dir):
    def sizes(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"nation": [key[0]], "customers": [len(a)], "suppliers": [len(b)]})

    cu = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    su = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return cu.groupBy("nation").cogroup(su.groupBy("nation")).applyInPandas(sizes, "nation int, customers long, suppliers long")


@query("udf_map_in_pandas", "SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def udf_map_in_pandas(spark, sf_dir):
    def big(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[pdf["p_size"] > 25]

    return load(spark, sf_dir, "part").select("p_partkey", "p_size").mapInPandas(big, "p_partkey long, p_size int")


@query("udtf", "SELECT r_regionkey, i AS k FROM region, range(1, 4) t(i)")
def udtf(spark, sf_dir):
    @F.udtf(returnType="k: bigint")
    class UpTo:
        def eval(self, n: int):
            for i in range(1, n + 1):
                yield (i,)

    spark.udtf.register("up_to", UpTo)
    load(spark, sf_dir, "region").createOrReplaceTempView("region")
    return spark.sql("SELECT r_regionkey, t.k FROM region, LATERAL up_to(3) t")
