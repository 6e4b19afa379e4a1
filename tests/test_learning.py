"""Which rows models are fitted to and judged by."""

from pyspark.sql import functions as F

import siltflow.plans.catalogue  # noqa: F401
from siltflow import registry
from siltflow.operators import learning
from siltflow.tables import load

SF = "/root/testdata/sf0.001"


def test_model_quality_judges_every_vector_once(spark, monkeypatch):
    judged = []

    class Constant:
        def fit(self, train):
            self.seen = {r[0] for r in train.select("vec_id").collect()}
            return self

        def transform(self, test):
            ids = [r[0] for r in test.select("vec_id").collect()]
            assert self.seen and self.seen.isdisjoint(ids)
            judged.extend(ids)
            return test.withColumn("prediction", F.lit(1.0))

    monkeypatch.setattr(learning, "CLASSIFIERS", dict.fromkeys(learning.CLASSIFIERS, Constant))
    got = registry.QUERIES["ml_model_quality"](spark, SF).collect()
    ids = sorted(r[0] for r in load(spark, SF, "embeddings").select("vec_id").collect())
    assert sorted(judged) == sorted(ids * 3)
    # one answer for all rows is no better than the largest class's share
    assert [r["better_than_chance"] for r in got] == [False] * 3


def test_selector_where_p_values_are_zero(spark, tmp_path):
    spark.range(120_000).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    got = registry.QUERIES["ml_selector"](spark, str(tmp_path))
    assert got.where(F.col("kept") != (F.col("p_partkey") + 1) % 2).isEmpty() and got.count() == 120_000
