"""Every registered query with SQL against DuckDB at the smallest scale; the others run and give rows."""

import glob
import os

import duckdb
import pytest

import siltflow.plans.catalogue  # noqa: F401
from siltflow import registry
from tests.oracle import same

SF = "/root/testdata/sf0.001"
SLOW = {"girvan_newman", "betweenness", "ml_tuning"}  # covered by unit tests


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLE])
def test_same_as_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck.execute(registry.ORACLE[name]))


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE and n not in SLOW and not n.startswith("ml_")])
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["ml_classify_decision_tree", "ml_regress_linear", "ml_cluster_kmeans", "ml_vector_pca", "ml_text_tf_idf", "ml_topics", "ml_chi_squared"])
def test_models(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_regressors_predict_every_line(spark):
    assert registry.QUERIES["ml_regress_linear"](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
