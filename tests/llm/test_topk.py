import numpy as np
import pytest

from siltflow.llm import topk


def brute(rows, k, every):
    ok = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i % every == 0:
            s = sorted((-int(v @ w), j) for j, w in ok if j != i)
            out += [(i, r + 1, j, -n) for r, (n, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 3])
def test_same_as_brute_force(spark, block):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=6).astype(np.float32)]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(500, None), (550, [None] + [1.0] * 5), (600, [float("nan")] * 6), (650, [float("inf")] * 6), (None, rows[0][1]), (700, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    df = df.withColumn("score", df["vec_id"]).withColumn("v", df["vec_id"])
    got = sorted(map(tuple, topk.top_k(df, 5, 10, query_block=block).collect()))
    assert got == brute(rows, 5, 10)


def test_sums_in_levels(spark, monkeypatch):
    from siltflow.llm import common

    monkeypatch.setattr(common, "FAN_IN", 2)
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    assert sorted(map(tuple, topk.top_k(df, 3, 20).collect())) == brute(rows, 3, 20)


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [0.0, -1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [0.0, -1.0])], 5, 50)
    assert topk.top_k(df.limit(0)).count() == 0
