"""Steps whose tasks stay small, whatever the input."""

from itertools import combinations

from pyspark.sql import functions as F

from siltflow.operators import graph, spread


def shared(sets):
    return sorted(p for s in sets for p in combinations(sorted(s), 2))


def test_pairs_of_a_key(spark):
    sets = [range(120), range(0, 60, 7), [3], range(50, 90, 3)]
    df = spark.createDataFrame([(k, m) for k, s in enumerate(sets) for m in s], "key long, m long")
    for per_task in (10**6, 700, 40):
        got, n = spread.pairs_within(df, "key", "m", per_task=per_task)
        assert sorted(map(tuple, got.collect())) == shared(sets)
        assert n == spread.parts(sum(len(s) ** 2 for s in sets) / 2, per_task)
    assert spread.pairs_within(df.limit(0), "key", "m")[0].collect() == []


def test_a_task_makes_as_many_pairs_in_a_larger_table(spark):
    def largest(copies):
        df = spark.range(copies * 200).select((F.col("id") % (copies * 10)).alias("key"), F.col("id").alias("m"))
        got, n = spread.pairs_within(df, "key", "m", per_task=500)
        most = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        return most, n

    (one, n1), (many, n8) = largest(1), largest(8)
    assert n8 == 8 * n1 and many < 4 * one


def test_common_items(spark):
    got = graph.co_interaction(spark.createDataFrame([(u, i) for u in (1, 2, 3) for i in range(u, 6)] + [(1, 3), (None, 3), (4, None)], "u long, i long"), "u", "i", 3)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 4), (1, 3, 3), (2, 3, 3)]


def test_pearson_over_cut_lists(spark, monkeypatch):
    """Users with more pairs than a task makes; asked pairs in both orders, of an item with itself, and without a common user."""
    from siltflow.operators import recommend

    ratings = spark.createDataFrame([(u, i, float((u * 7 + i * i * 3) % 50) / 10) for u in range(6) for i in range(40) if (u + i) % 4], "user long, item long, rating double")
    pairs = spark.createDataFrame([(3, 5), (5, 3), (7, 7), (1, 39), (0, 4)], "i long, j long")
    whole, some = [sorted(map(tuple, recommend.item_similarity(ratings, p).collect())) for p in (None, pairs)]
    monkeypatch.setattr(recommend, "PER_TASK", 40)
    assert whole == sorted(map(tuple, recommend.item_similarity(ratings).collect()))
    assert some == sorted(map(tuple, recommend.item_similarity(ratings, pairs).collect()))
    assert [r[:2] for r in some] == [(0, 4), (1, 39), (3, 5), (7, 7)] and some[3][2] == 1.0
    assert {r[:2]: r[2] for r in whole}[3, 5] == some[2][2]


def test_two_passes_count_equal_baskets_once(spark, monkeypatch):
    from siltflow.operators import itemsets

    seen = []
    monkeypatch.setattr(itemsets, "parts", lambda rows, n: seen.append(rows) or 3)
    baskets = [(1, 2, 3)] * 50 + [(2, 3)] * 20 + [(4, 5, 6, 7)] * 3 + [(i,) for i in range(8, 30)]
    rows = spark.createDataFrame([(b, i) for b, s in enumerate(baskets) for i in s], "basket long, item long")
    want = sorted((c, n) for k in (1, 2, 3, 4) for c in combinations(range(30), k) if (n := sum(set(c) <= set(b) for b in baskets)) >= 3)
    for per in (2, 50):
        assert sorted((tuple(r["items"]), r["n"]) for r in itemsets.two_pass_frequent(rows, 3, per).collect()) == want
    assert itemsets.count_within([(1, 2, 3), (1, 3)], [2, 5], {(1,), (1, 3), (3,)}) == {(1,): 7, (1, 3): 7, (3,): 7}
    assert itemsets.two_pass_frequent(rows.limit(0), 1).collect() == []
    assert sorted((tuple(r["items"]), r["n"]) for r in itemsets.frequent_sets(rows, 3, 3).collect()) == [x for x in want if len(x[0]) == 3]
    assert seen == [150 + 40 + 12 + 22, 150 + 20 + 18, 50 + 12]  # sets of each size: what a level's partitions follow


def test_first_orders_without_a_sort(spark):
    import siltflow.plans.catalogue  # noqa: F401
    from siltflow import registry

    df = registry.QUERIES["drop_duplicates"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_equal_sets_are_compared_once(spark, monkeypatch):
    from siltflow.operators import similarity

    sets = {i: range(i // 10 * 3, i // 10 * 3 + 12) for i in range(40)} | {50: [900], 51: [900]}
    df = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "item long, token long")
    compared = []
    verify = similarity.verify
    monkeypatch.setattr(similarity, "verify", lambda p, *a: compared.append(p.count()) or verify(p, *a))
    sim = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in sets.items() for b, y in sets.items() if a < b}
    want = sorted((*p, v) for p, v in sim.items() if v >= 0.5)
    assert sorted(map(tuple, similarity.jaccard_join(df, 0.5).collect())) == want and len(want) == 481
    assert set(map(tuple, similarity.lsh_join(df, F.col("token")).collect())) <= set(want)
    assert max(compared) <= 6
    sig = similarity.minhash(df, F.col("token"))
    found = {(r["a"], r["b"]) for r in similarity.candidates(sig).collect()}
    signs = {r["item"]: r["sig"] for r in sig.collect()}
    assert found == {(a, b) for a in signs for b in signs if a < b and any(signs[a][k : k + 2] == signs[b][k : k + 2] for k in range(0, 60, 2))}
