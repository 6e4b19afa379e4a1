"""Small fixtures with answers found by hand."""

import math
from collections import Counter, defaultdict, deque
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from siltflow.functions.hashing import text_mod, trailing_zeros
from siltflow.operators import analytics, clustering, graph, itemsets, joins, recommend, similarity, sketches
from siltflow.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()))


def edges(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src long, dst long")


TRIANGLES = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]


def test_retail_keys(spark):
    df = spark.createDataFrame([("11/01/2000", "00038317", "4711000000123"), ("bad", "1", "2"), ("1/2/2000", "x", "2")], "TRANSACTION_DT string, CUSTOMER_ID string, PRODUCT_ID string")
    assert rows(files.retail_pairs(df)) == [("11/01/00-38317", 4711000000123)]


def test_jaccard(spark):
    sets = spark.createDataFrame([(k, t) for k, s in {"A": (1, 2, 3), "B": (2, 3, 4), "C": (1, 2)}.items() for t in s], "item string, token int")
    got = rows(similarity.jaccard_join(sets, 0.5))
    assert [(a, b) for a, b, _ in got] == [("A", "B"), ("A", "C")] and got[0][2] == 0.5 and abs(got[1][2] - 2 / 3) < 1e-12


def test_banding_finds_nearly_all(spark):
    import random

    r = random.Random(1)
    base = [[r.randrange(10**6) for _ in range(60)] for _ in range(20)]
    sets = []
    for i, b in enumerate(base):
        for j in range(4):
            sets += [((i * 4 + j), t) for t in set(b[: 60 - 4 * j])]
    df = spark.createDataFrame(sets, "item long, token long")
    exact = {(a, b) for a, b, _ in rows(similarity.jaccard_join(df, 0.5))}
    found = {(a, b) for a, b, _ in rows(similarity.lsh_join(df, F.col("token")))}
    assert found <= exact and len(found) >= 0.99 * len(exact) and len(exact) >= 120


BASKETS = [{1, 2, 3}, {1, 2}, {1, 3}, {2, 3}, {1, 2, 3}]


def test_itemsets(spark):
    df = itemsets.long_form(spark.createDataFrame([(i, x) for i, b in enumerate(BASKETS) for x in b], "b long, x long"), "b", "x")
    assert rows(itemsets.frequent_items(df, 3)) == [(1, 4), (2, 4), (3, 4)]
    assert [(list(i), n) for i, n in rows(itemsets.frequent_sets(df, 3, 2))] == [([1, 2], 3), ([1, 3], 3), ([2, 3], 3)]
    assert rows(itemsets.frequent_sets(df, 3, 3)) == []
    both = {(tuple(i), n) for i, n in rows(itemsets.two_pass_frequent(df, 3, 2))}
    assert both == {((1,), 4), ((2,), 4), ((3,), 4), ((1, 2), 3), ((1, 3), 3), ((2, 3), 3)}
    rules = rows(itemsets.association_rules(itemsets.frequent_sets(df, 3, 2), itemsets.frequent_items(df, 1), 5, 0.7))
    assert len(rules) == 6 and all(abs(r[3] - 0.75) < 1e-12 and abs(r[4] - 0.9375) < 1e-12 for r in rules)


def test_pearson_and_predictions(spark):
    ratings = spark.createDataFrame([(1, 10, 5.0), (2, 10, 3.0), (3, 10, 1.0), (1, 20, 4.0), (2, 20, 2.0), (3, 20, 3.0), (4, 30, 4.0), (5, 40, 2.5)], "user long, item long, rating double")
    assert rows(recommend.item_similarity(ratings)) == [(10, 20, 0.5)]
    pair = spark.createDataFrame([(30, 40)], "i long, j long")
    assert rows(recommend.item_similarity(ratings, pair)) == [(30, 40, 0.7)]
    asked = spark.createDataFrame([(9, 10), (4, 99), (1, 30)], "user long, item long")
    got = {(u, i): p for u, i, p in rows(recommend.predict(ratings, asked, 1))}
    assert got[9, 10] == 2.5 and got[4, 99] == 4.0  # unknown user; unknown item takes the user's mean
    got = {(u, i): p for u, i, p in rows(recommend.predict(ratings, asked, 2))}
    assert got[9, 10] == 2.5 and got[4, 99] == 2.5
    mixed = recommend.hybrid(spark.createDataFrame([(1, 1, 2.5)], "user long, item long, prediction double"), spark.createDataFrame([(1, 1, 4.0)], "user long, item long, prediction double"))
    assert rows(mixed) == [(1, 1, 3.85)]


def test_errors(spark):
    df = spark.createDataFrame([(3.0, 4.0), (4.0, 4.0), (5.0, 3.0)], "p double, t double")
    assert abs(analytics.rmse(df, "p", "t").first()[0] - 1.290994) < 1e-6
    assert rows(analytics.error_histogram(df, "p", "t")) == [("0-1", 1), ("1-2", 1), ("2-3", 1)]
    z = [r[1] for r in rows(analytics.zscores(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k long, x double"), ["x"], ["k"]))]
    assert [round(v, 6) for v in z] == [-1.224745, 0.0, 1.224745]
    with pytest.raises(ValueError):
        recommend.check_matrix(df.limit(0), ["p"])
    with pytest.raises(Exception, match="null, NaN or infinite"):
        recommend.check_matrix(spark.createDataFrame([(float("nan"),)], "p double"), ["p"]).collect()


def brute_betweenness(pairs):
    adj = defaultdict(set)
    for a, b in pairs:
        adj[a].add(b)
        adj[b].add(a)
    total = defaultdict(float)
    for s, t in combinations(sorted(adj), 2):
        paths, dist, todo = defaultdict(list), {s: 0}, deque([[s]])
        while todo:
            p = todo.popleft()
            paths[p[-1]].append(p)
            for x in adj[p[-1]]:
                if dist.get(x, math.inf) >= len(p):
                    dist[x] = len(p)
                    todo.append([*p, x])
        for p in paths[t]:
            for e in zip(p, p[1:], strict=False):
                total[tuple(sorted(e))] += 1 / len(paths[t])
    return {k: round(v, 5) for k, v in total.items()}


@pytest.mark.parametrize(
    "pairs",
    [[(1, 2), (2, 3), (3, 4)], TRIANGLES, [(1, 2), (1, 3), (2, 3), (2, 4), (4, 5), (4, 6), (4, 7), (5, 6), (6, 7)], [(1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (5, 6), (6, 7), (7, 4), (1, 8)]],
)
def test_betweenness(spark, pairs):
    got = {(a, b): v for a, b, v in rows(graph.betweenness(edges(spark, pairs)))}
    assert got == brute_betweenness(pairs)


def test_betweenness_without_edges(spark):
    assert rows(graph.betweenness(edges(spark, []))) == []


def test_communities(spark):
    e = edges(spark, TRIANGLES)
    labels = graph.label_propagation(e, 5)
    assert {k: v for k, v in rows(labels)} == {1: 1, 2: 1, 3: 1, 4: 3, 5: 3, 6: 3}
    split = spark.createDataFrame([(i, 1 if i < 4 else 2) for i in range(1, 7)], "id long, label long")
    assert abs(graph.modularity(e, split).first()[0] - 0.357142857) < 1e-8
    assert abs(graph.modularity(e, split, half=True).first()[0] - 0.265306122) < 1e-8
    assert {k: v for k, v in rows(graph.girvan_newman(e))} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert [r["line"] for r in graph.community_lines(split).collect()] == ["'1', '2', '3'", "'4', '5', '6'"]


def test_reachability(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (7, 8)])
    assert rows(graph.connected_components(e)) == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)]
    assert rows(graph.shortest_paths(e, 1)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(graph.transitive_closure(edges(spark, [(1, 2), (2, 3), (3, 1)]))) == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]
    assert rows(graph.triangles(edges(spark, TRIANGLES))) == [(i, 1) for i in range(1, 7)]


def test_hashes(spark):
    df = spark.createDataFrame([("ab",), ("",), ("é",)], "x string").select("x", text_mod(F.col("x"), 69991).alias("h"))
    assert {r["x"]: r["h"] for r in df.collect()} == {"ab": 24930, "": 0, "é": int("é".encode().hex(), 16) % 69991}
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (8,), (12,)], "v long").select(trailing_zeros(F.col("v"))).collect()] == [1, 0, 3, 2]
    bits = spark.createDataFrame([("ab",)], "x string").select(sketches.bloom_bits(F.col("x"))).first()[0]
    assert bits == [24930, 49861, 4795]


def test_bloom_has_no_false_negatives_and_counts_as_a_filter_does(spark):
    ids = [str((i * 37) % 150) for i in range(400)]
    stream = spark.createDataFrame([(i, i // 100, x) for i, x in enumerate(ids)], "seq long, batch long, x string")
    small = {"p": 997, "m": 211}
    got = {r["batch"]: (r["negatives"], r["false_positives"]) for r in sketches.bloom_false_positives(stream, **small).collect()}
    bits, seen, want = set(), set(), defaultdict(lambda: [0, 0])
    for i, x in enumerate(ids):
        v = int(x.encode().hex(), 16)
        own = {(a * v + b) % 997 % 211 for a, b in sketches.BLOOM_HASHES}
        if x not in seen:
            want[i // 100][0] += 1
            want[i // 100][1] += own <= bits
        seen.add(x)
        bits |= own
    assert got == {b: tuple(want[b]) for b in range(4)}


def test_reservoir(spark):
    stream = spark.range(1000).select(F.col("id").alias("seq"), F.expr("id div 100").alias("batch"), F.col("id").cast("string").alias("x"))
    assert sketches.bottom_k(stream, 100).count() == 100
    snap = sketches.reservoir_snapshots(stream)
    assert snap.count() == 50 and snap.where("x IS NULL").count() == 0
    assert {r["x"] for r in snap.where("batch = 0").collect()} == {"0", "20", "40", "60", "80"}


def test_distances(spark):
    c = spark.createDataFrame([(0, 4, [4.0, 8.0], [8.0, 20.0])], "cluster int, n long, sum array<double>, sumsq array<double>")
    p = spark.createDataFrame([(1, [4.0, 6.0]), (2, [1.0, 2.0])], "id long, v array<double>")
    d = p.join(c).select("id", clustering.mahalanobis(F.col("v"), F.col("n"), F.col("sum"), F.col("sumsq")).alias("d"))
    assert rows(d) == [(1, 5.0), (2, 0.0)]
    assert [(r["id"], r["cluster"]) for r in clustering.assign(p, c, 2).orderBy("id").collect()] == [(1, None), (2, 0)]
    again = clustering.merge_statistics(c, c).first()
    assert (again["n"], again["sum"], again["sumsq"]) == (8, [8.0, 16.0], [16.0, 40.0])


def test_run_keeps_every_point(spark):
    import random

    r = random.Random(2)
    pts = [(i, [r.gauss(10 * (i % 3), 1), r.gauss(-5 * (i % 3), 1)]) for i in range(300)] + [(900, [500.0, 500.0])]
    out, report = clustering.run(spark.createDataFrame(pts, "id long, v array<double>"), 3, 2, rounds=3)
    assert out.count() == 301 and out.select("id").distinct().count() == 301
    assert report.count() == 3


def test_points(spark):
    df = spark.createDataFrame([("1, 2.5",), ("x,1",), ("3,-4",)], "value string")
    assert rows(clustering.parse_points(df)) == [([1.0, 2.5],), ([3.0, -4.0],)]


def test_as_of_and_range(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "z", 9)], "id long, key string, at long")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("k", 7, "c")], "key string, at long, v string")
    assert rows(joins.as_of_join(left, right, "key", "at", ["v"]).select("id", F.coalesce("v", F.lit("-")))) == [(1, "b"), (2, "-"), (3, "-")]
    pts = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (-3.0,)], "x double")
    rng = spark.createDataFrame([("a", 0.0, 10.0), ("b", -5.0, 50.0), ("none", 3.0, 3.0)], "r string, lo double, hi double")
    assert rows(joins.range_join(pts, rng, "x", "lo", "hi", 4.0).select("x", "r")) == [(-3.0, "b"), (0.0, "a"), (0.0, "b"), (9.99, "a"), (9.99, "b"), (10.0, "b")]


def test_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"user_id": "u", "stars": 4.0}\nnot json\n')
    assert rows(files.json_lines(spark, str(tmp_path / "r.json"), "user_id STRING, stars DOUBLE")) == [("u", 4.0)]
    (tmp_path / "c.csv").write_text("user_id,business_id,stars\na,b,4.5\nc,d,x\n")
    assert rows(files.csv_rows(spark, str(tmp_path / "c.csv"), files.RATINGS)) == [("a", "b", 4.5)]
    files.write_report(spark.createDataFrame([(1, "x")], "n long, s string"), str(tmp_path / "out"))
    assert rows(spark.read.text(str(tmp_path / "out"))) == [('{"n":1,"s":"x"}',)]
    t = files.bucketed(spark.range(20), "siltflow_bucketed", "id", 4)
    assert t.count() == 20 and "Exchange" not in t.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert rows(files.check_in_totals(spark.createDataFrame([("b", {"x": 2, "y": 3})], "business_id string, time map<string,long>"))) == [("b", 5)]
    assert rows(files.edge_lines(spark.createDataFrame([(1, 2, 3.5)], "src long, dst long, value double"))) == [("('1', '2'), 3.5",)]


def test_graph_queries_go_to_the_end(spark, monkeypatch):
    from siltflow.plans import mining

    chain = [(i, i + 1) for i in range(1, 34)]
    monkeypatch.setattr(mining, "_edges", lambda *_: edges(spark, chain))
    assert rows(mining.graph_sssp(spark, "")) == [(i, i - 1) for i in range(1, 35)]
    # four triangles in a row: the middle link goes first, so that the best split needs a second removal
    parts = [(a, a + 1, a + 2) for a in (1, 4, 7, 10)]
    pairs = [e for a, b, c in parts for e in ((a, b), (b, c), (a, c))] + [(3, 4), (6, 7), (9, 10)]
    monkeypatch.setattr(mining, "_edges", lambda *_: edges(spark, pairs))
    assert rows(mining.girvan_newman(spark, "")) == [(x, p[0]) for p in parts for x in p]


def test_predictions_cover_the_held_out_orders(spark, monkeypatch):
    from siltflow.plans import mining

    sf = "/root/testdata/sf0.001"
    held = mining._lines(spark, sf).where("o_orderkey % 10 = 0").select("o_custkey", "l_partkey").distinct()
    want = {tuple(r) for r in held.collect()}
    trees = []

    def boosted(train, test, features, **options):
        trees.append(options["trees"])
        return test.withColumn("prediction", F.lit(1.0))

    monkeypatch.setattr(mining.recommend, "boosted_trees", boosted)
    for f in (mining.gbt_predict, mining.hybrid_predict):
        assert {(r["user"], r["item"]) for r in f(spark, sf).collect()} == want
    assert trees == [100, 100]
    known = {r["user"] for r in mining._ratings(spark, sf).select("user").distinct().collect()}, {r["item"] for r in mining._ratings(spark, sf).select("item").distinct().collect()}
    assert {(r["user"], r["item"]) for r in mining.als_predict(spark, sf).collect()} == {(u, i) for u, i in want if u in known[0] and i in known[1]}


def test_sequences_are_mined_whole(spark, monkeypatch):
    import random

    from siltflow.plans import mining

    r = random.Random(6)
    users = [[r.choice("aab") for _ in range(9)] + r.choices("bcde", k=r.randrange(6)) for _ in range(12)]
    events = spark.createDataFrame([(u, i, 100 * u + i, x) for u, s in enumerate(users) for i, x in enumerate(s)], "user_id long, ts long, event_id long, event_type string")
    monkeypatch.setattr(mining, "load", lambda *_: events)
    got = {tuple(x[0] for x in r["sequence"]): r["freq"] for r in mining.prefixspan(spark, "").collect()}
    found = Counter(p for s in users for p in {p for n in (1, 2, 3) for p in combinations(s, n)})
    assert got == {p: n for p, n in found.items() if n >= math.ceil(0.3 * len(users))}


def test_run_merges_close_side_clusters(spark, monkeypatch):
    import random

    r = random.Random(8)
    ids = spark.range(400).select("id", F.pmod(F.xxhash64("id", F.lit(0)), F.lit(2)).cast("int").alias("chunk")).collect()
    second = [x["id"] for x in ids if x["chunk"] == 1]
    pts = {x["id"]: [r.gauss(20 * (x["id"] % 2), 1), r.gauss(0, 1)] for x in ids}
    pts |= {i: [r.gauss(800, 3), r.gauss(800, 3)] for i in second[:80]}
    split = F.when(F.col("v")[0] > 500, 10 + F.col("id") % 2).otherwise((F.col("v")[0] > 10).cast("long")).cast("int")
    monkeypatch.setattr(clustering, "kmeans", lambda points, k, seed=0: points.withColumn("cluster", split))  # halves the outliers
    out, report = clustering.run(spark.createDataFrame(list(pts.items()), "id long, v array<double>"), 2, 2, rounds=2)
    assert [(x["cs_clusters"], x["cs_points"]) for x in report.orderBy("round").collect()] == [(0, 0), (1, 80)]
    assert {x["id"]: x["cluster"] for x in out.where("cluster LIKE 'c%'").collect()} == dict.fromkeys(second[:80], "c2010")


def test_index_over_many_ranges(spark):
    small = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        df = spark.range(60_000).select(F.xxhash64("id").alias("k"), "id", F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        got = [r["index"] for r in sorted(analytics.with_index(df, "k", "id").collect(), key=lambda r: (r["k"], r["id"]))]
        assert got == list(range(60_000))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_shortest_paths_without_edges(spark):
    assert rows(graph.shortest_paths(edges(spark, [(1, 2)]), 99)) == [(99, 0)]
    assert rows(graph.shortest_paths(edges(spark, []), None)) == [(None, 0)]
