import random
import re

import numpy as np

from siltflow.llm import jaccard as J
from siltflow.llm.components import components


def grams(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, pct):
    nodes = [(d, grams(t, k)) for d, t in rows]
    root = {d: d for d, _ in nodes if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(nodes):
        for b, y in nodes[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= pct * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((str(d), len(g), None if d is None else find(d)) for d, g in nodes)


def corpus(n=160):
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if i % 3 and out:
            t = r.choice(out)[1].split()
            for _ in range(r.randrange(0, 5)):
                t[r.randrange(len(t))] = r.choice(words)
            t = " ".join(t[: len(t) - r.randrange(0, 3)])
        else:
            t = " ".join(r.choices(words, k=r.randrange(3, 150)))
        out.append((i, t if i % 7 else t.upper()))
    seed = r.choices(words, k=60)
    for i in range(60):  # a large group of near copies, each with an edit of its own
        t = list(seed)
        t[i] = f"edit{i}"
        out.append((1000 + i, " ".join(t)))
    common = r.choices(words, k=40)
    out += [(2000 + i, " ".join(common + r.choices(words, k=30))) for i in range(40)]  # a passage that many share
    return [*out, (300, None), (301, ""), (302, " \t\n"), (303, "one two"), (304, "ONE\ttwo "), (305, "é É"), (306, "é é"), (None, "w1 w2 w3 w4 w5"), (5, out[5][1]), (2**60 + 1, out[5][1])]


def test_same_as_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.withColumn("n", df["doc_id"]).withColumn("root", df["doc_id"])
    for k, pct in ((4, 85), (5, 80)):
        got = sorted((str(r[0]), r[1], r[2]) for r in J.classes(df, k, pct).collect())
        assert got == brute(rows, k, pct)
    assert J.classes(df.limit(0)).count() == 0


def test_small_lists_and_hubs_give_the_same(spark, monkeypatch):
    rows = corpus(60)
    monkeypatch.setattr(J, "HUB", 3)
    monkeypatch.setattr(J, "TOGETHER", 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((str(r[0]), r[1], r[2]) for r in J.classes(df, 4, 85).collect()) == brute(rows, 4, 85)


def test_without_first_tries_nothing_is_lost(spark, monkeypatch):
    rows = corpus(60)
    monkeypatch.setattr(J, "PIVOTS", 0)
    monkeypatch.setattr(J, "SMALL", 2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((str(r[0]), r[1], r[2]) for r in J.classes(df, 4, 85).collect()) == brute(rows, 4, 85)


def test_links_to_be_joined_grow_with_a_group(spark, monkeypatch):
    """A group of n near copies, each with an edit of its own, gives components() a few links a copy and not all its pairs."""
    r = random.Random(8)
    base = [f"w{i}" for i in r.choices(range(5000), k=120)]
    rows = []
    for i in range(300):
        t = list(base)
        t[r.randrange(len(t))] = f"own{i}"
        rows.append((i, " ".join(t)))
    asked = []
    monkeypatch.setattr(J, "components", lambda links: asked.append(links.count()) or components(links))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x["component_id"] for x in J.classes(df, 4, 85).collect()} == {0}
    assert sum(asked) <= 3 * len(rows)


def test_texts_that_share_a_doc_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, "else where now then")], "doc_id long, text string")
    assert {(r[0], r[2]) for r in J.classes(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_trie_probe_is_exact():
    r = np.random.default_rng(5)
    for _ in range(30):
        hub = np.unique(r.integers(0, 400, 120).astype(np.uint64))
        sets = []
        for _ in range(25):
            s = hub[r.random(len(hub)) < r.uniform(0.8, 1)]
            sets.append(np.unique(np.r_[s, r.integers(0, 400, r.integers(0, 12)).astype(np.uint64)]))
        want = [100 * len(np.intersect1d(hub, s)) >= 85 * len(np.union1d(hub, s)) for s in sets]
        assert J.trie_probe(hub, sets, 85, step=8) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (60, 50)]
    df = spark.createDataFrame(links, "a long, b long")
    for few in (0, 1000):
        got = {r["node"]: r["root"] for r in components(df, few).collect()}
        assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 150), 100), 50: 50, 60: 50}


def test_one_of_each_group_stays(spark):
    t = " ".join(f"x{i}" for i in range(40))
    df = spark.createDataFrame([(3, t, "a"), (9, t + " y", "b"), (4, "other words in here now", "c"), (5, None, "d"), (None, t, "e")], "doc_id long, text string, lang string")
    assert sorted(str(r["doc_id"]) for r in J.keep_one(df).collect()) == ["3", "4", "5", "None"]
