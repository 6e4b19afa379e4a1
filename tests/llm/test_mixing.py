import random
import re

import pytest

from siltflow.llm import mixing as M


def poured(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, live = share * sum(sizes.values()), {}, set(names)
    while live:
        level = left / sum(w[s] for s in live)
        full = {s for s in live if level * w[s] > most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in live}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        live -= full
    return out


def corpus():
    r = random.Random(1)
    rows = []
    for i in range(4000):
        s = "a" if i % 3 == 0 else r.choice(["b", "c", "d", "É", None])
        rows.append((i, " ".join(r.choices(["x", "yy", "zé\tq"], k=r.randrange(0, 60))), s))
    return [*rows, (1, None, "b"), (2, "", "e"), (None, "w w", "c"), (5, "same text here", "d"), (5, "same text here", "d")]


def test_targets_and_taken(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.withColumn("target", df["doc_id"]).withColumn("h", df["doc_id"])
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), count(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = poured(sizes)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-6)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 8 * M.BLOCK
    assert sorted(map(str, M.mix(df.repartition(7)).collect())) == sorted(map(str, got))


def test_schedule_interleaves(spark):
    goal = spark.createDataFrame([(1, 600.0), (2, 300.0), (3, 100.0)], "sid int, target double")
    rows = sorted(M.schedule(goal, 1000, 1).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(1000))
    for sid, share in ((1, 0.6), (2, 0.3), (3, 0.1)):
        own = [r for r in rows if r["sid"] == sid]
        assert [r["rank"] for r in own] == list(range(len(own)))
        for n in range(50, 1001, 50):  # low discrepancy: any run of slots is near its share
            assert abs(sum(r["slot"] < n for r in own) - share * n) < 6


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert M.mix(spark.createDataFrame([], schema)).count() == 0
    rows = M.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect()
    assert [(r["taken"], r["size"]) for r in rows] == [(0, 0), (0, 0)]
    df = spark.createDataFrame([(i, "a b c " * 200, "s") for i in range(20)] + [(3, "a b c " * 200, "s")], schema)
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns and 28 <= mixed.count() <= 35
