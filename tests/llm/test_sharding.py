import random
import zlib

from siltflow.llm import sharding as S


def test_tree_against_a_sorted_list():
    r, t, have = random.Random(1), S.BalancedTree(), set()
    for _ in range(2000):
        k = (r.randrange(50), r.randrange(4))
        if k in have and r.random() < 0.6:
            t.remove(k)
            have.remove(k)
        elif k not in have:
            t.insert(k)
            have.add(k)
        q = (r.randrange(52), -1)
        assert t.ceiling(q) == min((x for x in have if x >= q), default=None)


def test_best_fit_takes_the_tightest_bin():
    assert S.best_fit_decreasing([6, 5, 4, 3, 2], 2, 10) == [0, 1, 0, 1, 1]
    assert S.best_fit_decreasing([6, 6, 6], 2, 10) is None
    r = random.Random(2)
    sizes = [r.randrange(1, 100) for _ in range(200)]
    got, room = S.best_fit_decreasing(sizes, 40, 300), [300] * 40
    for i in sorted(range(200), key=lambda i: (-sizes[i], i)):
        b = min((room[b], b) for b in range(40) if room[b] >= sizes[i])[1]
        assert got[i] == b
        room[b] -= sizes[i]


def test_shards(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choices("abc d", k=r.randrange(0, 400)))) for i in range(3000)] + [(5000 + i, "copy of one text " * 3) for i in range(200)] + [(1, None), (2, ""), (None, "x"), (3, "é"), (3, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumn("shard", df["doc_id"]).withColumn("n", df["doc_id"])
    got = S.shard(df).collect()
    assert len(got) == len(rows)
    size = {}
    for x in got:
        size.setdefault(x["shard"], []).append(x)
        assert x["law"] == "bytes" and x["grown_shard"] is None and 0 <= x["shard"] < 40
    total = [sum(x["size"] for x in v) for v in size.values()]
    assert len(total) == 40 and max(total) - min(total) <= 0.02 * max(total)
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in size.values())
    assert len({x["shard"] for x in got if x["doc_id"] is not None and x["doc_id"] >= 5000}) == 1
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(x["doc_id"]), x["size"], x["text_crc32"]) for x in got) == want
    assert S.shard(df.limit(0)).count() == 0


def test_a_group_above_a_fair_share_stands_alone():
    got = S.pack([1000, *[10] * 100], 5)
    room = [sum(s for s, b in zip([1000, *[10] * 100], got, strict=True) if b == k) for k in range(5)]
    assert sorted(room)[-1] == 1000 and sorted(room)[:4] == [250] * 4
