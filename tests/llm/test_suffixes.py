import collections
import hashlib
import random
import tracemalloc

import numpy as np

from siltflow.llm import suffixes as S


def brute(texts, length):
    seen = collections.Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    out = []
    for x in texts:
        cov = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                cov[i : i + length] = True
        edge = np.diff(np.r_[0, cov.astype(int), 0])
        out.append((len(x), int(cov.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~cov])).hexdigest()))
    return out


def corpus():
    r = random.Random(5)
    base = "".join(r.choices("abcde \n", k=3000))
    tx = []
    for _ in range(40):
        a = r.randrange(0, 2500)
        tx.append("".join(r.choices("xyzw ", k=r.randrange(0, 400))) + base[a : a + r.randrange(380, 900)] + "".join(r.choices("xyzw é", k=r.randrange(0, 200))))
    return [*tx, "a" * 1200, "ab" * 500, "be " * 250, "the " * 150 + "thing " * 90, "=" * 399, "=" * 400, "", None, base, base, "é" * 500]


def test_same_as_brute_force(spark):
    tx = corpus()
    rows = [*enumerate(tx), (3, tx[3]), (None, tx[4]), (7, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).repartition(5)
    df = df.withColumn("spans", df["doc_id"]).withColumn("d", df["doc_id"])
    got = sorted(map(tuple, S.dedup(df).collect()), key=str)
    want = sorted([(i, *x) for (i, _), x in zip(rows, brute([(t or "").encode() for _, t in rows], 400), strict=True)], key=str)
    assert got == want


def test_shorter_strings_and_small_blocks(spark, monkeypatch):
    tx = [t for t in corpus() if t][:30]
    df = spark.createDataFrame(list(enumerate(tx)), "doc_id long, text string")
    got = sorted(map(tuple, S.dedup(df, 100).collect()))
    assert got == [(i, *x) for i, x in enumerate(brute([t.encode() for t in tx], 100))]


def test_queue_spills_and_keeps_order():
    q = S.DiskQueue(held=5000)
    r = random.Random(1)
    items = [(r.randrange(100), bytes(r.randbytes(20)), i) for i in range(500)]
    for x in items:
        q.push(x, 50)
    assert len(q.runs) > 2
    assert list(q.drain()) == sorted(items)


def test_anchors_depend_on_content_alone():
    r = random.Random(2)
    core = bytes(r.choices(b"abc d", k=600))
    places = []
    for n in (0, 17, 333):
        raw = np.frombuffer(bytes(r.choices(b"xyz", k=n)) + core, np.uint8)
        h, a, b, q = S.anchors(raw)
        assert a[0] == 0 and (a[1:] == b[:-1]).all() and b[-1] == len(raw) - 399
        owner = np.repeat(np.arange(len(a)), b - a)
        places.append([(int(h[owner[i]]), int(q[owner[i]] - i)) for i in range(n, len(raw) - 399)])
    assert places[0] == places[1] == places[2]


def test_stripped_documents(spark):
    base = "".join(random.Random(3).choices("abcdé fgh", k=700))
    df = spark.createDataFrame([(1, "one " + base, "s"), (2, base + " two", "s"), (3, "other", "s"), (4, None, "s"), (5, base, "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in S.strip_repeats(df).collect()}
    assert got == {1: "one ", 2: " two", 3: "other", 4: None}
    assert S.dedup(df.limit(0)).count() == 0


def fragments(n, length, seed=4):
    """n fragments around one anchor, in order: copies that differ here and there, as repeated() takes them."""
    r = random.Random(seed)
    left, right = (bytes(r.choices(b"abcd", k=length)) for _ in range(2))
    out = []
    for i in range(n):
        x, y = (bytearray(v) for v in (left, right))
        for v in (x, y):
            if r.random() < 0.7:
                v[r.randrange(length)] = r.choice(b"abcdxyz")
        tmax = r.randrange(length)
        tmin = r.randrange(tmax + 1)
        out.append((7, bytes(y[: length - tmin]), i, -i, 1000 + i, tmin, tmax, bytes(x[:tmax])))
    return sorted(out)


def test_a_large_group_gives_what_memory_gives():
    for length, n in ((40, 900), (60, 350)):
        items = fragments(n, length)
        want = sorted(S.repeated(iter(items), length, n + 1))
        assert len(want) > n // 3
        for together in (1, 7, 64, n):
            assert sorted(S.repeated(iter(items), length, together)) == want
    both = [*items, *((8, *x[1:]) for x in items[:50]), *((9, *x[1:]) for x in items)]
    assert sorted(S.repeated(iter(both), 60, 100)) == sorted(S.repeated(iter(both), 60, 10**6))


def test_memory_of_a_large_group_is_bounded():
    def peak(n):
        tracemalloc.start()
        items = ((7, i.to_bytes(4, "big") + bytes(396), i, i, 1000, 0, 300, bytes([i % 251]) * 300) for i in range(n))
        for _ in S.repeated(items, 400, 500):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(8000) < 1.3 * peak(2000)


def test_copies_of_a_fragment_are_searched_once(spark):
    r = random.Random(9)
    core = "".join(r.choices("abcdef gh", k=1500))
    tx = [core] * 60 + [core[:700] + "".join(r.choices("xyz", k=50)) + core[700:], "zz" + core[200:900], "".join(r.choices("pq rs", k=900))]
    df = spark.createDataFrame(list(enumerate(tx)), "doc_id long, text string").repartition(6)
    got = sorted(map(tuple, S.dedup(df).collect()))
    assert got == [(i, *x) for i, x in enumerate(brute([t.encode() for t in tx], 400))]


def test_digests_are_of_the_whole_fragment():
    a, b = np.array([0, 3]), np.array([3, 5])
    raw = b"abcabcabc"
    assert S._digests(raw, a, b, 4) == [hashlib.blake2b(x, digest_size=16).digest() for x in (raw[0:6], raw[3:8])]
