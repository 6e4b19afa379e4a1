import numpy as np

from siltflow.llm import quality as Q


def docs(n):
    r = np.random.default_rng(1)
    words = ["the", "river", "stone", "walked", "under", "green", "lamp", "music", "again", "house", "of", "and"]
    out = []
    for i in range(n):
        w = list(r.choice(words, 60))
        out.append((i, " ".join(w) + ".", 1) if i % 4 else (i, " ".join([w[0]] * 30 + [w[1] + "$$$"] * 30), 0))
    return out


def test_held_out_accuracy_from_positives_only(spark):
    rows = docs(400)
    d = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, source string")
    lab = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in Q.score(d, Q.train(d, lab)).collect()}
    assert len(got) == 400
    held = [i for i in got if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == rows[i][2] for i in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_held_out_is_crc32_mod_3(spark):
    import zlib

    got = spark.range(50).select("id", Q.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)


def test_prior_and_nonnegative_gradient():
    r = np.random.default_rng(0)
    p, u = r.normal(2, 1, (2000, 1)), np.concatenate([r.normal(2, 1, (1200, 1)), r.normal(-2, 1, (800, 1))])
    r.shuffle(u)
    one = lambda x: np.c_[x, np.ones(len(x))]
    assert abs(Q.class_prior(one(p), one(u)) - 0.6) < 0.08
    w = np.array([50.0, 0.0])  # so sure that the unlabelled risk less the positives' part is negative
    prior = 0.99
    zp, zu = one(p) @ w, one(u) @ w
    assert np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() < 0
    g = one(u).T @ Q.sigmoid(zu) / len(u) - one(p).T @ Q.sigmoid(zp) * (prior / len(p))
    assert np.allclose(Q.nn_risk_gradient(w, one(p), one(u), prior, 0.0), -g)


def test_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x " * 20000), (2**60 + 1, "z")], "doc_id long, text string")
    lab = spark.createDataFrame([(3, 1), (None, 1), (1, None)], "doc_id long, quality int")
    rows = Q.score(d.withColumn("score", d["doc_id"]), Q.train(d, lab)).collect()
    assert len(rows) == 6 and {r["doc_id"] for r in rows} == {1, 2, 3, None, 2**60 + 1}
    empty = d.limit(0)
    assert Q.score(empty, Q.train(empty, lab)).count() == 0
    assert Q.keep_good(d, Q.fit(np.zeros((0, Q.N_FEATURES)), np.zeros((0, Q.N_FEATURES)))).count() == 6
