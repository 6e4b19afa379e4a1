from itertools import product

import numpy as np

from siltflow.llm import transcripts as X


def test_viterbi_is_the_best_of_all_paths():
    r = np.random.default_rng(0)
    fitted = X.fit([[("user", "Zed: hi?"), ("assistant", "Yon: a\nb")]] * X.KNOWN)
    for model in (X.USUAL, fitted):
        tables = list(model.emission.values())
        for _ in range(10):
            seen = np.stack([r.integers(0, x.shape[1], 4) for x in tables], axis=1)
            e = sum(x[:, seen[:, i]] for i, x in enumerate(tables))

            def score(path, e=e, model=model):
                return model.start[path[0]] + sum(model.transition[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(e[s, i] for i, s in enumerate(path))

            best = max(map(score, product(range(X.STATES), repeat=4)))
            assert abs(score(X.viterbi(seen, model).tolist()) - best) < 1e-9


def test_names_and_probabilities_are_counted():
    model = X.fit([[("user", "Zed: hi there"), ("assistant", "Yon: a\nb"), ("user", "Once: no")]] * X.KNOWN + [[("user", "Rare: x")]])
    assert set(model.names) == {"zed", "yon", "once"}
    assert all(np.allclose(np.exp(x).sum(axis=-1), 1) for x in (model.start, model.transition, *model.emission.values()))
    user, assistant = 2 * X.ROLES.index("user"), 2 * X.ROLES.index("assistant")
    assert np.isclose(np.exp(model.start[user]), (X.KNOWN + 1 + X.PRIOR * np.exp(X.START[user])) / (X.KNOWN + 1 + X.PRIOR))
    assert np.isclose(np.exp(model.transition[assistant, assistant + 1]), (X.KNOWN + X.PRIOR * 0.55) / (X.KNOWN + X.PRIOR))
    assert X.parse("Yon: well\nmore\nZed: ok", model) == [("assistant", "well\nmore"), ("user", "ok")]
    assert X.fit([]) is X.USUAL and X.fit([[("tool", "x")]]) is X.USUAL


def test_styles_and_lost_markers():
    t = "System: Be kind.\nUser: What is it?\nSecond line\nAssistant: A thing.\n\nwith a gap\n\nUser: ok"
    assert X.parse(t) == [("system", "Be kind."), ("user", "What is it?\nSecond line"), ("assistant", "A thing.\n\nwith a gap"), ("user", "ok")]
    assert [r for r, _ in X.parse("Human> hi\nAI> hello")] == ["user", "assistant"]
    assert [r for r, _ in X.parse("[q] hi\n[a] hello")] == ["user", "assistant"]
    assert X.render([("user", "hi")]) == "<|user|>\nhi\n<|end|>\n"
    assert X.parse(None) == X.parse("") == X.parse(" \n\n") == []


def test_roles_are_recovered(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Some words about number {c} and {t}." + " More words follow here." * (t % 3)) for c in range(60) for t in range(4)]
    rows += [(None, 0, "user", "alone"), (99, None, None, None), (99, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("transcript", F_lit("x"))
    plain = X.plain_transcripts(df)
    got = X.format_transcripts(plain, "conv_id", keep_text=True, model=X.train(df), truth="true_lines").collect()
    assert len(got) == 62
    assert sum(r["agreement"] == 1 for r in got) >= 58
    usual = X.format_transcripts(plain, "conv_id", truth="true_lines").collect()
    assert sum(r["agreement"] == 1 for r in usual) < 50  # not all names are usual ones
    long = spark.createDataFrame([(1, 0, "user", "a long line " * 60_000), (1, 1, "assistant", "yes\n" * 9000)], df.schema.fieldNames()[:4])
    (r,) = X.format_transcripts(X.plain_transcripts(long), "conv_id", model=X.train(df), truth="true_lines").collect()
    assert r["n_turns"] >= 1 and 0 <= r["agreement"] <= 1  # very long texts; what a line is taken for is the model's business
    none = df.limit(0)
    assert X.format_transcripts(X.plain_transcripts(none), "conv_id", model=X.train(none), truth="true_lines").count() == 0


def F_lit(v):
    from pyspark.sql import functions as F

    return F.lit(v)
