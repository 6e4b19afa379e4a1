import random

import pytest

from siltflow.llm import jaccard, mixing, quality, suffixes


def test_pipeline(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [name for name, _ in C.STAGES] == ["quality", "near duplicates", "repeated passages", "mixing", "tokens"]
    for i, (_, stage) in enumerate(C.STAGES[:3]):
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= ids and len(kept) >= 0.6 * n, i
    assert C.run(spark, sf).count() > 0


def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like those that operators make."""
    r = random.Random(6)
    words = ["".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(r.choices(words, k=n))
    passage = text(55)  # over fifty words that stand in two documents
    same = text(90)
    rows = [(1, f"{text(200)} {passage} {text(220)}", "a"), (2, f"{text(180)} {passage} {text(150)}", "b"), (3, same, "a"), (4, same, None), (4, same, None), (5, None, "a"), (6, "", "b"), (7, " \n", "b"), (None, text(60), "c"), (8, text(40_000), "c"), (9, "one two", None)]
    df = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ["d", "k", "at", "left", "_d", "_k", "_spans", "_rest", "_kept", "_s", "_i", "_n", "_copy", "t_d", "s", "i", "n", "copy", "td", "ti", "component_id", "spans", "h"]
    return df.select("*", *(df["n_chars"].alias(x) for x in names)), passage


STEPS = {
    "quality": lambda d: quality.keep_good(d, quality.train(d, d.sparkSession.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))),
    "near": lambda d: jaccard.keep_one(d),
    "passages": lambda d: suffixes.strip_repeats(d),
    "mix": lambda d: mixing.mixed_documents(d),
}


@pytest.mark.parametrize("step", STEPS)
def test_odd_rows_and_names(spark, step):
    docs, passage = odd_documents(spark)
    out = STEPS[step](docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    before = {(x["doc_id"], x["source"]): x.asDict() for x in docs.collect()}
    got = [x.asDict() for x in out.collect()]
    for x in got:
        was = before[x["doc_id"], x["source"]]
        assert {c: v for c, v in x.items() if c not in ("text", "n_chars")} == {c: v for c, v in was.items() if c not in ("text", "n_chars")}
        assert step == "passages" or x["text"] == was["text"]
    ids = sorted(str(x["doc_id"]) for x in got)
    if step == "near":
        assert ids == ["1", "2", "3", "5", "6", "7", "8", "9", "None"]
    if step == "passages":
        texts = {x["doc_id"]: x["text"] for x in got}
        assert ids == ["1", "2", "5", "6", "7", "8", "9", "None"]  # 3 and 4 are copies, of which nothing is left
        assert all(passage not in texts[d] and len(texts[d]) <= before[d, s]["n_chars"] - len(passage) for d, s in ((1, "a"), (2, "b")))
        assert texts[8] == before[8, "c"]["text"]
    if step == "mix":
        assert not {"5", "6", "7"} & set(ids)
    assert STEPS[step](docs.limit(0)).count() == 0
