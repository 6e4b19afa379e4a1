import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from siltflow.llm import tokens as K

TEXTS = ["", "  a  b\n\n c", "a\x85b \x1cq r ", " a b c ", "hello's we'll  x", "\n\n", "a " * 3000, "x" * 4000, "  " * 900 + "a b", "ΑΣ ΑΣ. İstanbul ǅ \x1c\x1f x\x1dy", "<|endoftext|> a <|startoftext|>b<|endo", "日本語テキスト " * 200, "é Å 1234 ²½ Ⅷ", "'s 't it's'", "😀😀 👨‍👩‍👧 a", "don 't\t\r\n x"]


@pytest.fixture(scope="module")
def bpe():
    return K.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_chunks_give_the_whole_texts_ids(bpe, plain):
    for t in TEXTS:
        want = plain.encode_ordinary(t)
        for size in ((K.CHUNK, K.OVERLAP), (64, 16), (200, 40), (33, 5)):
            got = K.encode_chunked(bpe, t, *size)
            assert got == want, (t[:20], size)
            assert bpe.decode(got) == t.encode()


def test_white_space_at_the_seams(bpe, plain):
    """At the default sizes, every kind of white space at every place of a seam."""
    for unit in (" \xa0b", " \x85b", "\n\nb", " \u3000 b", "x\x1cy ", "Prix : 12 \xa0b ", "\t \r\nab"):
        for before in range(len(unit) + 1):
            t = "x" * before + unit * (2 * (K.CHUNK + K.OVERLAP) // len(unit))
            assert K.encode_chunked(bpe, t) == plain.encode_ordinary(t), (unit, before)


def test_random_texts(bpe, plain):
    r = random.Random(11)
    signs = ["'", "s", "'ll", " ", "  ", "\n", "\xa0", "7", "é", "日", "\u0558", "\U00031350", ",", "a", "ab", "\x1c", "\x85", "😀", "\u0301"]
    for _ in range(150):
        t = "".join(r.choices(signs, k=r.randrange(1, 400)))
        for size in ((40, 12), (17, 9)):
            assert K.encode_chunked(bpe, t, *size, threads=2) == plain.encode_ordinary(t), (t, size)


def test_seams_are_true_boundaries(bpe):
    t = "The quick brown fox's tail  jumps.\nOver 1234 dogs " * 40
    cuts = K.seams(bpe, t, 100, 30)
    assert len(cuts) > 10 and set(cuts) <= set(bpe.pieces(t)) and cuts == sorted(cuts)


def test_encode_query(spark, plain):
    rows = [*enumerate([*TEXTS, None]), (None, "x"), (0, "again"), (2**60 + 1, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumn("ids", df["doc_id"]).withColumn("n_tokens", df["text"])
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in K.encode_decode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, 64, 16).collect())
    want = []
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert K.encode_decode(df.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_counts_are_the_librarys(spark):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [*enumerate([*TEXTS, None]), (None, "x y z"), (77, "word " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in K.count_tokens(df, P.path("word_bpe_49k.json")).collect())
    n = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted((str(i), len((t or "").encode()), k, k > 2048) for (i, t), k in zip(rows, n, strict=True))


def test_every_character_counts_alike():
    lib, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), K.counter(P.path("word_bpe_49k.json"))
    chars = [chr(c) for c in [*range(0, 0x3100, 3), *range(0xA640, 0xA7FF), *range(0x10400, 0x10500, 7), 0x1E921, 0x16E45]]
    texts = [f"a{c}b {c}Q" for c in chars]
    for s, got in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.table(s).total == len(got.ids), ascii(s)


def test_prefix_tables():
    lib, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), K.counter(P.path("word_bpe_49k.json"))
    r = random.Random(2)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "<", ">", "|", "\t", " ", "a", "won't", "'s", "\x1c", "\x85", "é", "e\u0301", "\u0338", "12", "!"]
    made = ["".join(r.choices(bits, k=r.randrange(1, 9))) for _ in range(300)]
    for t in ["\t|><|endoftext|>", "Some unbelievable words, 1234 and it's <|endoftext|> Done", *TEXTS[:6], "Überraschung naïve", *made]:
        table = own.table(t)
        counts = [len(x.ids) for x in lib.encode_batch([t[:p] for p in range(len(t) + 1)], add_special_tokens=False)]
        assert [table.at(p) for p in range(len(t) + 1)] == counts, t
        assert table.total == counts[-1]
        for budget in range(counts[-1] + 2):
            assert table.at(table.longest(budget)) <= budget


def test_where_a_text_is_cut_for_the_limit(spark):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(1, "word " * 9), (2, "a b"), (3, None), (4, "unbelievable " * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in K.count_tokens(df, P.path("word_bpe_49k.json"), limit=5).collect():
        t = dict(rows)[r["doc_id"]] or ""
        assert r["over_limit"] == (r["n_tokens"] > 5) and len(lib.encode(t[: r["fits_chars"]], add_special_tokens=False).ids) <= 5
        assert r["over_limit"] or r["fits_chars"] == len(t)
