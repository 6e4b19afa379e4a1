import hashlib
import random
import zlib

import numpy as np
import pytest

from siltflow.llm import flac


def payloads():
    r = random.Random(1)
    odd = [b"\0" * 64, b"\xff" * 5000, r.randbytes(5000), b"\0\xff" * 3000, b"a", bytes(range(256)) * 20, b"ab" * 64]
    return [o + bytes(-len(o) % 64) for o in odd]


@pytest.mark.parametrize("options", [{}, {"block": 256}, {"block": 192, "orders": (0, 1, 2, 3, 4)}, {"lpc_order": 6}, {"lpc_order": 12, "block": 4096}, {"block": 100}])
def test_round_trip(options):
    p = payloads()
    assert flac.decode(flac.encode(p, **options)) == p


def test_seek_reads_any_range():
    p = payloads()[5]
    s = flac.encode([p])[0]
    assert all(flac.read_samples(s, a, 77) == p[a : a + 77] for a in range(0, len(p), 61))
    assert flac.read_samples(s, len(p) + 5, 3) == b""


def test_streams_without_a_seek_table():
    p = payloads()[5]
    s = flac.encode([p])[0]
    at = flac.parse(s)["frames"]
    assert flac.decode([s[:4] + b"\x80" + s[5:42] + s[at:]]) == [p]


def test_broken_streams_are_found():
    s = bytearray(flac.encode([payloads()[2]])[0])
    for at in (len(s) - 10, flac.parse(bytes(s))["frames"] + 2, 30):
        t = bytearray(s)
        t[at] ^= 4
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(t)])
    with pytest.raises(flac.FlacError):
        flac.decode([b"nonsense"])


def test_checksums():
    # the usual check values of these polynomials for the nine digits
    import numpy as np

    digits = np.frombuffer(b"123456789", np.uint8)
    assert flac.crc8(b"123456789") == 0xF4
    assert flac.crc16_spans(digits, np.array([0]), np.array([9]))[0] == 0xFEE8


def test_rice_escape_and_long_quotients():
    import numpy as np

    # a frame by hand: fixed order 0, one escaped partition of 5-bit residuals
    head = flac._frame_header(0, 4)
    bits = "0" + "001000" + "0" + "00" + "0000" + "1111" + "00101" + "".join(format(v & 31, "05b") for v in (3, -4, 15, -16))
    bits += "0" * (-len(bits) % 8)
    body = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = int(flac.crc16_spans(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0])
    (x,), _, _ = flac.decode_frames(np.frombuffer(body + crc.to_bytes(2, "big") + bytes(8), np.uint8), np.array([0]))
    assert x.tolist() == [3, -4, 15, -16]
    bits = "0" + "001000" + "0" + "00" + "0000" + "0000" + "".join("0" * q + "1" for q in (80, 1, 0, 41))
    bits += "0" * (-len(bits) % 8)
    body = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = int(flac.crc16_spans(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0])
    (x,), _, _ = flac.decode_frames(np.frombuffer(body + crc.to_bytes(2, "big") + bytes(8), np.uint8), np.array([0]))
    assert x.tolist() == [40, -1, 0, -21]


def test_query_rows(spark):
    texts = [None, "", "hello", "é" * 700, "hello", "x" * 5000]
    df = spark.createDataFrame([*enumerate(texts), (None, "null id")], "doc_id long, text string")
    df = df.withColumn("media", df["doc_id"]).withColumn("n_bytes", df["doc_id"])
    rows = {r["doc_id"]: r for r in flac.read_media(flac.write_media(df)).collect()}
    for i, t in [*enumerate(texts), (None, "null id")]:
        p = flac.pad(t)
        assert len(p) % 64 == 0 and len(p) > 0
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len((t or "").encode()), len(p))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:])
    assert rows[2]["media_sha256"] == rows[4]["media_sha256"] and rows[2]["feature"] == rows[4]["feature"]
    assert flac.read_media(flac.write_media(df.limit(0))).count() == 0


def test_linear_predictors_win_and_equal_payloads_give_equal_streams():
    r = np.random.default_rng(3)
    wave = [(128 + 90 * np.sin(np.arange(n) / w) + r.integers(-2, 3, n)).astype(np.uint8).tobytes() for n, w in ((9000, 7.0), (5000, 3.0), (64, 5.0))]
    texts = [b"some words and others " * 300, bytes(64), *wave]
    alone = [flac.encode([p], lpc_order=4)[0] for p in texts]
    assert flac.encode([*texts[::-1], *texts], lpc_order=4) == [*alone[::-1], *alone]
    assert flac.decode(alone) == texts
    fixed = flac.encode(wave[:2])
    assert all(len(a) < 0.9 * len(b) for a, b in zip(alone[2:4], fixed, strict=True))
    for p, s in zip(texts, alone, strict=True):
        assert flac.read_samples(s, len(p) - 50, 50) == p[-50:]
