"""FLAC media columns: 8-bit mono streams written and read with array operations over many frames at a time."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: Samples of a frame; bytes that are coded at once by a worker (its arrays take some 60 bytes a sample).
BLOCK, AT_ONCE = 512, 1 << 21
RATE = 8000
#: Fixed values of the format: generator polynomials, fixed predictors' coefficients by order, frame header codes.
CRC8_POLY, CRC16_POLY = 0x07, 0x8005
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
BLOCK_CODES = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5, 256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12, 8192: 13, 16384: 14, 32768: 15}
BLOCK_OF = {v: k for k, v in BLOCK_CODES.items()}
SIZE_OF = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}

_tables: dict = {}


class FlacError(ValueError):
    """The stream breaks the format or a checksum."""


# ---------------------------------------------------------------- checksums
def _crc_table(poly: int, width: int) -> np.ndarray:
    if (poly, width) not in _tables:
        c = np.arange(256, dtype=np.uint32) << (width - 8)
        for _ in range(8):
            c = np.where(c >> (width - 1) & 1, (c << 1) ^ poly, c << 1) & ((1 << width) - 1)
        _tables[poly, width] = c
    return _tables[poly, width]


def crc8(data: bytes) -> int:
    t, c = _crc_table(CRC8_POLY, 8), 0
    for b in data:
        c = int(t[c ^ b])
    return c


def _crc16_by_place(n: int) -> np.ndarray:
    """[d, b]: what byte b adds to the checksum with d bytes after it; the checksum is the XOR of all."""
    have = _tables.get("place")
    if have is None or len(have) < n:
        t = _crc_table(CRC16_POLY, 16)
        rows = [t]
        for _ in range(max(n, 1536) - 1):
            c = rows[-1]
            rows.append(((c << 8) & 0xFFFF) ^ t[c >> 8])
        _tables["place"] = have = np.stack(rows).astype(np.uint16)
    return have


def crc16_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of buf[start:end] for many non-empty spans that follow one another."""
    n = end - start
    first = np.cumsum(n) - n
    own = np.arange(int(n.sum())) - np.repeat(first - start, n)
    behind = np.repeat(end, n) - 1 - own
    parts = _crc16_by_place(int(n.max())).ravel()[behind * 256 + buf[own]]
    return np.bitwise_xor.reduceat(parts, first)


# ---------------------------------------------------------------- writing
def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead = len(tail) + 1
        if n < 1 << (6 - len(tail)):
            return bytes([(0xFF << (8 - lead)) & 0xFF | n, *reversed(tail)])


def _frame_header(number: int, size: int) -> bytes:
    code = BLOCK_CODES.get(size, 7)
    head = struct.pack(">HBB", 0xFFF8, code << 4 | 4, 0b0010) + _number(number) + (struct.pack(">H", size - 1) if code == 7 else b"")
    return head + bytes([crc8(head)])


#: Bits of a quantised predictor coefficient.
PRECISION = 12


def _linear(x: np.ndarray, base: np.ndarray, n: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, ...]:
    """Coefficients [order, frame], shifts and residuals of linear predictors of all frames at once: each frame's
    autocorrelation under a Hann window, Levinson's recursion, and rounding to PRECISION bits."""
    v = x * (0.5 - 0.5 * np.cos(2 * np.pi * (place + 1) / np.repeat(n + 1, n)))
    r = np.empty((order + 1, len(base)))
    for lag in range(order + 1):
        both = np.zeros(len(x))
        both[lag:] = v[lag:] * v[: len(x) - lag]
        both[place < lag] = 0
        r[lag] = np.add.reduceat(both, base)
    r[0] = r[0] * 1.0001 + 1e-9
    a, err = np.zeros((order, len(base))), r[0].copy()
    for i in range(order):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(axis=0)) / err
        a[:i] = a[:i] - k * a[:i][::-1]
        a[i] = k
        err = err * (1 - k * k)
    most = (1 << (PRECISION - 1)) - 1
    shift = np.clip(PRECISION - 2 - np.ceil(np.log2(np.maximum(1e-9, np.abs(a).max(axis=0)))), 0, 15).astype(np.int64)
    coefs = np.clip(np.round(a * 2.0**shift), -most - 1, most).astype(np.int64)
    frame = np.repeat(np.arange(len(base), dtype=np.int32), n)
    pred = np.zeros(len(x), np.int64)
    for i in range(order):
        pred[i + 1 :] += coefs[i][frame[i + 1 :]] * x[: len(x) - 1 - i]
    e = x - (pred >> shift[frame])
    e[place < order] = 0
    return coefs, shift, e


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = value >> (width - 1 - j) & 1


def encode(payloads: list[bytes], block: int = BLOCK, lpc_order: int = 0, orders: tuple[int, ...] = (0, 1)) -> list[bytes]:
    """One FLAC stream per non-empty payload; a payload's bytes are the samples, less 128.

    Each frame takes the fixed predictor, of the given orders, with the least sum of residuals, or with lpc_order a quantised
    linear predictor where that is less, and one Rice parameter. The seek table has a point for each frame.
    """
    size = np.array([len(p) for p in payloads], np.int64)
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    per = -(-size // block)
    n_frames = int(per.sum())
    of = np.repeat(np.arange(len(payloads)), per)  # the stream of each frame
    number = np.arange(n_frames) - np.repeat(np.cumsum(per) - per, per)
    base = (np.cumsum(size) - size)[of] + number * block  # first sample in x
    n = np.minimum(block, size[of] - number * block)
    place = np.arange(len(x), dtype=np.int32) - np.repeat(base.astype(np.int32), n)  # of a sample in its frame
    frame = np.repeat(np.arange(n_frames, dtype=np.int32), n)

    best, res, order = np.full(n_frames, np.iinfo(np.int64).max), None, np.zeros(n_frames, np.int64)
    r = x.copy()
    for o in range(max(orders) + 1):
        if o:
            r = np.r_[r[:1], np.diff(r)]
            r[place < o] = 0
        if o in orders:
            cost = np.add.reduceat(np.abs(r), base, dtype=np.int64) + 8 * o
            cost[n <= o] = np.iinfo(np.int64).max
            better = cost < best
            res = r.copy() if res is None else np.where(better[frame], r, res)
            order[better], best = o, np.minimum(cost, best)
    is_lpc = np.zeros(n_frames, bool)
    if lpc_order:
        coefs, shift, e = _linear(x, base, n, place, lpc_order)
        cost = np.add.reduceat(np.abs(e), base) + 20 * lpc_order
        is_lpc = (n > lpc_order) & (cost < best) & (np.maximum.reduceat(np.abs(e), base) < 1 << 20)
        order[is_lpc] = lpc_order
        res = np.where(is_lpc[frame], e, res).astype(np.int32)
    constant = np.maximum.reduceat(x, base) == np.minimum.reduceat(x, base)

    coded = place >= np.repeat(np.where(constant, block, order).astype(np.int32), n)
    zig = (res << 1) ^ (res >> 31)
    zig *= coded
    mean = np.add.reduceat(zig, base, dtype=np.int64) / np.maximum(1, n - order)
    k = np.clip(np.floor(np.log2(np.maximum(mean, 1) * 0.85)), 0, 14).astype(np.int32)
    ks = np.repeat(k, n)
    q = zig >> ks
    width = (q + ks + 1) * coded
    extra = np.where(is_lpc, 9 + PRECISION * order, 0)
    lead = np.where(constant, 16, 8 + 8 * order + extra + 10)
    body = lead + np.add.reduceat(width, base, dtype=np.int64)
    heads = [_frame_header(int(i), int(m)) for i, m in zip(number, n, strict=True)]
    head_n = np.array([len(h) for h in heads])
    total = head_n + -(-body // 8) + 2
    end = np.cumsum(total)
    start = end - total
    bits = np.zeros(int(end[-1]) * 8, np.uint8)
    sub = (start + head_n) * 8
    kind = np.where(constant, 0, np.where(is_lpc, 32 + order - 1, 8 + order))
    _put(bits, sub, kind << 1, 8)
    _put(bits, sub[constant] + 8, x[base[constant]] & 0xFF, 8)
    for i in range(int(order.max(initial=0))):
        own = np.flatnonzero((order > i) & ~constant)
        _put(bits, sub[own] + 8 + 8 * i, x[base[own] + i] & 0xFF, 8)
    own = np.flatnonzero(is_lpc & ~constant)
    if len(own):
        at = sub[own] + 8 + 8 * lpc_order
        _put(bits, at, np.full(len(own), PRECISION - 1), 4)
        _put(bits, at + 4, shift[own], 5)
        for i in range(lpc_order):
            _put(bits, at + 9 + PRECISION * i, coefs[i, own] & (1 << PRECISION) - 1, PRECISION)
    rice = np.flatnonzero(~constant)
    _put(bits, sub[rice] + lead[rice] - 4, k[rice], 4)
    at = np.cumsum(width) - width
    at += np.repeat(sub + lead - at[base], n) + q
    if not coded.all():
        at, ks, zig = at[coded], ks[coded], zig[coded]
    bits[at] = 1
    at += ks
    for j in range(int(ks.max(initial=0))):
        if (ks > j).all():
            bits[at] = zig & 1
        else:
            own = ks > j
            bits[at[own]] = zig[own] & 1
        at -= 1
        zig >>= 1
    buf = np.packbits(bits)
    flat = np.frombuffer(b"".join(heads), np.uint8)
    buf[np.arange(len(flat)) + np.repeat(start - (np.cumsum(head_n) - head_n), head_n)] = flat
    crc = crc16_spans(buf, start, end - 2)
    buf[end - 2], buf[end - 1] = crc >> 8, crc & 0xFF

    out, f0 = [], np.cumsum(per) - per
    for i, p in enumerate(payloads):
        fr = slice(int(f0[i]), int(f0[i] + per[i]))
        s = start[fr]
        info = struct.pack(">HH", block, block) + int(total[fr].min()).to_bytes(3, "big") + int(total[fr].max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        seek = b"".join(struct.pack(">QQH", int(m) * block, int(o), int(c)) for m, o, c in zip(number[fr], s - s[0], n[fr], strict=True))
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + buf[s[0] : int(end[fr][-1])].tobytes())
    return out


# ---------------------------------------------------------------- reading
def parse(stream: bytes) -> dict:
    """Stream information, seek points (sample, byte offset, samples) and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise FlacError("no stream marker")
    at, out, last = 4, {"seek": []}, False
    while not last:
        if at + 4 > len(stream):
            raise FlacError("metadata cut short")
        last, kind, n = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body, at = stream[at + 4 : at + 4 + n], at + 4 + n
        if kind == 0:
            v = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[2:4], "big"), "bits": (v >> 36 & 31) + 1, "channels": (v >> 41 & 7) + 1, "rate": v >> 44, "samples": v & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            out["seek"] = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1]
    if "samples" not in out or out["channels"] != 1 or out["bits"] != 8:
        raise FlacError("not an 8-bit mono stream")
    return out | {"frames": at}


def _read_header(buf: np.ndarray, at: int) -> tuple[int, int, int]:
    """(frame number, samples, header bytes) of the frame at a byte, its CRC-8 verified."""
    h = buf[at : at + 16].tobytes()
    if h[:2] != b"\xff\xf8" or h[3] >> 4 or SIZE_OF.get(h[3] >> 1 & 7, 8) != 8:
        raise FlacError("no frame header")
    lead = 8 - (h[4] ^ 0xFF).bit_length() if h[4] & 0x80 else 1
    number = h[4] if lead == 1 else h[4] & (0x7F >> lead)
    for b in h[5 : 4 + lead]:
        number = number << 6 | b & 0x3F
    i, code, rate = 4 + lead, h[2] >> 4, h[2] & 15
    if code in (6, 7):
        n = int.from_bytes(h[i : i + code - 5], "big") + 1
        i += code - 5
    else:
        n = BLOCK_OF.get(code, 0)
    i += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not n or crc8(h[:i]) != h[i]:
        raise FlacError("frame header fails its CRC-8")
    return number, n, i + 1


def _windows(buf: np.ndarray) -> np.ndarray:
    """The 32 bits from each byte on."""
    p = np.zeros(len(buf) + 8, np.int64)
    p[: len(buf)] = buf
    return (p[:-3] << 24 | p[1:-2] << 16 | p[2:-1] << 8 | p[3:])[: len(buf) + 4]


def _take(win: np.ndarray, at: np.ndarray, n) -> np.ndarray:
    """n <= 24 bits from bit `at` on."""
    return (win[at >> 3] << (at & 7) & 0xFFFFFFFF) >> (32 - n)


def _signed(v: np.ndarray, n) -> np.ndarray:
    return v - ((v >> (n - 1) & 1) << n)


_ZEROS = np.r_[32, 15 - np.floor(np.log2(np.arange(1, 1 << 16)))].astype(np.int64)  # leading zeros of 16 bits; 32: more than these tell


def decode_frames(buf: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Samples, ends and numbers of the frames at those bytes of buf; all frames advance together, sample by sample."""
    heads = [_read_header(buf, int(a)) for a in at]
    number, n, head = (np.array(v, np.int64) for v in zip(*heads, strict=True))
    win = _windows(buf)
    pos = (at + head) * 8
    kind = _take(win, pos, 8)
    if (kind & 0x81).any():
        raise FlacError("wasted bits and set padding aren't supported")
    kind, pos = kind >> 1, pos + 8
    f, most = len(at), int(n.max())
    out = np.zeros((most, f), np.int32)
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not ((kind <= 1) | fixed | lpc).all():
        raise FlacError("unknown kind of subframe")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    own = np.flatnonzero(kind == 0)
    out[:, own] = _signed(_take(win, pos[own], 8), 8)
    pos[own] += 8
    for j in np.flatnonzero(kind == 1):
        raw = np.unpackbits(buf[pos[j] >> 3 : (pos[j] >> 3) + n[j] + 1])[pos[j] & 7 :][: 8 * n[j]]
        out[: n[j], j] = np.packbits(raw).view(np.int8)
        pos[j] += 8 * n[j]
    for i in range(int(order.max(initial=0))):
        own = np.flatnonzero(order > i)
        out[i, own] = _signed(_take(win, pos[own], 8), 8)
        pos[own] += 8
    coefs = np.zeros((f, int(order[lpc].max(initial=0))), np.int64)
    shift = np.zeros(f, np.int64)
    for j in np.flatnonzero(lpc):
        p = pos[j : j + 1]
        width, shift[j] = int(_take(win, p, 4)[0]) + 1, int(_signed(_take(win, p + 4, 5), 5)[0])
        for i in range(order[j]):
            coefs[j, i] = _signed(_take(win, p + 9 + width * i, width), width)[0]
        pos[j] += 9 + width * order[j]
    rows = np.flatnonzero(fixed | lpc)
    if len(rows):
        res, pos[rows] = _residuals(win, pos[rows], n[rows], order[rows], most)
        for o in range(5):
            own = rows[kind[rows] == 8 + o]
            if len(own):
                out[:, own] = _restore_fixed(out[:, own], res[:, kind[rows] == 8 + o], o)
        own = np.flatnonzero(lpc[rows])
        if len(own):
            out[:, rows[own]] = _restore_lpc(out[:, rows[own]].astype(np.int64), res[:, own], order[rows[own]], coefs[rows[own]], shift[rows[own]])
    end = (pos + 7) // 8 + 2
    if (end > len(buf)).any():
        raise FlacError("frame cut short")
    crc = crc16_spans(buf, at, end - 2)
    if (crc != (buf[end - 2].astype(np.uint16) << 8 | buf[end - 1])).any():
        raise FlacError("frame fails its CRC-16")
    return [out[: n[j], j] for j in range(f)], end, number


def _residuals(win: np.ndarray, pos: np.ndarray, n: np.ndarray, order: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Rice residuals of many frames in lockstep; [i, j] is sample i of frame j."""
    method, parts = _take(win, pos, 2), _take(win, pos + 2, 4)
    if (method > 1).any():
        raise FlacError("unknown residual coding")
    bits = 4 + method  # of a parameter
    pos, per = pos + 6, n >> parts
    most, f = int(n.max()), len(n)
    res = np.zeros((height, f), np.int32)
    k = np.zeros(f, np.int64)
    raw = np.full(f, -1, np.int64)
    limit = len(win) - 1
    by_n = np.argsort(-n, kind="stable")  # longer frames first, so that ended ones fall off at the end
    pos, per, order, bits, n_sorted = pos[by_n], per[by_n], order[by_n], bits[by_n], n[by_n]
    k1, low, escaped, due_at, warm = k + 1, k * 0, False, 0, int(order.max())
    live, next_part = f, order.copy()  # where the next parameter stands: at the first residual, then at each partition
    for i in range(int(order.min()), most):
        while n_sorted[live - 1] <= i:
            live -= 1
        p = pos[:live]
        if i >= due_at:
            own = np.flatnonzero(next_part[:live] == i)
            v = _take(win, np.minimum(p[own], limit * 8), bits[own])
            esc = v == (1 << bits[own]) - 1
            p[own] += bits[own]
            k[own], raw[own] = v, -1
            for j in own[esc]:
                raw[j] = int(_take(win, p[j : j + 1], 5)[0])
                p[j] += 5
            next_part[own] = (i // per[own] + 1) * per[own]
            k1, low, escaped = k + 1, (1 << k) - 1, bool((raw >= 0).any())
            due_at = int(next_part[:live].min())
        kk, p1, mask = k[:live], k1[:live], low[:live]
        w = win.take(p >> 3, mode="clip")
        w <<= p & 7
        w &= 0xFFFFFFFF
        q = _ZEROS.take(w >> 16)
        room = q + p1
        early = i < warm
        if escaped or early or room.max() > 24:
            v = (w >> np.clip(32 - room, 0, 32)) & mask | q << kk
            for j in np.flatnonzero((room > 24) | (raw[:live] >= 0) | (order[:live] > i)):
                v[j], room[j] = _one(win, int(p[j]), int(kk[j]), int(raw[j])) if order[j] <= i else (0, 0)
        else:
            v = w >> (32 - room)
            v &= mask
            v |= q << kk
        p += room
        res[i, :live] = (v >> 1) ^ -(v & 1)
    back = np.empty(f, np.int64)
    back[by_n] = np.arange(f)
    return res[:, back], pos[back]


def _one(win: np.ndarray, p: int, k: int, raw: int) -> tuple[int, int]:
    """A single residual, zigzag, and its bits: long quotients and escaped partitions."""

    def bit(i: int, n: int) -> int:
        if n == 0:
            return 0
        if (i + n) // 8 >= len(win):
            raise FlacError("frame cut short")
        return int(_take(win, np.array([i]), n)[0])

    if raw >= 0:
        v = bit(p, raw)
        v -= (v >> (raw - 1) & 1) << raw if raw else 0
        return (v << 1 if v >= 0 else -2 * v - 1), raw
    q = 0
    while not bit(p + q, 1):
        q += 1
    return q << k | bit(p + q + 1, k), q + 1 + k


def _restore_fixed(head: np.ndarray, res: np.ndarray, order: int) -> np.ndarray:
    """Running sums undo the differences: the warm-up samples' differences seed each of them."""
    r = res.copy()
    seeds, d = [], head[:order].copy()
    for _ in range(order):
        seeds.append(d[0].copy())
        d = np.diff(d, axis=0)
    for i in range(order - 1, -1, -1):
        r[:i] = 0
        r[i] = seeds[i]
        r[i:] = np.cumsum(r[i:], axis=0, dtype=np.int32)
    return r


def _restore_lpc(x: np.ndarray, res: np.ndarray, order: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    for i in range(int(order.min()), len(x)):
        own = np.flatnonzero(order <= i)
        pred = np.zeros(len(own), np.int64)
        for t in range(min(i, coefs.shape[1])):
            pred += coefs[own, t] * x[i - 1 - t, own]
        x[i, own] = (pred >> shift[own]) + res[i, own]
    return x


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads, after frame checksums, frame numbers, lengths and the MD5 of the samples are verified."""
    infos = [parse(s) for s in streams]
    buf = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    at = [base[i] + x["frames"] + o for i, x in enumerate(infos) for _, o, _ in x["seek"]]
    frames, ends, numbers = decode_frames(buf, np.array(at, np.int64)) if at else ([], np.zeros(0), np.zeros(0))
    out, j = [], 0
    for i, x in enumerate(infos):
        m = len(x["seek"])
        got = frames[j : j + m]
        if sum(map(len, got)) != x["samples"] or [p[0] for p in x["seek"]] != [int(k) * x["block"] for k in numbers[j : j + m]]:
            got = _in_turn(buf, int(base[i] + x["frames"]), x["samples"])  # the seek table doesn't name every frame
        j += m
        pcm = (np.concatenate(got) if got else np.zeros(0)).astype(np.int8)
        if any(x["md5"]) and hashlib.md5(pcm.tobytes()).digest() != x["md5"]:
            raise FlacError("samples fail their MD5")
        out.append((pcm.view(np.uint8) ^ 0x80).tobytes())
    return out


def _in_turn(buf: np.ndarray, at: int, samples: int) -> list[np.ndarray]:
    got, n = [], 0
    while n < samples:
        (x,), (at,), _ = decode_frames(buf, np.array([at], np.int64))
        got.append(x)
        n += len(x)
    return got


def read_samples(stream: bytes, start: int, n: int) -> bytes:
    """Payload bytes [start, start + n): only the frames that hold them are read, found through the seek table."""
    x = parse(stream)
    own = [p for p in x["seek"] if p[0] < start + n and p[0] + p[2] > start]
    if not own:
        return b""
    frames, _, _ = decode_frames(np.frombuffer(stream, np.uint8), np.array([x["frames"] + o for _, o, _ in own], np.int64))
    pcm = np.concatenate(frames).astype(np.int8).view(np.uint8) ^ 0x80
    return pcm[max(0, start - own[0][0]) :][:n].tobytes()


# ---------------------------------------------------------------- DataFrames
def _groups(sizes: list[int], most: int = AT_ONCE) -> Iterator[slice]:
    a, held = 0, 0
    for i, s in enumerate(sizes):
        if held and held + s > most:
            yield slice(a, i)
            a, held = i, 0
        held += s
    if a < len(sizes):
        yield slice(a, len(sizes))


def pad(text: str | None) -> bytes:
    """UTF-8 bytes, then zeros up to a positive multiple of 64; null is the empty text."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64)


def write_media(docs: DataFrame, block: int = BLOCK, lpc_order: int = 4) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a FLAC stream of 8-bit samples, one per payload byte, its frames with linear
    predictors of `lpc_order` where they are shorter than the fixed ones. Equal rows give equal streams. Null and empty texts
    give 64 zero samples; no shuffle, and a worker holds a batch of texts and AT_ONCE bytes' arrays."""

    def run(texts: list) -> dict:
        n = [len(t.encode()) if t else 0 for t in texts]
        return {"n_bytes": n, "media": [m for g in _groups(n, AT_ONCE // 8) for m in encode([pad(t) for t in texts[g]], block, lpc_order)]}

    return map_texts(docs, lambda: run, "n_bytes long, media binary")


def features(pcm: np.ndarray) -> str:
    """Sum, sum of absolute steps, sign changes and loudest sample of signed samples."""
    x = pcm.astype(np.int64)
    return f"{x.sum()},{np.abs(np.diff(x)).sum()},{int(((x[1:] < 0) != (x[:-1] < 0)).sum())},{np.abs(x).max(initial=0)}"


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of the samples read back from (doc_id, n_bytes, media); a broken stream raises FlacError."""

    def run(streams: list) -> dict:
        out: dict = {"payload_bytes": [], "payload_sha256": [], "tail_crc32": [], "media_bytes": [len(m) for m in streams], "media_sha256": [hashlib.sha256(m).hexdigest() for m in streams], "feature": []}
        for g in _groups(out["media_bytes"]):
            for p in decode(streams[g]):
                out["payload_bytes"].append(len(p))
                out["payload_sha256"].append(hashlib.sha256(p).hexdigest())
                out["tail_crc32"].append(zlib.crc32(p[-64:]))
                out["feature"].append(features((np.frombuffer(p, np.uint8) ^ 0x80).view(np.int8)))
        return out

    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_texts(media, lambda: run, schema, ("doc_id", "n_bytes"), "media")
