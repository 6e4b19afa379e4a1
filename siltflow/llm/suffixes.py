"""Removal of long strings that repeat anywhere in a corpus, by external induced sorting of suffixes."""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hash, own_names, prefix_hash, small_batches, span_hash, stored, text_or_empty

#: Bytes of a repeated string, and of the strings that anchor it.
LENGTH, GRAM = 400, 24
#: Bytes from which a passage that repeats is taken out of a corpus: fifty words of four letters, with their spaces.
PASSAGE = 250
#: Bytes of tuples that a queue holds in memory before it spills a sorted run, and suffixes that are induced together.
HELD, TOGETHER = 48 << 20, 30_000
#: Window starts of a text that are examined at once; the power of two that holds a place among them.
SLICE_BITS = 20


# ---------------------------------------------------------------- anchors
def _gram_order(raw: np.ndarray) -> np.ndarray:
    """Priorities of the GRAM-byte strings of a text, by their bytes alone. Strings in which 8 bytes recur at a distance of at
    most 16 come last: they abound in text that repeats itself, and would anchor it every few bytes."""
    h = gram_hash(raw, GRAM) >> np.uint64(1)
    n = len(h)
    w = np.zeros(n + 16, np.uint64)
    for i in range(8):
        w |= raw[i : i + n + 16].astype(np.uint64) << np.uint64(8 * i)
    again = np.zeros(n, bool)
    for p in range(1, GRAM - 8 + 1):
        again |= w[:n] == w[p : p + n]
    return h | again.astype(np.uint64) << np.uint64(63)


def anchors(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(h, a, b, q): the strings of `length` bytes that start in [a, b) are anchored at q, where the string of GRAM bytes with
    hash h stands, the first of least priority within them. Every start lies in one such range, and equal strings have their
    anchor at the same place, so they meet under its hash."""
    starts = len(raw) - length + 1
    if starts <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    width = length - GRAM + 1
    h = _gram_order(raw)
    q = np.empty(starts, np.int64)
    step, low = (1 << SLICE_BITS) - length, np.uint64((1 << SLICE_BITS) - 1)
    for at in range(0, starts, step):
        m = min(step, starts - at)
        x = h[at : at + m + width - 1]
        x = (x & ~low) | np.arange(len(x), dtype=np.uint64)
        x = np.r_[x, np.full(-len(x) % width, ~np.uint64(0))].reshape(-1, width)
        ahead = np.minimum.accumulate(x, axis=1).ravel()
        behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
        q[at : at + m] = (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & low).astype(np.int64) + at
    a = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    b = np.r_[a[1:], starts]
    return h[q[a]], a, b, q[a]


# ---------------------------------------------------------------- the queue
class DiskQueue:
    """A priority queue of tuples that holds a bounded number of bytes: full batches go to disk as sorted runs, and tuples come
    out by merging the runs. Its files are the task's own and are gone with it; a lost task starts over."""

    def __init__(self, held: int = HELD):
        self.most, self.size, self.batch, self.runs = held, 0, [], []

    def push(self, item: tuple, size: int) -> None:
        self.batch.append(item)
        self.size += size + 200
        if self.size > self.most:
            self.batch.sort()
            f = tempfile.TemporaryFile()
            for i in range(0, len(self.batch), 512):
                pickle.dump(self.batch[i : i + 512], f, protocol=5)
            self.runs.append(f)
            self.batch, self.size = [], 0

    @staticmethod
    def _read(f) -> Iterator[tuple]:
        f.seek(0)
        while True:
            try:
                yield from pickle.load(f)
            except EOFError:
                f.close()
                return

    def drain(self) -> Iterator[tuple]:
        self.batch.sort()
        return heapq.merge(*map(self._read, self.runs), self.batch) if self.runs else iter(self.batch)


# ---------------------------------------------------------------- induction
def _grid(parts: list[bytes], width: int) -> np.ndarray:
    """Rows of equal width from strings, padded with zeros; on disk if they are many."""
    if len(parts) * width <= 8 * HELD:
        return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width)
    f = tempfile.TemporaryFile()
    for p in parts:
        f.write(p.ljust(width, b"\0"))
    f.flush()
    return np.memmap(f, np.uint8, "r", shape=(len(parts), width))


def induce(group: np.ndarray, right: list[bytes], left: list[bytes], tmin: np.ndarray, tmax: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(element, t1, t2): the strings of `length` bytes that start t1..t2 bytes before an element's anchor occur elsewhere.

    Elements come sorted by (group, right), right being the text from the anchor on. Their order gives the common prefixes of
    neighbours. Then the order of the suffixes that start t + 1 bytes before the anchors is induced from that of those at t:
    tuples (preceding byte, rank) sorted anew, the common prefix of two neighbours being one more than the least between them
    before. A string repeats if a neighbour shares all its bytes; an element leaves when it can no longer come to that.
    """
    n = len(group)
    width = max(1, int(tmax.max(initial=0)))
    lens = length - tmin
    grid = _grid(right, length)
    lcp = np.zeros(n, np.int64)
    for i in range(1, n, 4096):
        j = min(n, i + 4096)
        same = grid[i:j] == grid[i - 1 : j - 1]
        lcp[i:j] = np.where(same.all(axis=1), length, same.argmin(axis=1))
    lcp[1:] = np.minimum(lcp[1:], np.minimum(lens[1:], lens[:-1])) * (group[1:] == group[:-1])
    before = _grid(left, width)
    if isinstance(before, np.ndarray) and not isinstance(before, np.memmap):
        before = np.asfortranarray(before)
    live = np.arange(n)
    since = np.full(n, -1)
    found: list[tuple] = []
    t = 0
    while len(live):
        near = np.maximum(lcp, np.r_[lcp[1:], 0])
        hit = (near >= length) & (tmin[live] <= t)
        was = since[live] >= 0
        on = live[hit & ~was]
        since[on] = t
        off = live[was & ~hit]
        found.append((off, since[off], np.full(len(off), t - 1)))
        since[off] = -1
        stay = (tmax[live] > t) & (near + (tmax[live] - t) >= length)
        end = live[~stay]
        end = end[since[end] >= 0]
        found.append((end, since[end], np.full(len(end), t)))
        since[end] = -1
        p = np.flatnonzero(stay)
        if not len(p):
            break
        lcp = np.minimum.reduceat(lcp[: p[-1] + 1], np.r_[0, p[:-1] + 1])
        lcp[0] = 0
        live = live[p]
        t += 1
        key = group[live] << 8 | before[live, t - 1]
        if (key[1:] >= key[:-1]).all():
            lcp = np.r_[0, np.where(key[1:] == key[:-1], lcp[1:] + 1, 0)]
        else:
            o = np.argsort(key, kind="stable")
            key, live = key[o], live[o]
            x, y = o[:-1] + 1, o[1:] + 1
            own = key[1:] == key[:-1]
            least = np.zeros(len(o) - 1, np.int64)
            pairs = np.stack([x[own], y[own]], axis=1).ravel()
            if len(pairs):
                least[own] = np.minimum.reduceat(np.r_[lcp, 0], pairs)[::2] + 1
            lcp = np.r_[0, least]
    return tuple(np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found, strict=True))


#: State of an element of a large group between two steps, and what is kept of it for its result.
_STATE = np.dtype([("i", "<i8"), ("lcp", "<i4"), ("since", "<i4"), ("tmin", "<i4"), ("tmax", "<i4")])
_NAME = np.dtype([("d", "<i8"), ("k", "<i8"), ("q", "<i8")])


def _records(files: list, size: int) -> Iterator[np.ndarray]:
    """Blocks of about `size` states from files in order; each file is closed when it is read."""
    held, n = [], 0
    for f in files:
        f.seek(0)
        while raw := f.read((size - n) * _STATE.itemsize):
            held.append(np.frombuffer(raw, _STATE))
            n += len(held[-1])
            if n >= size:
                yield np.concatenate(held)
                held, n = [], 0
        f.close()
    if n:
        yield np.concatenate(held)


def induce_large(items: Iterable[tuple], length: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """What repeated() gives, for one group of any size in memory for some blocks of `size` elements.

    The steps are those of induce(). The elements' states lie in files in the order of their suffixes; a step reads them once,
    and deals those that stay by their preceding byte to a file per byte, which is the stable sort. The common prefix of two
    neighbours in such a file is one more than the least since the last element with that byte. The preceding bytes lie on disk
    by block and column, so that a step reads one column of each.
    """
    names, before, first = tempfile.TemporaryFile(), tempfile.TemporaryFile(), tempfile.TemporaryFile()
    n, last, items = 0, None, iter(items)
    while part := list(islice(items, size)):
        tmin, tmax = (np.array([x[i] for x in part], np.int64) for i in (5, 6))
        right = np.frombuffer(b"".join(x[1].ljust(length, b"\0") for x in part), np.uint8).reshape(-1, length)
        lens = length - tmin
        state = np.zeros(len(part), _STATE)
        state["i"], state["since"], state["tmin"], state["tmax"] = np.arange(n, n + len(part)), -1, tmin, tmax
        if last is not None:
            right, lens = np.r_[last[0], right], np.r_[last[1], lens]
        for i in range(1, len(right), 4096):
            same = right[i : i + 4096] == right[i - 1 : min(i + 4096, len(right)) - 1]
            lcp = np.where(same.all(axis=1), length, same.argmin(axis=1))
            lcp = np.minimum(lcp, np.minimum(lens[i : i + 4096], lens[i - 1 : min(i + 4096, len(right)) - 1]))
            at = i - (last is not None)
            state["lcp"][at : at + len(lcp)] = lcp
        last = right[-1:].copy(), lens[-1:]
        first.write(state.tobytes())
        names.write(np.array([(x[2], x[3], x[4]) for x in part], _NAME).tobytes())
        left = np.frombuffer(b"".join(x[7].ljust(length, b"\0") for x in part), np.uint8).reshape(-1, length)
        columns = np.zeros((length, size), np.uint8)
        columns[:, : len(part)] = left.T
        before.write(columns.tobytes())
        n += len(part)
    for f in (names, before):
        f.flush()
    names, before = np.memmap(names, _NAME, "r"), np.memmap(before, np.uint8, "r")

    def named(s: np.ndarray, t2: int) -> Iterator[tuple[int, int, int, int]]:
        x = names[s["i"]]
        yield from zip(x["d"].tolist(), x["k"].tolist(), (x["q"] - t2).tolist(), (x["q"] - s["since"] + length).tolist(), strict=True)

    files, t, most = [first], 0, np.iinfo(np.int32).max
    while files:
        dealt: dict = {}
        least = np.full(256, most, np.int32)  # the least common prefix since the last element that was dealt to a byte
        blocks = _records(files, size)
        s = next(blocks, None)
        while s is not None:
            after = next(blocks, None)
            lcp = s["lcp"].copy()
            near = np.maximum(lcp, np.r_[lcp[1:], 0 if after is None else after["lcp"][0]])
            s = s.copy()
            hit = (near >= length) & (s["tmin"] <= t)
            was = s["since"] >= 0
            off = was & ~hit
            yield from named(s[off], t - 1)
            s["since"][off] = -1
            s["since"][hit & ~was] = t
            stay = (s["tmax"] > t) & (near + (s["tmax"] - t) >= length)
            yield from named(s[~stay & (s["since"] >= 0)], t)
            p = np.flatnonzero(stay)
            i = s["i"][p]
            byte = before[(i // size * length + t) * size + i % size]
            o = np.argsort(byte, kind="stable")
            p, byte = p[o], byte[o]
            starts = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]]) if len(p) else p
            low = np.full(len(p), most, np.int32)
            own = np.ones(len(p), bool)
            own[starts] = False
            pairs = np.stack([p[np.flatnonzero(own) - 1] + 1, p[own] + 1], axis=1).ravel()
            if len(pairs):
                low[own] = np.minimum.reduceat(np.r_[lcp, 0], pairs)[::2]
            here = np.minimum.accumulate(lcp)
            low[starts] = np.minimum(least[byte[starts]], here[p[starts]])
            out = s[p]
            out["lcp"] = low + 1
            least = np.minimum(least, here[-1])
            behind = np.r_[np.minimum.accumulate(lcp[::-1])[::-1], most]
            for a, b in zip(starts.tolist(), np.r_[starts, len(p)][1:].tolist(), strict=True):
                c = int(byte[a])
                least[c] = behind[p[b - 1] + 1]
                if c not in dealt:
                    dealt[c] = tempfile.TemporaryFile()
                    out["lcp"][a] = 0
                dealt[c].write(out[a:b].tobytes())
            s = after
        files, t = [dealt[c] for c in sorted(dealt)], t + 1


def repeated(items: Iterator[tuple], length: int = LENGTH, together: int = TOGETHER) -> Iterator[tuple[int, int, int, int]]:
    """(d, k, start, end) of repeated bytes, from (h, right, d, k, q, tmin, tmax, left) in order; whole groups of h at a time,
    as many as make `together` elements. A group of so many goes through files alone."""
    block: list[tuple] = []

    def done():
        h = np.array([x[0] for x in block])
        group = np.cumsum(np.r_[0, h[1:] != h[:-1]]).astype(np.int64)
        tmin, tmax = (np.array([x[i] for x in block], np.int64) for i in (5, 6))
        for i, t1, t2 in zip(*map(np.ndarray.tolist, induce(group, [x[1] for x in block], [x[7] for x in block], tmin, tmax, length)), strict=True):
            _, _, d, k, q, *_ = block[i]
            yield d, k, q - t2, q - t1 + length

    for _, group in groupby(items, itemgetter(0)):
        head = list(islice(group, together))
        if len(head) == together:
            yield from induce_large(chain(head, group), length, together)
            continue
        block += head
        if len(block) >= together:
            yield from done()
            block.clear()
    if block:
        yield from done()


# ---------------------------------------------------------------- DataFrames
def _named(docs: DataFrame) -> DataFrame:
    """docs with d and k, which name a text of a doc_id; equal rows share them."""
    text = text_or_empty()
    return docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("d"), F.xxhash64(text, F.col("doc_id").isNull()).alias("k"))


def _thinned(raw: np.ndarray, length: int) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """The anchors of a text, of anchors with the same fragment only the first two; and the merged spans of the others. As two
    places hold the fragment, all its strings repeat, so the others need no search. Text that repeats itself has many such."""
    h, a, b, q = anchors(raw, length)
    if len(h) < 3 or len(np.unique(h)) > len(h) - 2:
        return [h, a, b, q], []
    f = span_hash(prefix_hash(raw), a, b - 1 + length)
    o = np.argsort(f, kind="stable")
    third = np.zeros(len(f), bool)
    third[o[2:]] = (f[o[2:]] == f[o[1:-1]]) & (f[o[2:]] == f[o[:-2]])
    whole = raw.tobytes()
    for j in np.flatnonzero(third[o]).tolist():  # hashes may meet by chance
        x, y, z = (whole[a[i] : b[i] - 1 + length] for i in o[j - 2 : j + 1])
        third[o[j]] = x == y == z
    known = merged([{"s": s, "e": e} for s, e in zip(a[third].tolist(), (b[third] - 1 + length).tolist(), strict=True)])
    return [x[~third] for x in (h, a, b, q)], known


def _digests(raw: bytes, a: np.ndarray, b: np.ndarray, length: int) -> list[bytes]:
    """128 bits of each fragment: the bytes of all strings that start in [a, b)."""
    whole = memoryview(raw)
    return [hashlib.blake2b(whole[i:j], digest_size=16).digest() for i, j in zip(a.tolist(), (b - 1 + length).tolist(), strict=True)]


def _find_anchors(named: DataFrame, length: int) -> DataFrame:
    """(h, d, k, a, b, q, f, g) of the anchors, f and g the fragment's digest; rows without h hold spans [a, b) that are known to
    repeat."""
    names = ["h", "d", "k", "a", "b", "q", "f", "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t.encode() for t in part.column("text").to_pylist()]
                both = [_thinned(np.frombuffer(t, np.uint8), length) for t in texts]
                dk = [part.column(c).to_numpy() for c in ("d", "k")]
                h, a, b, q = (np.concatenate(c) for c in zip(*(x for x, _ in both), strict=True))
                d, k = (np.repeat(x, [len(y[0]) for y, _ in both]) for x in dk)
                whole = b"".join(y for t, (x, _) in zip(texts, both, strict=True) for y in _digests(t, x[1], x[2], length))
                f, g = np.frombuffer(whole, np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (h.view(np.int64), d, k, a, b, q, f, g)], names)
                n = [len(x) for _, x in both]
                if any(n):
                    at = np.array([x for _, y in both for x in y], np.int64)
                    none = pa.nulls(len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, *(pa.array(np.repeat(x, n)) for x in dk), pa.array(at[:, 0]), pa.array(at[:, 1]), none, none, none], names)

    return named.select("d", "k", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(d, k, spans) of the texts that hold repeated strings; spans are [start, end) of bytes, unmerged."""
    small_batches(docs)
    named = _named(docs)
    found = stored(_find_anchors(named, length))
    anchored = found.where("h IS NOT NULL")
    shared = anchored.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    live = stored(anchored.join(shared, "h"))
    # a fragment that occurs more than once repeats as a whole: its copies need no search, and one of them stands for all in the others'
    same = stored(live.groupBy("h", "f", "g").agg(F.count("*").alias("n"), F.min(F.struct("d", "k", "a", "b", "q")).alias("at")))
    copies = live.join(same.where("n > 1").select("h", "f", "g"), ["h", "f", "g"], "left_semi")
    several = same.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    live = same.join(several, "h").select("h", "at.*").groupBy("d", "k").agg(F.collect_set(F.struct("h", "a", "b", "q")).alias("at"))

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out: dict = {c: [] for c in ("h", "d", "k", "a", "q", "n", "bytes")}
                for d, k, text, at in zip(*(part.column(c).to_pylist() for c in ("d", "k", "text", "at")), strict=True):
                    raw = text.encode()
                    for x in at:
                        for c, v in zip(out, (x["h"], d, k, x["a"], x["q"], x["b"] - x["a"], raw[x["a"] : x["b"] - 1 + length]), strict=True):
                            out[c].append(v)
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.binary() if c == "bytes" else pa.int64()) for c, v in out.items()})

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = DiskQueue()
        for batch in batches:
            for h, d, k, a, q, n, raw in zip(*(batch.column(c).to_pylist() for c in ("h", "d", "k", "a", "q", "n", "bytes")), strict=True):
                t = q - a
                queue.push((h, raw[t:], d, k, q, t - n + 1, t, raw[:t][::-1]), len(raw))
        rows = []
        names = ["d", "k", "s", "e"]
        for row in repeated(queue.drain(), length):
            rows.append(row)
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # all columns of named go through this shuffle, so that the join which dedup() makes later reuses it
    cutout = named.join(live, ["d", "k"]).mapInArrow(fragments, "h long, d long, k long, a long, q long, n long, bytes binary")
    # one shard per partition: all that an anchor's hash names is in one
    hits = cutout.repartition(n, "h").mapInArrow(sorted_out, "d long, k long, s long, e long")
    hits = hits.unionByName(found.where("h IS NULL").select("d", "k", F.col("a").alias("s"), F.col("b").alias("e")))
    hits = hits.unionByName(copies.select("d", "k", F.col("a").alias("s"), (F.col("b") - 1 + length).alias("e")))
    return hits.groupBy("d", "k").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in found or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in cuts)]
    starts = [*(s for s, _ in cuts), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(ends, starts, strict=True))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document what is left without the bytes that lie in a string of `length` bytes which also starts anywhere else.

    Texts are cut at anchors that depend on the bytes around them alone, so that equal strings are anchored alike. Anchors that
    occur once are dropped. Of equal fragments (by 128-bit digests) all are taken out and one goes on, so that a group of copies
    is counted before it is dealt; the different fragments around an anchor are dealt by its hash into shards. A shard queues its
    suffixes on disk, in order of the text from the anchor on, and induces the order of the suffixes before the anchors byte by
    byte with their common prefixes. A shard's memory is bounded by the queue and two blocks of elements; a group as large as a
    block goes through files from step to step.

    Result: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256. A null text is the empty text; texts
    shorter than `length` bytes lose nothing; rows that are equal are different documents, so they lose all their strings. An
    empty table gives no rows; columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                n, lost, runs, sha = [], [], [], []
                for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    raw, cuts = text.encode(), merged(found)
                    kept = without(raw, cuts)
                    n.append(len(raw))
                    lost.append(len(raw) - len(kept))
                    runs.append(len(cuts))
                    sha.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, lost, runs)), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    named = _named(docs)
    rows = named.join(spans(docs, length), ["d", "k"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame, length: int = PASSAGE) -> DataFrame:
    """docs with the repeated strings taken out of `text`, and n_chars, if there is one, set anew. A character of which a byte
    goes is taken out whole. Documents of which nothing but white space is left are dropped, except where nothing was taken.

    Null and empty texts lose nothing and stay as they are; equal rows lose all that they have in common; an empty table gives
    no rows; all columns but text and n_chars pass as they are, whatever their names."""

    @F.udf("string", useArrow=True)
    def rest(text, found):
        return None if found is None else without(text.encode(), merged(found)).decode("utf-8", "ignore")

    rest = rest.asNondeterministic()  # it isn't, but is run twice otherwise, for the filter and for the column
    d, k, at, left = own_names(docs, "d", "k", "at", "left")
    named = docs.withColumns({d: F.coalesce("doc_id", F.lit(0)).cast("long"), k: F.xxhash64(text_or_empty(), F.col("doc_id").isNull())})
    s = spans(docs, length).select(F.col("d").alias(d), F.col("k").alias(k), F.col("spans").alias(at))
    out = named.join(s, [d, k], "left").withColumn(left, F.when(F.col(at).isNotNull(), rest("text", at)))
    out = out.where(F.col(at).isNull() | (F.length(F.trim(left)) > 0)).withColumn("text", F.coalesce(left, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(at).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*docs.columns)
