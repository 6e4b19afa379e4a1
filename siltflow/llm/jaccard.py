"""Near-duplicate documents by the exact Jaccard similarity of their word n-gram sets: a distributed prefix-tree join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix64, prefix_hash, small_batches, span_hash, stored, tree_sum
from .components import components

#: Cells of the frequency sketch that orders the n-grams; one megabyte is broadcast, whatever the corpus.
CELL_BITS = 18
#: Postings of a bucket by expectation, and postings that a task gathers before it deals them to the buckets: they set what a
#: worker holds. Members of a posting list whose pairs are listed there and then.
BUCKET, GATHERED, SMALL = 100_000, 200_000, 4
#: Longs of a set's parity bitmap.
LONGS = 16
#: Members of a posting list and size class that may be hubs there; hubs that a set is tried with first.
PIVOTS, HUBS = 8, 2
#: Members of a posting list that are compared in one task.
TOGETHER = 4096
#: Documents that are probed against one hub by one task, of more they are salted.
HUB = 256
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POSTING = np.dtype([("token", "<u8"), ("key", "<u8"), ("n", "<u4"), ("pos", "<u4"), ("prev", "<u8"), ("u", "<u8"), ("v", "<u8")])


def gram_set(text: str | None, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of k words, sorted. Words are runs of anything but ASCII white space, with A-Z in
    lower case; a text of fewer words has its whole sequence as its one n-gram, one without words has none."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[raw], True]))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    w = span_hash(prefix_hash(raw), start, end)
    m = min(k, len(w))
    n = len(w) - m + 1
    h = np.full(n, m, np.uint64)
    for i in range(m):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[i : n + i])
    return np.unique(h)


def ordered(grams: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the global order: each n-gram's cell (its upper bits) is replaced by the cell's rank, rare cells first. This
    maps n-grams one to one, so equal numbers are equal n-grams."""
    low = np.uint64(64 - CELL_BITS)
    return np.sort(rank[(grams >> low).astype(np.int64)] << low | grams & np.uint64((1 << (64 - CELL_BITS)) - 1))


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def parity(grams: np.ndarray) -> np.ndarray:
    """For each of 64 * LONGS cells whether an odd number of n-grams fall in it. Two sets' bitmaps differ in no more bits than the
    sets differ in n-grams."""
    bits = np.bincount((mix64(grams) % np.uint64(64 * LONGS)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def needed(na, nb, pct: int):
    """Least size of the intersection at which 100 * intersection >= pct * union."""
    return -(-pct * (na + nb) // (100 + pct))


# ---------------------------------------------------------------- the prefix tree
def trie_probe(hub: np.ndarray, sets: list[np.ndarray], pct: int, step: int = 64) -> list[bool]:
    """Which of the sets link with the hub; all in the global order.

    The sets are the leaves of a prefix tree, walked depth first, which is their lexicographic order: a set keeps the partial
    overlaps of the path that it shares with the one before, and goes on below it. A branch is left as soon as its overlap and
    what remains of the shorter side can't reach the needed overlap; what hangs below a shared path is judged by that path.
    """
    out = [False] * len(sets)
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    prev, cum = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # the path, and the overlap after each of its known tokens
    for i in order:
        s = sets[i]
        m = min(len(cum), len(s), len(prev))
        differs = np.flatnonzero(prev[:m] != s[:m])
        at = int(differs[0]) if len(differs) else m
        cum, prev = cum[:at], s
        need = int(needed(len(hub), len(s), pct))
        ov = int(cum[-1]) if at else 0
        parts = [cum]
        while True:
            seen = int(np.searchsorted(hub, s[at - 1], "right")) if at else 0
            if ov + min(len(s) - at, len(hub) - seen) < need or at == len(s):
                break
            t = s[at : at + step]
            j = np.minimum(np.searchsorted(hub, t), len(hub) - 1)
            c = ov + np.cumsum(hub[j] == t)
            parts.append(c)
            ov, at = int(c[-1]), at + len(t)
        cum = np.concatenate(parts)
        out[i] = at == len(s) and ov >= need
    return out


# ---------------------------------------------------------------- passes over the texts
def _profile(docs: DataFrame, k: int) -> DataFrame:
    """One pass: per document its set's size and key (kind 0); per task how many n-grams fall in each cell (kind 1)."""

    names = ["kind", "d", "n", "a", "b", "bits", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            n, keys, bits = [], [], []
            for t in batch.column("text").to_pylist():
                g = gram_set(t, k)
                np.add.at(cells, (g >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
                n.append(len(g))
                keys.append(set_key(g))
                bits.append(parity(g))
            x = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            none = pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column("d"), pa.array(n, pa.int64()), pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(bits, pa.list_(pa.int64())), none], names)
        for part in range(16):
            own = cells[part << (CELL_BITS - 4) : (part + 1) << (CELL_BITS - 4)]
            at = np.flatnonzero(own)
            if len(at):
                blob = at.astype(np.uint32).tobytes() + own[at].tobytes()
                yield pa.RecordBatch.from_pydict({"kind": pa.array([1], pa.int32()), "d": [part], "n": [len(at)], "a": [0], "b": [0], "bits": pa.array([None], pa.list_(pa.int64())), "blob": [blob]})

    return docs.mapInArrow(run, "kind int, d long, n long, a long, b long, bits array<long>, blob binary")


def _cell_ranks(profile: DataFrame) -> np.ndarray:
    """The cells' ranks by how many n-grams of the whole corpus fall in them, fewest first."""

    def added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << (CELL_BITS - 4), np.int64)
        for n, blob in zip(pdf["n"], pdf["blob"], strict=True):
            total[np.frombuffer(blob, np.uint32, n)] += np.frombuffer(blob, np.int64, n, 4 * n)
        at = np.flatnonzero(total)
        return pd.DataFrame({"d": [key[0]], "n": [len(at)], "blob": [at.astype(np.uint32).tobytes() + total[at].tobytes()]})

    # each task sent at most 16 rows; 16 rows of at most 196 KB come back
    got = tree_sum(profile.where("kind = 1"), "d", added, "d long, n long, blob binary").collect()
    cells = np.zeros((16, 1 << (CELL_BITS - 4)), np.int64)
    for r in got:
        cells[r["d"], np.frombuffer(r["blob"], np.uint32, r["n"])] = np.frombuffer(r["blob"], np.int64, r["n"], 4 * r["n"])
    rank = np.empty(1 << CELL_BITS, np.uint64)
    rank[np.argsort(cells.ravel(), kind="stable")] = np.arange(1 << CELL_BITS, dtype=np.uint64)
    return rank


def _postings(docs: DataFrame, k: int, pct: int, rank: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, blob): for each different set of a task and each n-gram of its prefix a posting with the set's key, its size,
    the n-gram's place, the n-gram before and the set's bitmap folded to 128 bits. Two sets that link share an n-gram of their prefixes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, held, size = set(), [], 0

        def flush():
            x = np.concatenate(held)
            b = (x["token"] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(buckets)
            x, b = x[o := np.argsort(b, kind="stable")], b[o]
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True])
            return pd.DataFrame({"bucket": b[cuts[:-1]].astype(np.int64), "blob": [x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]})

        for pdf in batches:
            for t in pdf["text"]:
                g = gram_set(t, k)
                n = len(g)
                key = set_key(g)
                if not n or key in done:
                    continue
                done.add(key)
                t = ordered(g, rank)[: n + (-pct * n // 100) + 1]
                x = np.empty(len(t), _POSTING)
                x["token"], x["key"], x["n"], x["pos"] = t, int.from_bytes(key[:8], "little"), n, np.arange(len(t))
                x["prev"][0], x["prev"][1:] = 0, t[:-1]
                x["u"], x["v"] = np.bitwise_xor.reduce(parity(g).view(np.uint64).reshape(-1, 2))
                held.append(x)
                size += len(x)
                if size > GATHERED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInPandas(run, "bucket long, blob binary")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the folded bitmaps differ."""
    return np.bitwise_count(a["u"] ^ b["u"]).astype(np.int64) + np.bitwise_count(a["v"] ^ b["v"])


def _near(a: np.ndarray, b: np.ndarray, pct: int) -> np.ndarray:
    """Whether sizes and folded bitmaps allow two sets to link: bitmaps differ in no more bits than the sets in n-grams."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    return (100 * np.minimum(na, nb) >= pct * np.maximum(na, nb)) & (_apart(a, b) <= na + nb - 2 * needed(na, nb, pct))


def _admits(a: np.ndarray, b: np.ndarray, pct: int) -> np.ndarray:
    """Whether postings of one n-gram can belong to sets that link, and this is the first n-gram that they share."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    room = np.minimum(na - a["pos"], nb - b["pos"])
    fits = _near(a, b, pct) & (room >= needed(na, nb, pct))
    return fits & ((a["prev"] != b["prev"]) | (a["pos"] == 0) | (b["pos"] == 0))


def _stars(x: np.ndarray, pct: int) -> pd.DataFrame:
    """(a, b, n): for each posting of a list that one of the list's first PIVOTS sets of like size may link with, the one whose
    bitmap is nearest; n is the number of lists that propose the pair. Sets come in the order of their keys in any list, so
    that lists of like sets have the same pivots."""
    size = np.floor(np.log(np.maximum(1, x["n"])) / np.log(1.1)).astype(np.int64)
    o = np.lexsort((x["key"].astype(np.int64), size, x["token"]))
    y, size = x[o], size[o]
    head = np.flatnonzero(np.r_[True, (y["token"][1:] != y["token"][:-1]) | (size[1:] != size[:-1])][: len(y)])
    first = np.repeat(head, np.diff(np.r_[head, len(y)]))
    place = np.arange(len(y)) - first
    least, hub = np.full(len(y), np.iinfo(np.int64).max), np.full(len(y), -1)
    for p in range(PIVOTS):
        i = np.flatnonzero(place > p)
        a, b = y[first[i] + p], y[i]
        d = _apart(a, b)
        better = (d < least[i]) & _near(a, b, pct)
        i = i[better]
        least[i], hub[i] = d[better], first[i] + p
    own = np.flatnonzero(hub >= 0)
    pairs = np.stack([y["key"][hub[own]], y["key"][own]], axis=1).astype(np.int64)
    pairs, n = np.unique(pairs, axis=0, return_counts=True)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "n": n})


def _candidates(key: tuple, pdf: pd.DataFrame, pct: int) -> pd.DataFrame:
    """Of a bucket: pairs to try first (kind 0), the postings of longer lists (kind 1), all pairs of short lists (kind 2)."""
    x = np.frombuffer(b"".join(pdf["blob"]), _POSTING)
    x = x[np.lexsort((x["n"], x["key"], x["token"]))]
    new = np.r_[True, (x["token"][1:] != x["token"][:-1]) | (x["key"][1:] != x["key"][:-1]) | (x["n"][1:] != x["n"][:-1])]
    x = x[new]  # copies of a set meet here
    first = np.flatnonzero(np.r_[True, x["token"][1:] != x["token"][:-1]])
    m = np.repeat(np.diff(np.r_[first, len(x)]), np.diff(np.r_[first, len(x)]))
    x, m = x[m > 1], m[m > 1]
    out = [_stars(x, pct).assign(kind=0, token=0, pos=0, u=0, v=0, m=0)]
    # all pairs of short lists, by their distance in the list
    pairs, s = [np.zeros((0, 2), np.uint64)], x[m <= SMALL]
    for gap in range(1, SMALL):
        a, b = s[:-gap], s[gap:]
        own = a["token"] == b["token"]
        a, b = a[own], b[own]
        own = _admits(a, b, pct)
        pairs.append(np.stack([a["key"][own], b["key"][own]], axis=1))
    p = np.unique(np.sort(np.concatenate(pairs).astype(np.int64), axis=1), axis=0)
    out.append(pd.DataFrame({"kind": 2, "token": 0, "a": p[:, 0], "b": p[:, 1], "n": 0, "pos": 0, "u": 0, "v": 0, "m": 0}))
    long, m = x[m > SMALL], m[m > SMALL]
    out.append(pd.DataFrame({"kind": 1, "m": m} | {to: long[col].astype(np.int64) for to, col in (("token", "token"), ("a", "key"), ("b", "prev"), ("n", "n"), ("pos", "pos"), ("u", "u"), ("v", "v"))}))
    return pd.concat([p for p in out if len(p)] or out)[["kind", "token", "a", "b", "n", "pos", "u", "v", "m"]]


def _across(key: tuple, pdf: pd.DataFrame, pct: int) -> pd.DataFrame:
    """Pairs of longer lists whose sets aren't known to be connected; of a list that is dealt in parts, those of two parts."""
    x = np.empty(len(pdf), [*_POSTING.descr, ("part", "<i8"), ("c", "<i8")])
    for col in x.dtype.names[:-1]:
        x[col] = pdf[col].to_numpy(np.int64)
    codes, roots = pd.factorize(pdf["c"])  # sets without links are components of their own
    x["c"] = np.where(codes < 0, len(roots) + np.unique(x["key"], return_inverse=True)[1], codes)
    x = x[np.lexsort((x["key"], x["n"], x["token"]))]
    first = np.flatnonzero(np.r_[True, x["token"][1:] != x["token"][:-1]])
    found, two = [np.zeros((0, 2), np.int64)], key[1] != key[2]
    for i, j in zip(first, np.r_[first[1:], len(x)], strict=True):
        y = x[i:j]
        if (y["c"] == y["c"][0]).all():
            continue
        upto = np.searchsorted(y["n"], 100 * y["n"].astype(np.int64) // pct, "right")
        for a in range(len(y)):
            b = y[a + 1 : upto[a]]
            b = b[(b["c"] != y["c"][a]) & (not two or b["part"] != y["part"][a])]
            if len(b):
                b = b[_admits(np.broadcast_to(y[a], b.shape), b, pct)]
                found.append(np.stack([np.full(len(b), y["key"][a]).astype(np.int64), b["key"].astype(np.int64)], axis=1))
    p = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
    return pd.DataFrame({"a": p[:, 0], "b": p[:, 1]})


def _verify(docs: DataFrame, pairs: DataFrame, k: int, pct: int, rank: np.ndarray) -> DataFrame:
    """Of pairs (a, b) of documents those that link. a is the pair's hub; a hub of many pairs is salted."""
    load = pairs.groupBy("a").agg(F.count("*").alias("load"))
    salts = F.expr(f"1 + (load - 1) div {HUB}")
    asked = pairs.join(load, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), salts).alias("salt"), F.lit(1).alias("role"), F.col("b").alias("d"))
    hubs = load.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("d"))
    texts = docs.join(hubs.unionByName(asked), "d").select("hub", "salt", "role", "d", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", "role", "d")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, hubs, ids, sets = None, [], [], []

        def probed():
            rows = {(at[0], i) for h in hubs for i, ok in zip(ids, trie_probe(h, sets, pct), strict=True) if ok}
            return pd.DataFrame(sorted(rows), columns=["a", "b"], dtype="int64")

        for pdf in batches:
            found = []
            for hub, salt, role, d, text in pdf.itertuples(index=False):
                if (hub, salt) != at:
                    if ids:
                        found.append(probed())
                    at, hubs, ids, sets = (hub, salt), [], [], []
                g = ordered(gram_set(text, k), rank)
                if role == 0:
                    hubs.append(g)
                else:
                    ids.append(d)
                    sets.append(g)
            if found:
                yield pd.concat(found)
        if ids:
            yield probed()

    return dealt.mapInPandas(run, "a long, b long")


def classes(docs: DataFrame, k: int = 4, pct: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Sets of n-grams are ordered globally, rare first, by a sketch of all n-grams' frequencies. Every set's prefix is indexed;
    sets that share an n-gram of their prefixes and pass the bounds on size, place and bitmap are candidates, which one probe
    per hub tests in a prefix tree of the hub's candidates. A set is first tried with the HUBS sets alone that most of its
    posting lists propose; then all the other pairs of sets that aren't yet connected are tried, and those that link are links
    between the components found before. So a group of many near copies costs about its size and not its square, and no link
    between different components is lost. A list of more than TOGETHER sets is compared part by part, a task for two parts.
    Sets are compared as 64-bit hashes.

    Null, empty and blank texts have no n-grams and stand alone; equal sets are one class. Rows that share a doc_id are one
    document with several texts; a null doc_id takes no part and has a null component. An empty table gives no rows.
    """
    small_batches(docs)
    own = docs.select(F.col("doc_id").alias("d"), F.col("text").alias("text"))
    profile = cut(_profile(own, k))
    rows = profile.where("kind = 0").select("d", "n", "a", "b", "bits")
    rank = _cell_ranks(profile)
    known = own.where("d is not null")
    sets = rows.where("n > 0 and d is not null")
    groups = cut(sets.groupBy("a", "b", "n").agg(F.min("d").alias("rep"), F.first("bits").alias("bits")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, int(total * (100 - pct) / 100 / BUCKET))
    schema = "kind int, token long, a long, b long, n long, pos long, u long, v long, m long"
    found = stored(_postings(known, k, pct, rank, buckets).groupBy("bucket").applyInPandas(lambda key, pdf: _candidates(key, pdf, pct), schema))
    name = groups.select(F.col("a").alias("key"), "rep", "n", "bits")

    def named(pairs: DataFrame) -> DataFrame:
        """Different pairs of set keys, in order, as pairs of documents that stand for the sets, without those whose bitmaps differ
        in more bits than linked sets can differ in n-grams."""
        x, y = (name.select(F.col("key").alias(c), F.col("rep").alias(f"r{c}"), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
        apart = F.aggregate(F.zip_with("bitsa", "bitsb", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, u: t + u)
        size = F.col("na") + F.col("nb")
        least = F.ceil(size * pct / (100 + pct) - F.lit(1e-6))
        near = apart <= size - 2 * least
        p = pairs.join(x, "a").join(y.withColumnRenamed("b", "key"), (F.col("b") == F.col("key")) & (F.col("ra") != F.col("rb")) & near)
        return cut(p.select(F.col("ra").alias("a"), F.col("rb").alias("b")))

    # a set is first tried with the few sets that most of its lists propose
    proposed = found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    few = Window.partitionBy("b").orderBy(F.desc("n"), "a")
    tried = named(proposed.withColumn("i", F.row_number().over(few)).where(F.col("i") <= HUBS).select("a", "b"))
    roots = cut(components(_verify(known, tried, k, pct, rank)))
    label = name.select("key", F.col("rep").alias("node")).join(roots, "node").select("key", F.col("root").alias("c"))
    longer = found.where("kind = 1").select("token", F.col("a").alias("key"), F.col("b").alias("prev"), "n", "pos", "u", "v", "m").join(label, "key", "left")
    parts = F.expr(f"1 + (m - 1) div {TOGETHER}")
    longer = longer.withColumn("part", F.pmod(F.xxhash64("key"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    longer = longer.select("token", "key", "prev", "n", "pos", "u", "v", "c", "part", F.pmod(F.xxhash64("token"), F.lit(buckets)).alias("bucket"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    more = longer.groupBy("bucket", "i", "j").applyInPandas(lambda key, pdf: _across(key, pdf, pct), "a long, b long").unionByName(found.where("kind = 2").select("a", "b"))
    more = named(more.distinct())
    for side in ("a", "b"):
        more = more.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"c{side}")), side, "left")
    more = cut(more.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb").join(tried, ["a", "b"], "left_anti"))
    # what links two components is a link between their roots
    across = _verify(known, more.select("a", "b"), k, pct, rank).join(more, ["a", "b"])
    across = cut(across.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if not across.isEmpty():
        above = components(across)
        single = across.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti")
        nodes = roots.unionByName(single.select("node", F.col("node").alias("root")))
        top = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = cut(nodes.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    # documents that share a doc_id hold their sets together
    same = sets.join(groups, ["a", "b", "n"]).select(F.col("rep").alias("a"), F.col("d").alias("b")).where("a <> b")
    whole = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(same)) if _repeats(sets) else None
    if whole is not None:
        out = rows.join(whole, F.col("d") == F.col("node"), "left")
        return out.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "d").alias("component_id"))
    out = rows.join(groups.drop("bits"), ["a", "b", "n"], "left").join(roots, F.col("rep") == F.col("node"), "left")
    alone = F.when(F.col("d").isNull(), F.lit(None)).otherwise(F.coalesce("root", "rep", "d"))
    return out.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), alone.cast("long").alias("component_id"))


def _repeats(sets: DataFrame) -> bool:
    """Whether a doc_id stands on rows of different sets."""
    return not sets.groupBy("d").agg(F.countDistinct("a", "b").alias("n")).where("n > 1").isEmpty()


def keep_one(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """The documents that have the smallest doc_id of their component, all their columns as they are, whatever their names;
    documents without n-grams (null, empty, blank) and without doc_id stay. Of rows that repeat that doc_id all stay. An empty
    table gives no rows."""
    keep = classes(docs, k, pct).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, docs["doc_id"] == keep["doc_id"], "left_semi").unionByName(docs.where("doc_id is null"))
