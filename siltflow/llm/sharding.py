"""Shards of near-equal bytes: best-fit-decreasing packing of indivisible groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, text_or_empty, utf8_size

#: Items that the packer sees per shard. A group at least this part of a shard is an item of its own, so there are at most
#: ITEMS_PER_SHARD of them per shard; all smaller groups meet in ITEMS_PER_SHARD hashed bundles per shard.
ITEMS_PER_SHARD = 1024
#: Rows of an item that one task numbers.
ROWS_PER_SALT = 20_000


class _Node:
    __slots__ = ("key", "left", "level", "right")

    def __init__(self, key):
        self.key, self.left, self.right, self.level = key, None, None, 1


class BalancedTree:
    """An AA tree of (room, bin) pairs: insert, remove and lowest key at or above a bound in logarithmic time."""

    def __init__(self):
        self.root = None

    def ceiling(self, key):
        best, at = None, self.root
        while at is not None:
            if at.key >= key:
                best, at = at.key, at.left
            else:
                at = at.right
        return best

    def insert(self, key):
        self.root = self._insert(self.root, key)

    def remove(self, key):
        self.root = self._remove(self.root, key)

    @staticmethod
    def _skew(t):
        if t is not None and t.left is not None and t.left.level == t.level:
            t.left.right, t.left, t = t, t.left.right, t.left
        return t

    @staticmethod
    def _split(t):
        if t is not None and t.right is not None and t.right.right is not None and t.right.right.level == t.level:
            up = t.right
            t.right, up.left = up.left, t
            up.level += 1
            return up
        return t

    def _insert(self, t, key):
        if t is None:
            return _Node(key)
        if key < t.key:
            t.left = self._insert(t.left, key)
        elif key > t.key:
            t.right = self._insert(t.right, key)
        return self._split(self._skew(t))

    def _remove(self, t, key):
        if t is None:
            return None
        if key < t.key:
            t.left = self._remove(t.left, key)
        elif key > t.key:
            t.right = self._remove(t.right, key)
        elif t.left is None:
            return t.right
        else:
            low = t.left
            while low.right is not None:
                low = low.right
            t.key = low.key
            t.left = self._remove(t.left, low.key)
        level = 1 + min(t.left.level if t.left else 0, t.right.level if t.right else 0)
        if level < t.level:
            t.level = level
            if t.right is not None and t.right.level > level:
                t.right.level = level
        t = self._skew(t)
        if t.right is not None:
            t.right = self._skew(t.right)
            if t.right.right is not None:
                t.right.right = self._skew(t.right.right)
        t = self._split(t)
        if t.right is not None:
            t.right = self._split(t.right)
        return t


def best_fit_decreasing(sizes: list[int], bins: int, capacity: int) -> list[int] | None:
    """The bin of each item, or None if `bins` bins of `capacity` don't hold them. Ties go to the lower bin."""
    tree, room = BalancedTree(), [capacity] * bins
    for b in range(bins):
        tree.insert((capacity, b))
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = tree.ceiling((sizes[i], -1))
        if got is None:
            return None
        b = got[1]
        tree.remove(got)
        room[b] -= sizes[i]
        tree.insert((room[b], b))
        out[i] = b
    return out


def pack(sizes: list[int], bins: int) -> list[int]:
    """Near-equal bins: groups above a fair share get a bin each, the rest the smallest capacity tried that fits all."""
    out, order, alone = [0] * len(sizes), sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), 0
    rest = sum(sizes)
    while alone < len(order) and alone < bins - 1 and sizes[order[alone]] * (bins - alone) > rest:
        out[order[alone]] = alone
        rest -= sizes[order[alone]]
        alone += 1
    items = order[alone:]
    left, slack = bins - alone, 0.0
    while True:
        capacity = max(-(-int(rest * (1 + slack)) // left) + 1, max((sizes[i] for i in items[:1]), default=0))
        if (got := best_fit_decreasing([sizes[i] for i in items], left, capacity)) is not None:
            for i, b in zip(items, got, strict=True):
                out[i] = alone + b
            return out
        slack = max(0.0002, slack * 1.6)


def shard(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Put all documents into shards of near-equal bytes; documents of equal text are one indivisible group.

    Groups sorted by size enter the bin with the least room that still holds them, looked up in a balanced tree. The driver
    packs at most 2 * ITEMS_PER_SHARD * n_shards items, whatever the size of the corpus: groups of at least a
    1 / ITEMS_PER_SHARD part of a shard are items, smaller ones meet in hashed bundles. A group above a fair share gets a
    shard to itself. Slots are numbered from 0 without gaps: each item has a range of slots and is numbered in salted parts.

    Result: doc_id, size, text_crc32, law, shard, slot, grown_shard. Null text is the empty text (size 16, CRC 0); rows with
    equal or null doc_id keep a slot each; an empty table gives no rows. Other columns of docs are not read.
    """
    base = docs.select(
        F.col("doc_id").alias("doc_id"),
        (utf8_size() + 16).alias("size"),
        F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"),
        F.xxhash64(text_or_empty(), F.lit(7)).alias("k1"),
        F.xxhash64(F.lit(11), text_or_empty()).alias("k2"),
    )
    base = cut(base)
    group = ["k1", "k2", "text_crc32", "size"]
    groups = cut(base.groupBy(*group).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = max(1, total // (n_shards * ITEMS_PER_SHARD))
    is_large = F.col("bytes") >= large
    bundles = n_shards * ITEMS_PER_SHARD
    item = F.when(is_large, F.struct(F.col("k1").alias("a"), F.col("k2").alias("b"))).otherwise(
        F.struct(F.pmod("k1", F.lit(bundles)).alias("a"), F.lit(None).cast("long").alias("b"))
    )
    keyed = groups.withColumn("item", item)
    items = keyed.groupBy("item").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).orderBy("item").collect()
    place = pack([r["bytes"] for r in items], n_shards)
    rows = [(r["item"]["a"], r["item"]["b"], b, max(1, -(-r["n"] // ROWS_PER_SALT))) for r, b in zip(items, place, strict=True)]
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("salts", T.LongType())])
    placed = docs.sparkSession.createDataFrame(rows, schema)
    where = keyed.select(*group, F.col("item.a").alias("a"), F.col("item.b").alias("b")).join(
        F.broadcast(placed.select(F.col("a").alias("pa"), F.col("b").alias("pb"), "shard", "salts")),
        (F.col("a") == F.col("pa")) & F.col("b").eqNullSafe(F.col("pb")),
    )
    # A group of large size may hold most rows: Spark splits that side, and numbering goes by salted parts.
    rowed = base.join(where.select(*group, "a", "b", "shard", "salts"), group).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    rowed = cut(rowed.select("doc_id", "size", "text_crc32", "a", "b", "shard", "salt"))
    part = ["shard", "a", "b", "salt"]
    starts = rowed.groupBy(*part).agg(F.count("*").alias("n"))
    starts = starts.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("a", F.col("b").asc_nulls_first(), "salt").rowsBetween(Window.unboundedPreceding, -1)))
    inner = F.row_number().over(Window.partitionBy(*part).orderBy("doc_id", "text_crc32", "size"))
    s = starts.select(*[F.col(c).alias(f"s_{c}") for c in part], F.coalesce("start", F.lit(0)).alias("start"))
    out = rowed.withColumn("inner", inner).join(
        s, (F.col("shard") == F.col("s_shard")) & (F.col("a") == F.col("s_a")) & F.col("b").eqNullSafe(F.col("s_b")) & (F.col("salt") == F.col("s_salt"))
    )
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("inner") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
