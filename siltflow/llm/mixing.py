"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, own_names, text_or_empty

#: Fixed values. Words: runs of anything but ASCII white space. Weights of the sources in the order of their names.
WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Words of a block; a slot of the schedule takes one block.
BLOCK = 256
#: The golden ratio's fraction of 2**31, made odd: slot n stands at n * STEP mod 2**31.
BITS, STEP = 31, 1327217885
CELL_BITS = 12
CHUNK = 1 << 15
#: Rows of a source, by expectation, of which one task makes running sums.
ROWS_PER_BUCKET = 4096


def word_count(col):
    """Number of runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source its weight and its target words, from (source, source_size); one row per source, so windows over all are small.

    Water is poured by weight up to a cap of `most` times the source's size. In the order of cap / weight the full sources come
    first; with j of them full, the level is (total - their caps) / (the others' weights), and j is right where no further
    source lies under the level: the first that is not full fixes it, and later levels are lower.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    t = t.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    t = t.withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("w_rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("w_rest"))
    t = t.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    t = t.withColumn("fixed_level", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    return t.select("source", "source_size", "w", F.when(F.col("full"), F.col("cap")).otherwise(F.col("fixed_level") * F.col("w")).alias("target"))


def schedule(goal: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """(sid, slot, rank): slot n stands at the golden-ratio point n * STEP mod 2**31, which the cumulative targets map to a
    source; rank counts the source's slots from 0. The points of a source's interval are found by an equi-join on cells."""
    spark = goal.sparkSession
    full = F.sum("target").over(Window.partitionBy(F.lit(1)))
    upto = F.sum("target").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    span = F.lit(float(1 << BITS))
    edges = goal.withColumn("hi", F.round(upto / full * span).cast("long"))
    edges = edges.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0))).where("hi > lo")
    shift = BITS - CELL_BITS
    edges = edges.select("sid", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))).alias("cell"))
    n_slots = max(1, round(total / block))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id") + 1, F.lit(1 << BITS)) * F.lit(STEP), F.lit(1 << BITS)).alias("u"))
    # Cells and sources are few, at most 2**CELL_BITS plus the number of sources.
    hit = slots.withColumn("cell", F.shiftright("u", shift)).join(edges, "cell").where("lo <= u and u < hi")
    hit = hit.select("sid", "slot", F.expr(f"slot div {CHUNK}").alias("chunk"))
    per = hit.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    per = per.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    return hit.withColumn("r", rank).join(per.select("sid", "chunk", "base"), ["sid", "chunk"]).select("sid", "slot", (F.col("base") + F.col("r")).alias("rank"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: int = 17, keep_hash: bool = False) -> DataFrame:
    """How many words of each document the mix takes.

    Each source's documents stand in the order of a seeded hash, its shuffled word stream runs `most` times, and the stream is
    cut into blocks of `block` words. The schedule's slot of rank r in a source takes the source's block r; a document's
    `taken` is the sum of its parts in the taken blocks. A source's taken words are its slots times the block, so within a few
    blocks of the target; no document is taken more than `most` times its size.

    Running sums go by buckets of the hash order, their number in proportion to the source's rows, so a hot source spreads.

    Result: doc_id, source, size, source_size, target, taken. Null text has size 0; a null source is a source of its own, last in
    order; equal rows count apiece; an empty table or one without words takes 0. Other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(
        "doc_id",
        F.col("source").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", text_or_empty()).alias("h"),
        F.xxhash64(text_or_empty()).alias("text_hash"),
    )
    base = cut(base.withColumn("h", F.shiftright(F.col("h"), 1) + F.lit(1 << 62)))  # 0 .. 2**63 - 1, in order
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(per.select("source", "source_size"), weights, share, most).join(per.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    buckets = F.greatest(F.lit(1), F.expr(f"n div {ROWS_PER_BUCKET}"))
    goal = cut(goal.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("buckets", buckets))
    total = goal.agg(F.sum("target")).first()[0] or 0.0
    g = goal.select(F.col("source").alias("s2"), "sid", "source_size", "target", "buckets")
    rows = base.join(g, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    rows = rows.withColumn("bucket", F.floor(F.col("h") / F.lit(float(1 << 63)) * F.col("buckets")))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("upto", upto).join(sums.select("sid", "bucket", "base"), ["sid", "bucket"])
    placed = placed.withColumn("row_id", F.monotonically_increasing_id()).withColumn("at", F.col("base") + F.col("upto") - F.col("size"))
    placed = cut(placed.select("row_id", "doc_id", "source", "sid", "size", "source_size", "target", "at", "text_hash"))
    slots = schedule(goal.select("sid", "target"), round(total), block)
    # A document's words in each run of the stream, cut at block edges.
    piece = placed.where("size > 0").select("row_id", "sid", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.col("at") + e * F.col("source_size"))).alias("a"))
    piece = piece.withColumn("b", F.col("a") + F.col("size"))
    piece = piece.select("row_id", "sid", "a", "b", F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(b - 1) div {block}"))).alias("rank"))
    part = F.least("b", (F.col("rank") + 1) * block) - F.greatest("a", F.col("rank") * block)
    got = piece.withColumn("part", part).join(slots, ["sid", "rank"]).groupBy("row_id").agg(F.sum("part").alias("taken"))
    out = placed.join(got, "row_id", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *["text_hash"] * keep_hash)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with a row for each time that the mix takes a document, whole where it takes at least half of its words.

    Documents without words (null, empty, blank) aren't in a mix; of equal rows each has its own share; an empty table gives no
    rows; all columns pass as they are, whatever their names."""
    d, s, k, i, n, copy, td, ts, tk, ti = own_names(docs, "d", "s", "k", "i", "n", "copy", "td", "ts", "tk", "ti")
    rows = docs.withColumns({d: F.col("doc_id"), s: F.col("source"), k: F.xxhash64(text_or_empty())})
    rows = rows.withColumn(i, F.row_number().over(Window.partitionBy(d, s, k).orderBy(F.lit(1))))
    taken = mix(docs, **options, keep_hash=True).where("size > 0")
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    t = taken.select(F.col("doc_id").alias(td), F.col("source").alias(ts), F.col("text_hash").alias(tk), times.alias(n))
    t = t.withColumn(ti, F.row_number().over(Window.partitionBy(td, ts, tk).orderBy(F.desc(n)))).where(F.col(n) > 0)
    on = F.col(d).eqNullSafe(F.col(td)) & F.col(s).eqNullSafe(F.col(ts)) & (F.col(k) == F.col(tk)) & (F.col(i) == F.col(ti))
    return rows.join(t, on).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
