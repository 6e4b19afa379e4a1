"""Stream sketches over rows (seq, batch, x): Bloom filter, Flajolet-Martin, bottom-k sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltflow.functions.hashing import text_mod, trailing_zeros

#: Size, modulus and coefficients of the Bloom filter, and of the Flajolet-Martin hashes.
BLOOM_BITS, BLOOM_MOD, FM_MOD = 69997, 78882, 69991
BLOOM_HASHES = ((1, 0), (2, 1), (3, 2))
FM_HASHES = tuple((7 * i + 3, 13 * i + 5) for i in range(15))


def numbered(events: DataFrame, key: str, order: list[str], per_batch: int = 100) -> DataFrame:
    """(seq, batch, x): rows numbered in a total order, in batches of a fixed size."""
    from siltflow.operators.analytics import with_index

    n = with_index(events.select(F.col(key).cast("string").alias("x"), *order), *order)
    return n.select(F.col("index").alias("seq"), F.expr(f"index div {per_batch}").alias("batch"), "x")


def bloom_bits(x, hashes=BLOOM_HASHES, p: int = BLOOM_MOD, m: int = BLOOM_BITS):
    """The bits of a text."""
    r = text_mod(x, p)
    return F.array(*[(r * a + b) % p % m for a, b in hashes])


def bloom_false_positives(stream: DataFrame, hashes=BLOOM_HASHES, p: int = BLOOM_MOD, m: int = BLOOM_BITS) -> DataFrame:
    """(batch, negatives, false_positives, fpr) of a filter that tests each element and then inserts it.

    Only an element's first appearance is a negative; it is a false positive if each of its bits was set by an earlier element.
    A bit is set when the first element that has it appears, so the state is the minimum of seq per bit: an aggregation.
    """
    first = stream.groupBy("x").agg(F.min(F.struct("seq", "batch")).alias("f")).select("x", "f.seq", "f.batch")
    each = first.select("x", "seq", "batch", F.explode(bloom_bits(F.col("x"), hashes, p, m)).alias("bit"))
    since = each.groupBy("bit").agg(F.min("seq").alias("since"))
    hit = each.join(since, "bit").groupBy("x", "batch", "seq").agg(F.bool_and(F.col("since") < F.col("seq")).alias("fp"))
    per = hit.groupBy("batch").agg(F.count("*").alias("negatives"), F.count_if("fp").alias("false_positives"))
    out = stream.select("batch").distinct().join(per, "batch", "left").na.fill({"negatives": 0, "false_positives": 0})
    return out.withColumn("fpr", F.when(F.col("negatives") > 0, F.col("false_positives") / F.col("negatives")).otherwise(0.0))


def distinct_estimates(stream: DataFrame, hashes=FM_HASHES, p: int = FM_MOD) -> DataFrame:
    """(batch, truth, estimate): the estimate is the median over the hashes of 2 to the most trailing zeros in the batch."""
    r = text_mod(F.col("x"), p)
    tails = [F.max(trailing_zeros((F.col("r") * a + b) % p)).alias(f"t{i}") for i, (a, b) in enumerate(hashes)]
    per = stream.withColumn("r", r).groupBy("batch").agg(F.count_distinct("x").alias("truth"), *tails)
    each = F.array_sort(F.array(*[F.pow(F.lit(2.0), F.col(f"t{i}")) for i in range(len(hashes))]))
    n = len(hashes)
    middle = each[n // 2] if n % 2 else (each[n // 2 - 1] + each[n // 2]) / 2
    return per.select("batch", "truth", middle.alias("estimate"))


def bottom_k(stream: DataFrame, k: int, a: int = 1103515245, b: int = 12345, p: int = 2147483647) -> DataFrame:
    """A uniform sample of k rows that doesn't depend on the order of arrival: the k least hash priorities of seq."""
    return stream.withColumn("priority", (F.col("seq") % p * a + b) % p).orderBy("priority", "seq").limit(k)


def reservoir_snapshots(stream: DataFrame, k: int = 100, slots: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    """(batch, slot, x) after each batch of algorithm R with hashed choices: the n-th row enters with probability k / n and takes
    a uniform slot. A slot holds the last row that took it, which is a running maximum; no state is carried row by row."""
    n = F.col("seq") + 1
    u = F.pmod(F.xxhash64("seq", F.lit(553)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    slot = F.when(n <= k, F.col("seq")).when(u < k / n, F.pmod(F.xxhash64("seq", F.lit(554)), F.lit(k)))
    taken = stream.withColumn("slot", slot).where(F.col("slot").isin(*slots))
    last = taken.groupBy("slot", "batch").agg(F.max_by("x", "seq").alias("x"))
    grid = stream.select("batch").distinct().join(F.broadcast(stream.sparkSession.createDataFrame([(s,) for s in slots], "slot long")))
    w = Window.partitionBy("slot").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(last, ["slot", "batch"], "left").select("batch", "slot", F.last("x", ignorenulls=True).over(w).alias("x"))
