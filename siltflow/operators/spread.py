"""Partition counts that follow the rows a step makes, so that a task's memory doesn't grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task makes of a join, and holds in an aggregation.
PER_TASK = 1_000_000


def parts(rows: float | None, per_task: int = PER_TASK) -> int:
    """How many partitions make about `per_task` rows each."""
    return max(1, -(-int(rows or 0) // per_task))


def pairs_within(rows: DataFrame, key: str, member: str, values: tuple[str, ...] = (), asked: DataFrame | None = None, per_task: int = PER_TASK) -> tuple[DataFrame, int]:
    """Pairs (a, b) of members a < b of the same key, a row for each key they share, from distinct rows; and in how many
    partitions they are, by a. Each value v is a_v and b_v. Asked pairs (a, b), a <= b, are among the rows, with null values;
    with them, members are pairs with themselves too.

    A task makes about `per_task` pairs: what is dealt out is a member with a list of larger ones, and a key with more pairs has
    several shorter lists, each of which meets all of its members.
    """
    r = rows.select(F.col(key).alias("k"), F.col(member).alias("b"), *[F.col(v).alias(f"b_{v}") for v in values])
    sizes = r.groupBy("k").agg(F.count("*").cast("double").alias("f"))
    pieces = F.ceil(F.col("f") * F.col("f") / (2 * per_task)).cast("int")
    total, most, met = sizes.agg(F.sum(F.col("f") * F.col("f")), F.max("f"), F.sum(F.col("f") * pieces)).first()
    # lists are passed on and not held, so that fewer tasks make them: larger blocks pack better
    n, n_lists = parts((total or 0) / 2, per_task), parts(met, max(1, per_task // 8))
    own = [F.col("b").alias("a"), *[F.col(f"b_{v}").alias(f"a_{v}") for v in values]]
    x = r.select("k", *own)
    if most is not None and most * most > 2 * per_task:
        r = r.join(sizes.select("k", pieces.alias("s")), "k")
        x = r.select("k", *own, F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("t"))
        r, on = r.withColumn("t", F.pmod(F.xxhash64("b"), F.col("s")).cast("int")).drop("s"), ["k", "t"]
    else:
        on = ["k"]
    theirs = ["b", *[f"b_{v}" for v in values]]
    lists = r.repartition(n_lists, *on).groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(*theirs))).alias("l"))
    larger = (lambda e: e["b"] > F.col("a")) if asked is None else (lambda e: e["b"] >= F.col("a"))
    met = x.repartition(n_lists, *on).join(lists, on).withColumn("l", F.filter("l", larger)).where(F.size("l") > 0)
    met = met.select("a", *[f"a_{v}" for v in values], *[F.col(f"l.{c}").alias(c) for c in theirs])
    if asked is not None:
        met = met.unionByName(asked.groupBy("a").agg(F.collect_set("b").alias("b")), allowMissingColumns=True)
    out = met.repartition(n, "a").withColumnRenamed("b", "l").select("*", F.posexplode("l").alias("at", "b"))
    return out.select("a", *[f"a_{v}" for v in values], "b", *[F.get(f"b_{v}", "at").alias(f"b_{v}") for v in values]), n
