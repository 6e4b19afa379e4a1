"""Connected components: in one task while the links are few, by alternating stars beyond that; linear in the links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links of which one task finds the components; some tens of megabytes.
FEW = 200_000


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) by union and find over links (u, v)."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = above[x]
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pd.DataFrame({"node": nodes, "root": [root(x) for x in nodes]}, dtype="int64")


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) with root the smallest node reachable over links (a, b), for nodes that have a link to another one.

    At most `few` links are united by one task. More go round by round: every node's larger neighbours are pointed at its
    smallest one (large star), then every node and its smaller neighbours at their smallest (small star), until nothing
    changes: a logarithmic number of rounds. Minima are aggregated before the shuffle and no neighbour list is ever collected,
    so a hub of any degree is spread.
    """
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    if e.count() <= few:
        return e.coalesce(1).mapInPandas(_united, "node long, root long")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u > v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    leaves = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return leaves.unionByName(leaves.select("root").distinct().select(F.col("root").alias("node"), "root"))
