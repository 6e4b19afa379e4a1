"""Clustering by sufficient statistics: counts, sums and sums of squares per cluster."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltflow.operators.lineage import cut


def parse_points(lines: DataFrame, col: str = "value", sep: str = ",") -> DataFrame:
    """(v) of the lines whose every field is a number; other lines are dropped."""
    v = F.transform(F.split(col, sep), lambda x: F.trim(x).try_cast("double"))
    return lines.select(v.alias("v")).where(F.forall("v", lambda x: x.isNotNull()))


def statistics(points: DataFrame, dim: int) -> DataFrame:
    """(cluster, n, sum, sumsq) from (cluster, v): a sum per dimension, combined per task before the shuffle."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dim)]
    squares = [F.sum(F.col("v")[i] * F.col("v")[i]).alias(f"q{i}") for i in range(dim)]
    per = points.groupBy("cluster").agg(F.count("*").alias("n"), *sums, *squares)
    return per.select("cluster", "n", F.array(*[f"s{i}" for i in range(dim)]).alias("sum"), F.array(*[f"q{i}" for i in range(dim)]).alias("sumsq"))


def merge_statistics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Statistics of the union of clusters of the same name."""

    def added(x, y):
        return F.zip_with(x, y, lambda p, q: p + q)

    zero = F.transform(F.first("sum"), lambda _: F.lit(0.0))
    both = a.unionByName(b).groupBy("cluster").agg(F.sum("n").alias("n"), F.collect_list("sum").alias("ss"), F.collect_list("sumsq").alias("qq"), zero.alias("z"))
    return both.select("cluster", "n", F.aggregate("ss", F.col("z"), added).alias("sum"), F.aggregate("qq", F.col("z"), added).alias("sumsq"))


def mahalanobis(v: Column, n: Column, total: Column, squares: Column) -> Column:
    """sqrt of the sum of (x - mean)^2 / variance; dimensions without variance are left out."""
    parts = F.zip_with(F.zip_with(v, total, lambda x, s: x - s / n), F.zip_with(total, squares, lambda s, q: q / n - F.pow(s / n, 2)), lambda d, var: F.when(var > 1e-12, d * d / var).otherwise(0.0))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def assign(points: DataFrame, clusters: DataFrame, dim: int, factor: float = 2.0) -> DataFrame:
    """points (id, v) with the nearest cluster and its distance if that is under factor * sqrt(dim), ties to the smaller name,
    else null. The clusters are a few rows of statistics, broadcast; their number is a parameter of the method, not of the data."""
    far = factor * dim**0.5
    row = clusters.select(F.struct("cluster", "n", "sum", "sumsq").alias("c")).agg(F.array_sort(F.collect_list("c")).alias("cs"))
    each = points.join(F.broadcast(row)).withColumn("best", F.array_min(F.transform("cs", lambda c: F.struct(mahalanobis(F.col("v"), c["n"], c["sum"], c["sumsq"]).alias("d"), c["cluster"].alias("k")))))
    near = F.col("best")["d"] < far
    return each.select("id", "v", F.when(near, F.col("best")["k"]).alias("cluster"), F.when(near, F.col("best")["d"]).alias("distance"))


def kmeans(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(id, v, cluster) by k-means with parallel seeding."""
    x = points.withColumn("_x", array_to_vector("v"))
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster", maxIter=10).fit(x)
    return model.transform(x).select("id", "v", "cluster")


def merge_close(clusters: DataFrame, dim: int, factor: float = 2.0) -> tuple[DataFrame, dict[int, int]]:
    """Clusters with those put together whose centroids are each under factor * sqrt(dim) from the other cluster, until none
    are, and the names that went with the names they went to. The clusters are a few rows of statistics, merged on the driver."""
    far = factor * dim**0.5
    rows = sorted(clusters.select("cluster", "n", "sum", "sumsq").collect())
    stats = {r["cluster"]: (r["n"], np.array(r["sum"]), np.array(r["sumsq"])) for r in rows}

    def close(a, b) -> bool:
        (ma, va), (mb, vb) = ((s / n, q / n - (s / n) ** 2) for n, s, q in (a, b))
        diff, fa, fb = ma - mb, va > 1e-12, vb > 1e-12
        if (np.abs(diff[~fa & ~fb]) > 1e-6).any():  # neither cluster says how far that is
            return False
        return all(np.sqrt((diff[f] ** 2 / v[f]).sum()) < far for f, v in ((fa, va), (fb, vb)))

    into: dict[int, int] = {}
    again = True
    while again:
        again = False
        for a in sorted(stats):
            for b in sorted(x for x in stats if x > a) if a in stats else ():
                if close(stats[a], stats[b]):
                    stats[a] = tuple(x + y for x, y in zip(stats[a], stats.pop(b), strict=True))
                    into = {k: a if v == b else v for k, v in into.items()} | {b: a}
                    again = True
    if not into:
        return clusters, into
    merged = [(c, int(n), s.tolist(), q.tolist()) for c, (n, s, q) in stats.items()]
    return clusters.sparkSession.createDataFrame(merged, "cluster int, n long, sum array<double>, sumsq array<double>"), into


def run(points: DataFrame, k: int, dim: int, rounds: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Cluster (id, v) in chunks, keeping only statistics of settled points. Returns (id, cluster), null for outliers, and the
    report (round, ds_points, cs_clusters, cs_points, rs_points).

    Round 1 clusters its chunk with 5k centres, sets points of clusters of one aside and makes k main clusters (DS) of the rest.
    Later rounds assign points to DS, then to side clusters (CS), then set them aside (RS), and make CS of what RS holds; then CS that
    lie close to each other are merged. In the end each CS within the distance of a DS joins it.
    """
    spark = points.sparkSession
    chunked = cut(points.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(rounds)).cast("int")))
    first = chunked.where("chunk = 0").select("id", "v")
    rough = cut(kmeans(first, 5 * k, seed))
    alone = rough.groupBy("cluster").agg(F.count("*").alias("n")).where("n = 1").select("cluster")
    settled = cut(kmeans(rough.join(alone, "cluster", "left_anti").select("id", "v"), k, seed))
    ds = cut(statistics(settled, dim))
    out = settled.select("id", F.concat(F.lit("d"), "cluster").alias("cluster"))
    rs = cut(rough.join(alone, "cluster", "left_semi").select("id", "v"))
    cs, cs_members, report = None, None, []
    for i in range(1, rounds + 1):
        if i > 1:
            got = cut(assign(chunked.where(F.col("chunk") == i - 1).select("id", "v"), ds, dim))
            hit = got.where("cluster IS NOT NULL").select("cluster", "v", "id")
            ds = cut(merge_statistics(ds, statistics(hit, dim)))
            out = out.unionByName(hit.select("id", F.concat(F.lit("d"), "cluster").alias("cluster")))
            rest = got.where("cluster IS NULL").select("id", "v")
            if cs is not None:
                got = cut(assign(rest, cs, dim))
                hit = got.where("cluster IS NOT NULL")
                cs = cut(merge_statistics(cs, statistics(hit.select("cluster", "v"), dim)))
                cs_members = cs_members.unionByName(hit.select("id", "cluster"))
                rest = got.where("cluster IS NULL").select("id", "v")
            rs = cut(rs.unionByName(rest))
        if rs.count() > 5 * k:
            tight = cut(kmeans(rs, 5 * k, seed))
            big = tight.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
            own = tight.join(big, "cluster", "left_semi").withColumn("cluster", F.col("cluster") + i * 1000)
            new = statistics(own.select("cluster", "v"), dim)
            cs = cut(new if cs is None else cs.unionByName(new))
            members = own.select("id", "cluster")
            cs_members = members if cs_members is None else cs_members.unionByName(members)
            rs = cut(tight.join(big, "cluster", "left_anti").select("id", "v"))
        if cs is not None:
            cs, into = merge_close(cs, dim)
            if into:
                names = F.broadcast(spark.createDataFrame(list(into.items()), "cluster int, into int"))
                cs_members = cut(cs_members.join(names, "cluster", "left").select("id", F.coalesce("into", "cluster").alias("cluster")))
        sizes = cs.agg(F.count("*"), F.sum("n")).first() if cs is not None else (0, 0)
        report.append((i, ds.agg(F.sum("n")).first()[0], sizes[0], int(sizes[1] or 0), rs.count()))
    if cs is not None:
        centre = cs.select(F.col("cluster").alias("id"), F.transform("sum", lambda s: s / F.col("n")).alias("v"))
        joined = assign(centre, ds, dim).select(F.col("id").alias("cluster"), F.col("cluster").alias("main"))
        name = F.when(F.col("main").isNotNull(), F.concat(F.lit("d"), "main")).otherwise(F.concat(F.lit("c"), "cluster"))
        out = out.unionByName(cs_members.join(joined, "cluster").select("id", name.alias("cluster")))
    out = out.unionByName(rs.select("id", F.lit(None).cast("string").alias("cluster")))
    return out, spark.createDataFrame(report, "round int, ds_points long, cs_clusters long, cs_points long, rs_points long")
