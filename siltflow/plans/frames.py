"""DataFrame methods that read statistics, samples, views, hints and rows, each beside its SQL."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.registry import query
from siltflow.tables import load


@query(
    "frame_describe",
    """SELECT 'count' AS summary, CAST(count(p_size) AS DOUBLE) AS size, CAST(count(p_retailprice) AS DOUBLE) AS price FROM part
UNION ALL SELECT 'mean', round(avg(p_size), 6), round(avg(p_retailprice), 6) FROM part UNION ALL SELECT 'stddev', round(stddev_samp(p_size), 6), round(stddev_samp(p_retailprice), 6) FROM part
UNION ALL SELECT 'min', min(p_size), min(p_retailprice) FROM part UNION ALL SELECT 'max', max(p_size), max(p_retailprice) FROM part""",
)
def frame_describe(spark, sf_dir):
    d = load(spark, sf_dir, "part").describe("p_size", "p_retailprice")
    return d.select("summary", F.round(F.col("p_size").cast("double"), 6).alias("size"), F.round(F.col("p_retailprice").cast("double"), 6).alias("price"))


@query("frame_quantiles", " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, CAST(quantile_disc(p_retailprice, {q}) AS DOUBLE) AS x FROM part" for q in (0.25, 0.5, 0.9)))
def frame_quantiles(spark, sf_dir):
    """Exact ones: a relative error of 0."""
    qs = [0.25, 0.5, 0.9]
    return spark.createDataFrame(list(zip(qs, load(spark, sf_dir, "part").approxQuantile("p_retailprice", qs, 0.0), strict=True)), "q double, x double")


@query("frame_percentile", "SELECT o_orderpriority, CAST(quantile_disc(o_totalprice, 0.5) AS DOUBLE) AS mid FROM orders GROUP BY 1")
def frame_percentile(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.percentile_approx("o_totalprice", 0.5, 10_000_000).alias("mid"))


@query("frame_cov_corr", "SELECT round(covar_samp(l_quantity, l_extendedprice), 3) AS cov, round(corr(l_quantity, l_extendedprice), 9) AS corr FROM lineitem")
def frame_cov_corr(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return spark.createDataFrame([(round(li.stat.cov("l_quantity", "l_extendedprice"), 3), round(li.stat.corr("l_quantity", "l_extendedprice"), 9))], "cov double, corr double")


@query("frame_freq_items", "SELECT p_size AS size, n FROM (SELECT p_size, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1) WHERE n >= 0.02 * (SELECT count(*) FROM part)")
def frame_freq_items(spark, sf_dir):
    """freqItems misses no frequent item but has others, which an exact count drops."""
    p = load(spark, sf_dir, "part")
    found = p.freqItems(["p_size"], 0.02).select(F.explode("p_size_freqItems").alias("size"))
    n = p.groupBy(F.col("p_size").alias("size")).agg(F.count("*").alias("n"))
    return n.join(found, "size", "left_semi").where(F.col("n") >= 0.02 * p.count())


@query("frame_sample_by", "SELECT event_id FROM events WHERE event_type IN (SELECT min(event_type) FROM events)")
def frame_sample_by(spark, sf_dir):
    """A stratum is kept whole, the others not at all."""
    e = load(spark, sf_dir, "events")
    return e.sampleBy("event_type", {e.agg(F.min("event_type")).first()[0]: 1.0}, seed=3).select("event_id")


@query("frame_sample", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS different, true AS near FROM events")
def frame_sample(spark, sf_dir):
    """A whole sample holds each row once; one of a tenth has about a tenth of the rows and only such as the table has."""
    e = load(spark, sf_dir, "events").select("event_id")
    whole, tenth = e.sample(1.0, seed=5), e.sample(False, 0.1, seed=5)
    n = e.count()
    k = tenth.join(e, "event_id", "left_semi").count()
    return whole.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("different")).withColumn("near", F.lit(abs(k - 0.1 * n) < 6 * (0.09 * n) ** 0.5))


@query("frame_random_split", "SELECT o_orderkey FROM orders")
def frame_random_split(spark, sf_dir):
    """The parts are disjoint and make up the table."""
    parts = load(spark, sf_dir, "orders").select("o_orderkey").randomSplit([0.6, 0.3, 0.1], seed=11)
    return reduce(DataFrame.unionAll, parts)


@query("frame_sort_within", "SELECT s_nationkey, s_suppkey FROM supplier")
def frame_sort_within(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey").repartition(3, "s_nationkey").sortWithinPartitions("s_nationkey", F.desc("s_suppkey"))


@query("frame_head_tail", "SELECT 'head' AS place, n_nationkey FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'tail', n_nationkey FROM nation WHERE n_nationkey > 22 UNION ALL SELECT 'take', 0 UNION ALL SELECT 'first', 0")
def frame_head_tail(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select("n_nationkey").sort("n_nationkey")
    rows = [("head", r[0]) for r in n.head(3)] + [("tail", r[0]) for r in n.tail(2)] + [("take", n.take(1)[0][0]), ("first", n.first()[0])]
    return spark.createDataFrame(rows, "place string, n_nationkey int")


@query("frame_local_iterator", "SELECT r_regionkey, r_name FROM region")
def frame_local_iterator(spark, sf_dir):
    r = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return spark.createDataFrame(list(r.toLocalIterator(prefetchPartitions=True)), r.schema)


@query("frame_foreach", "SELECT CAST(sum(s_suppkey) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM supplier")
def frame_foreach(spark, sf_dir):
    """Accumulators filled row by row and partition by partition."""
    total, n = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    s = load(spark, sf_dir, "supplier").select("s_suppkey")
    s.foreach(lambda r: total.add(r[0]))
    s.foreachPartition(lambda rows: n.add(sum(1 for _ in rows)))
    return spark.createDataFrame([(total.value, n.value)], "total long, n long")


@query("frame_hints", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def frame_hints(spark, sf_dir):
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    return n.hint("merge").join(r, F.col("n_regionkey") == F.col("r_regionkey")).hint("rebalance").select("n_name", "r_name")


@query("frame_views", "SELECT r_name, CAST(count(*) AS BIGINT) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def frame_views(spark, sf_dir):
    """A temporary and a global view, joined by SQL and dropped; the plan keeps what they stood for."""
    load(spark, sf_dir, "nation").createOrReplaceTempView("frame_nation")
    load(spark, sf_dir, "region").createOrReplaceGlobalTempView("frame_region")
    out = spark.sql("SELECT r_name, count(*) AS n FROM frame_nation JOIN global_temp.frame_region ON n_regionkey = r_regionkey GROUP BY r_name")
    spark.catalog.dropTempView("frame_nation")
    spark.catalog.dropGlobalTempView("frame_region")
    return out


@query("frame_schema", "SELECT * FROM (VALUES ('n_name', 'string', false), ('n_nationkey', 'int', false), ('n_regionkey', 'int', false)) t(name, kind, streaming)")
def frame_schema(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    if [f.name for f in n.schema.fields] != n.columns:
        raise ValueError("schema and columns differ")
    return spark.createDataFrame([(c, k, n.isStreaming) for c, k in n.dtypes], "name string, kind string, streaming boolean")


@query("frame_col_regex", "SELECT p_size, p_brand FROM part")
def frame_col_regex(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select(p.colRegex("`p_(size|brand)`")).select("p_size", "p_brand")


@query("frame_json", "SELECT r_regionkey AS k, r_name AS name FROM region")
def frame_json(spark, sf_dir):
    """Rows as JSON text, through the JSON reader again."""
    lines = load(spark, sf_dir, "region").select(F.to_json(F.struct(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))).alias("j"))
    return lines.select(F.from_json("j", "k int, name string").alias("x")).select("x.*")


@query("frame_reshape", "SELECT l_orderkey, l_linenumber, 'q' AS what, l_quantity AS x FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 't', l_tax FROM lineitem")
def frame_reshape(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax").toDF("l_orderkey", "l_linenumber", "q", "t")
    return li.unpivot(["l_orderkey", "l_linenumber"], ["q", "t"], "what", "x")


@query("frame_persist", "SELECT CAST(count(*) AS BIGINT) AS n, true AS was_kept, true AS is_free FROM orders")
def frame_persist(spark, sf_dir):
    """Kept in memory and on disk while two results are read, then freed."""
    o = load(spark, sf_dir, "orders").select("o_orderkey").persist(StorageLevel.MEMORY_AND_DISK)
    kept, n = o.storageLevel.useMemory and o.is_cached, o.count()
    o.unpersist(blocking=True)
    return spark.createDataFrame([(n, kept, not o.is_cached)], "n long, was_kept boolean, is_free boolean")


@query("frame_null_order", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY x ASC NULLS FIRST, s_suppkey) AS INTEGER) AS a, CAST(row_number() OVER (ORDER BY x ASC NULLS LAST, s_suppkey) AS INTEGER) AS b, CAST(row_number() OVER (ORDER BY x DESC NULLS LAST, s_suppkey) AS INTEGER) AS c, CAST(row_number() OVER (ORDER BY x DESC NULLS FIRST, s_suppkey) AS INTEGER) AS d FROM (SELECT s_suppkey, CASE WHEN s_nationkey > 3 THEN s_nationkey END AS x FROM supplier)")
def frame_null_order(spark, sf_dir):
    from pyspark.sql import Window

    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") > 3, F.col("s_nationkey")).alias("x"))
    orders = {"a": F.asc_nulls_first("x"), "b": F.asc_nulls_last("x"), "c": F.desc_nulls_last("x"), "d": F.desc_nulls_first("x")}
    return s.select("s_suppkey", *[F.row_number().over(Window.orderBy(o, "s_suppkey")).alias(k) for k, o in orders.items()])


@query("frame_intersect_all", "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT s_nationkey FROM supplier")
def frame_intersect_all(spark, sf_dir):
    return load(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")).intersectAll(load(spark, sf_dir, "supplier").select("s_nationkey"))


@query("frame_skewed_group", "SELECT o_orderstatus AS k, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def frame_skewed_group(spark, sf_dir):
    """A few hot keys, grouped in two steps: by key and salt, then by key."""
    o = load(spark, sf_dir, "orders").withColumn("salt", F.pmod(F.xxhash64("o_orderkey"), F.lit(32)))
    part = o.groupBy(F.col("o_orderstatus").alias("k"), "salt").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))
    return part.groupBy("k").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("frame_log_query", "SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY 1, 2")
def frame_log_query(spark, sf_dir):
    """Log lines as text, taken apart by a pattern, counted and their sizes added by key."""
    line = F.format_string('%d [%s] "%s"', "user_id", "event_type", "props")
    logs = load(spark, sf_dir, "events").select(line.alias("line"))
    part = [F.regexp_extract("line", r'^(\d+) \[([^\]]*)\] "(.*)"$', i) for i in (1, 2, 3)]
    rows = logs.select(part[0].cast("long").alias("user_id"), part[1].alias("event_type"), F.length(part[2]).alias("size"))
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("frame_tree_aggregate", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total, CAST(max(l_linenumber) AS INTEGER) AS most, CAST(min(l_linenumber) AS INTEGER) AS least FROM lineitem")
def frame_tree_aggregate(spark, sf_dir):
    """fold, reduce and treeAggregate over key-value rows as one aggregation with partial sums."""
    li = load(spark, sf_dir, "lineitem")
    return li.agg(F.sum("l_linenumber").alias("total"), F.max("l_linenumber").alias("most"), F.min("l_linenumber").alias("least"))


@query("frame_cogroup", "SELECT k, CAST(sum(o) AS BIGINT) AS orders, CAST(sum(s) AS BIGINT) AS suppliers FROM (SELECT c_nationkey AS k, 1 AS o, 0 AS s FROM customer UNION ALL SELECT s_nationkey, 0, 1 FROM supplier) GROUP BY 1")
def frame_cogroup(spark, sf_dir):
    """Two keyed tables grouped together by a tagged union: one shuffle, no list of a key's rows."""
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("o"), F.lit(0).alias("s"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(0).alias("o"), F.lit(1).alias("s"))
    return c.unionByName(s).groupBy("k").agg(F.sum("o").alias("orders"), F.sum("s").alias("suppliers"))


@query("frame_bitmap_count", "SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS n FROM events")
def frame_bitmap_count(spark, sf_dir):
    """Exact distinct integers by bitmaps: one per bucket of 32768, of which only the counts are added."""
    e = load(spark, sf_dir, "events").select(F.bitmap_bucket_number("user_id").alias("b"), F.bitmap_bit_position("user_id").alias("p"))
    return e.groupBy("b").agg(F.bitmap_count(F.bitmap_construct_agg("p")).alias("n")).agg(F.sum("n").alias("n"))


@query("frame_chained", "SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE l_tax > 0.02 AND l_tax < 0.06 AND l_discount <> 0.05 GROUP BY 1")
def frame_chained(spark, sf_dir):
    """Conditions combined by reduce, applied through transform()."""
    conditions = [F.col("l_tax") > 0.02, F.col("l_tax") < 0.06, F.col("l_discount") != 0.05]
    li = load(spark, sf_dir, "lineitem").transform(lambda d: d.where(reduce(operator.and_, conditions)))
    return li.groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("lines"))
