"""Relational coverage: joins, grouping, windows, set operations, SQL forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltflow.operators.joins import as_of_join, left_with_default, range_join
from siltflow.operators.spread import parts
from siltflow.registry import query
from siltflow.tables import load


def _t(spark, sf_dir, *names):
    return [load(spark, sf_dir, n) for n in names]


# ---------------------------------------------------------------- joins
@query("join_inner", "SELECT o_orderkey, c_name, round(o_totalprice, 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_inner(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders", "customer")
    return o.join(c.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", F.round("o_totalprice", 2).alias("price"))


@query("join_left_default", "SELECT o_orderkey, CAST(coalesce(n, 0) AS BIGINT) AS n_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def join_left_default(spark, sf_dir):
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    n = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    return left_with_default(o.select("o_orderkey"), n, ["o_orderkey"], {"n_lines": 0})


@query("join_right", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM orders RIGHT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_right(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders", "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "right").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("join_full", "SELECT coalesce(s_nationkey, c_nationkey) AS nation, suppliers, customers FROM (SELECT s_nationkey, CAST(count(*) AS BIGINT) AS suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY 1) FULL JOIN (SELECT c_nationkey, CAST(count(*) AS BIGINT) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON s_nationkey = c_nationkey")
def join_full(spark, sf_dir):
    s, c = _t(spark, sf_dir, "supplier", "customer")
    a = s.where("s_acctbal > 0").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    b = c.where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return a.join(b, F.col("s_nationkey") == F.col("c_nationkey"), "full").select(F.coalesce("s_nationkey", "c_nationkey").alias("nation"), "suppliers", "customers")


@query("join_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def join_semi(spark, sf_dir):
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    return o.join(li.where("l_quantity > 49"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("join_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, sf_dir):
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    return o.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf_dir):
    """Five regions by 25 nations: both tables have a fixed size."""
    r, n = _t(spark, sf_dir, "region", "nation")
    return r.crossJoin(n).select("r_name", "n_name")


@query("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def join_self(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    return s.alias("a").join(s.alias("b"), F.expr("a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


_BANDS = "VALUES (0, 0.0, 100.5), (1, 100.5, 102.0), (2, 101.0, 105.0), (3, 950.0, 2000.0)"


@query("join_range", f"SELECT p_partkey, band FROM part JOIN ({_BANDS}) b(band, lo, hi) ON p_retailprice >= lo AND p_retailprice < hi")
def join_range(spark, sf_dir):
    bands = spark.sql(f"SELECT band, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM {_BANDS} AS b(band, lo, hi)")
    return range_join(load(spark, sf_dir, "part"), bands, "p_retailprice", "lo", "hi", width=50.0).select("p_partkey", "band")


@query(
    "join_asof",
    """SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type <> 'purchase') e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""",
)
def join_asof(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase_id"))
    return as_of_join(e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), right, "user_id", "ts", ["purchase_id"]).select("event_id", "purchase_id")


@query("join_composite", "SELECT l1.l_orderkey, l1.l_linenumber, round(l2.l_extendedprice, 2) AS price FROM lineitem l1 JOIN lineitem l2 ON l1.l_orderkey = l2.l_orderkey AND l1.l_linenumber = l2.l_linenumber WHERE l1.l_quantity > 45")
def join_composite(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.where("l_quantity > 45").select("l_orderkey", "l_linenumber").join(li.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price")), ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- grouping
_SUMS = "CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty"


def _sums():
    return [F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")]


@query(
    "agg_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def agg_pricing_summary(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("n"),
    )


@query("agg_rollup", f"SELECT l_returnflag, l_linestatus, CAST(grouping(l_linestatus) AS INTEGER) AS g, {_SUMS} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_linestatus").cast("int").alias("g"), *_sums())


@query("agg_cube", f"SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS g, {_SUMS} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id("l_returnflag", "l_linestatus").alias("g"), *_sums())


@query("agg_grouping_sets", f"SELECT l_returnflag, l_linestatus, {_SUMS} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def agg_grouping_sets(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(*_sums())


@query("agg_pivot", "SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY 1")
def agg_pivot(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum("l_quantity"), 2))


@query("agg_unpivot", "SELECT r_regionkey AS id, 'r_name' AS field, r_name AS value FROM region UNION ALL SELECT r_regionkey, 'upper', upper(r_name) FROM region")
def agg_unpivot(spark, sf_dir):
    r = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), "r_name", F.upper("r_name").alias("upper"))
    return r.unpivot("id", ["r_name", "upper"], "field", "value")


@query("agg_filter", "SELECT o_orderstatus, CAST(count(*) FILTER (WHERE o_totalprice > 100000) AS BIGINT) AS big, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def agg_filter(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 100000).alias("big"), F.count("*").alias("n"))


@query("agg_having", "SELECT l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 40")
def agg_having(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).where("n >= 40")


@query(
    "agg_stats",
    """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp,
  round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs,
  round(avg(pow(l_quantity - m, 3)) / pow(stddev_pop(l_quantity), 3), 6) AS skew, round(avg(pow(l_quantity - m, 4)) / pow(var_pop(l_quantity), 2) - 3, 6) AS kurt
FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY 1""",
)
def agg_stats(spark, sf_dir):
    q = "l_quantity"
    named = {"sd": F.stddev_samp(q), "sdp": F.stddev_pop(q), "v": F.var_samp(q), "vp": F.var_pop(q), "r": F.corr(q, "l_extendedprice"), "cp": F.covar_pop(q, "l_discount"), "cs": F.covar_samp(q, "l_discount"), "skew": F.skewness(q), "kurt": F.kurtosis(q)}
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.round(e, 6).alias(k) for k, e in named.items()])


@query("agg_percentile", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1")
def agg_percentile(spark, sf_dir):
    p = "o_totalprice"
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.percentile(p, F.lit(0.25)), 4).alias("q1"), F.round(F.median(p), 4).alias("med"), F.round(F.percentile(p, F.lit(0.9)), 4).alias("p90"))


@query("agg_collect", "SELECT n_regionkey, list_sort(list(n_name)) AS names, array_to_string(list_sort(list(DISTINCT n_nationkey % 3)), ',') AS mods FROM nation GROUP BY 1")
def agg_collect(spark, sf_dir):
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"), F.array_join(F.array_sort(F.collect_set(F.col("n_nationkey") % 3)), ",").alias("mods"))


@query("agg_min_max_by", "SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, c_custkey)) AS richest, arg_min(c_custkey, (c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY 1")
def agg_min_max_by(spark, sf_dir):
    order = F.struct("c_acctbal", "c_custkey")
    return load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", order).alias("richest"), F.min_by("c_custkey", order).alias("poorest"))


@query("agg_sum_distinct", "SELECT event_type, CAST(sum(DISTINCT user_id) AS BIGINT) AS users, bool_and(value > 0) AS all_pos, bool_or(value > 90) AS some_big FROM events GROUP BY 1")
def agg_sum_distinct(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.sum_distinct("user_id").alias("users"), F.bool_and(F.col("value") > 0).alias("all_pos"), F.bool_or(F.col("value") > 90).alias("some_big"))


@query("agg_crosstab", "SELECT o_orderstatus AS status, CAST(count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS BIGINT) AS urgent, CAST(count(*) FILTER (WHERE o_orderpriority NOT LIKE '1%') AS BIGINT) AS other FROM orders GROUP BY 1")
def agg_crosstab(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderstatus", F.when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("other").alias("p"))
    return o.crosstab("o_orderstatus", "p").select(F.col("o_orderstatus_p").alias("status"), "urgent", "other")


# ---------------------------------------------------------------- windows
def _by_cust():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(
    "win_rank",
    """SELECT p_partkey, row_number() OVER w AS rn, CAST(rank() OVER r AS BIGINT) AS rk, CAST(dense_rank() OVER r AS BIGINT) AS dr, round(percent_rank() OVER r, 6) AS pr, round(cume_dist() OVER r, 6) AS cd
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey), r AS (PARTITION BY p_brand ORDER BY p_size)""",
)
def win_rank(spark, sf_dir):
    r = Window.partitionBy("p_brand").orderBy("p_size")
    w = Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    return load(spark, sf_dir, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(r).cast("long").alias("rk"), F.dense_rank().over(r).cast("long").alias("dr"), F.round(F.percent_rank().over(r), 6).alias("pr"), F.round(F.cume_dist().over(r), 6).alias("cd"))


@query("win_lag_lead", f"SELECT o_orderkey, lag(o_orderkey) {_OVER} AS prev, lead(o_orderkey, 2, -1) {_OVER} AS next2 FROM orders")
def win_lag_lead(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(_by_cust()).alias("prev"), F.lead("o_orderkey", 2, -1).over(_by_cust()).alias("next2"))


@query("win_running", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean3 FROM orders")
def win_running(spark, sf_dir):
    p = "o_totalprice"
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum(p).over(_by_cust().rowsBetween(Window.unboundedPreceding, 0)), 2).alias("total"), F.round(F.avg(p).over(_by_cust().rowsBetween(-2, 0)), 4).alias("mean3"))


@query("win_range_frame", "SELECT p_partkey, CAST(count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS BIGINT) AS near FROM part")
def win_range_frame(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.count("*").over(Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5)).alias("near"))


@query("win_ntile", f"SELECT o_orderkey, CAST(ntile(4) {_OVER} AS INTEGER) AS tile FROM orders")
def win_ntile(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", F.ntile(4).over(_by_cust()).alias("tile"))


@query("win_first_last", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def win_first_last(spark, sf_dir):
    w = _by_cust().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return load(spark, sf_dir, "orders").select("o_orderkey", F.first("o_orderkey").over(w).alias("f"), F.last("o_orderkey").over(w).alias("l"), F.nth_value("o_orderkey", 2).over(w).alias("s"))


@query("win_top_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")
def win_top_per_group(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return load(spark, sf_dir, "customer").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("c_nationkey", "c_custkey")


# ---------------------------------------------------------------- set operations, null handling, ordering
_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_nationkey < 12"


def _sides(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")), s.where("s_nationkey < 12").select(F.col("s_nationkey").alias("k"))


def _set_query(name, sql, op):
    @query(name, f"{_A} {sql} {_B}")
    def run(spark, sf_dir):
        return op(*_sides(spark, sf_dir))


_set_query("set_union", "UNION", lambda a, b: a.union(b).distinct())
_set_query("set_union_all", "UNION ALL", lambda a, b: a.unionAll(b))
_set_query("set_intersect", "INTERSECT", lambda a, b: a.intersect(b))
_set_query("set_intersect_all", "INTERSECT ALL", lambda a, b: a.intersectAll(b))
_set_query("set_except", "EXCEPT", lambda a, b: a.subtract(b))
_set_query("set_except_all", "EXCEPT ALL", lambda a, b: a.exceptAll(b))


@query("set_union_by_name", "SELECT r_regionkey AS id, r_name AS name, NULL::VARCHAR AS extra FROM region UNION ALL SELECT n_nationkey, n_name, 'nation' FROM nation")
def set_union_by_name(spark, sf_dir):
    r, n = _t(spark, sf_dir, "region", "nation")
    right = n.select(F.lit("nation").alias("extra"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    return r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).unionByName(right, allowMissingColumns=True)


@query("drop_duplicates", "SELECT l_partkey, l_suppkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1, 2")
def drop_duplicates(spark, sf_dir):
    """One row for each pair. As nearly all pairs occur once, rows are dealt out before they are grouped, a million to a task."""
    li = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    return li.repartition(parts(li.count()), "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("first_order"))


@query("null_handling", "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS kind, CASE WHEN value > 50 THEN NULL ELSE round(value, 3) END AS small FROM events WHERE event_type IS NOT NULL")
def null_handling(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("kind"), F.when(F.col("value") <= 50, F.round("value", 3)).alias("small"), "event_type")
    return e.na.fill({"kind": "none"}).na.drop(subset=["event_type"]).select("event_id", "kind", "small")


@query("na_replace", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def na_replace(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").replace({"O": "open", "F": "done"}, subset=["o_orderstatus"])


@query("sort_nulls", "SELECT k, row_number() OVER (ORDER BY k DESC NULLS FIRST) AS rn FROM (SELECT DISTINCT nullif(n_regionkey, 2) AS k FROM nation)")
def sort_nulls(spark, sf_dir):
    d = load(spark, sf_dir, "nation").select(F.nullif("n_regionkey", F.lit(2)).alias("k")).distinct()
    return d.select("k", F.row_number().over(Window.orderBy(F.desc_nulls_first("k"))).cast("long").alias("rn"))


@query("with_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS index FROM orders")
def with_index_query(spark, sf_dir):
    from siltflow.operators.analytics import with_index

    return with_index(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "index")


@query("hash_chunks", None)
def hash_chunks(spark, sf_dir):
    from siltflow.operators.analytics import chunks

    return chunks(load(spark, sf_dir, "embeddings").select("vec_id"), 5, 42, "vec_id").groupBy("chunk").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- SQL as the second front end
_SQL = {
    "sql_cte": "WITH t AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey) SELECT n, CAST(count(*) AS BIGINT) AS users FROM t GROUP BY n",
    "sql_scalar_subquery": "SELECT o_orderkey FROM orders o WHERE o_totalprice > 1.8 * (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "sql_in_subquery": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')",
    "sql_lateral": "SELECT n_nationkey, t.k FROM nation, LATERAL (SELECT n_nationkey * 10 + 1 AS k) t",
    "sql_values": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, CAST(NULL AS STRING))) AS v(a, b)",
    "sql_case": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size FROM part",
    "sql_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t",
    "sql_shipping_priority": """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "sql_local_suppliers": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
}


def _sql_query(name, sql):
    @query(name, sql.replace("AS STRING", "AS VARCHAR"))
    def run(spark, sf_dir):
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
            load(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))


for _name, _text in _SQL.items():
    _sql_query(_name, _text)
