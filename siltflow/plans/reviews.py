"""Review analytics: counts, distinct counts, top keys and averages over the order tables.

An order with its lines plays the review: o_custkey is the user, l_partkey the business, o_orderdate the date.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siltflow.operators.analytics import top_counts, word_counts
from siltflow.registry import query
from siltflow.tables import load


@query(
    "review_stats",
    """SELECT CAST(count(*) AS BIGINT) AS n_review,
  CAST(count(*) FILTER (WHERE year(o_orderdate) = 1998) AS BIGINT) AS n_review_year,
  CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_user,
  CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_business
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def review_stats(spark, sf_dir):
    reviews = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return reviews.agg(
        F.count("*").alias("n_review"),
        F.count_if(F.year("o_orderdate") == 1998).alias("n_review_year"),
        F.count_distinct("o_custkey").alias("n_user"),
        F.count_distinct("l_partkey").alias("n_business"),
    )


@query("top_users", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_orders FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_users(spark, sf_dir):
    return top_counts(load(spark, sf_dir, "orders"), "o_custkey", 10, "n_orders")


@query("top_items", "SELECT l_partkey, CAST(count(*) AS BIGINT) AS n_reviews FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_items(spark, sf_dir):
    return top_counts(load(spark, sf_dir, "lineitem"), "l_partkey", 10, "n_reviews")


@query(
    "distinct_counts",
    "SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(count(DISTINCT event_type) AS BIGINT) AS types, CAST(count(DISTINCT (user_id, event_type)) AS BIGINT) AS pairs FROM events",
)
def distinct_counts(spark, sf_dir):
    return load(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"), F.count_distinct("user_id", "event_type").alias("pairs"))


@query(
    "avg_by_nation",
    """SELECT n_name, round(avg(l_quantity), 6) AS stars FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1""",
)
def avg_by_nation(spark, sf_dir):
    stars = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    place = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return stars.join(place, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_name").agg(F.round(F.avg("l_quantity"), 6).alias("stars")).orderBy(F.desc("stars"), "n_name")


@query(
    "avg_top10",
    """SELECT n_name, round(avg(l_quantity), 6) AS stars FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def avg_top10(spark, sf_dir):
    """Sorted, then limited: Spark keeps ten rows per task and merges them."""
    return avg_by_nation(spark, sf_dir).limit(10)


@query("word_count", "SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1")
def word_count(spark, sf_dir):
    return word_counts(load(spark, sf_dir, "documents"), "text")


@query(
    "words_in_text",
    "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents",
)
def words_in_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("long").alias("words"))


@query("partition_sizes")
def partition_sizes(spark, sf_dir):
    """Rows per partition after hash partitioning; the placement is the engine's, so no SQL twin."""
    return load(spark, sf_dir, "orders").repartition(8, "o_custkey").groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))
