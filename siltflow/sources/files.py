"""Readers and writers: explicit schemas, invalid rows dropped, results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the retail transaction export.
RETAIL = "TRANSACTION_DT STRING, CUSTOMER_ID STRING, AGE_GROUP STRING, PIN_CODE STRING, PRODUCT_SUBCLASS STRING, PRODUCT_ID STRING, AMOUNT STRING, ASSET STRING, SALES_PRICE STRING"
RATINGS = "user_id STRING, business_id STRING, stars DOUBLE"
REVIEWS = "review_id STRING, user_id STRING, business_id STRING, stars DOUBLE, date STRING, text STRING, useful LONG, funny LONG, cool LONG"
BUSINESSES = "business_id STRING, city STRING, stars DOUBLE, review_count LONG, attributes STRUCT<RestaurantsPriceRange2: STRING, RestaurantsReservations: STRING, RestaurantsTakeOut: STRING>"
USERS = "user_id STRING, review_count LONG, average_stars DOUBLE, fans LONG, yelping_since STRING, elite STRING, useful LONG, funny LONG, cool LONG"
CHECKINS = "business_id STRING, time MAP<STRING, LONG>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of newline-delimited JSON; lines that don't parse are dropped."""
    df = spark.read.schema(f"{schema}, _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.where("_corrupt IS NULL").drop("_corrupt")


def csv_rows(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    """Typed rows of a CSV file; rows that don't fit the schema are dropped."""
    return spark.read.schema(schema).options(header=header, sep=sep, mode="DROPMALFORMED").csv(path)


def retail_baskets(spark: SparkSession, path: str) -> DataFrame:
    """(basket, item) of the quoted retail export: basket is the date, with a two-figure year, and the customer's number; numbers
    lose leading zeros. Rows without a full date or with numbers that aren't are dropped."""
    return retail_pairs(spark.read.schema(RETAIL).options(header=True, quote='"').csv(path))


def retail_pairs(df: DataFrame) -> DataFrame:
    p = F.split(F.trim("TRANSACTION_DT"), "/")
    day = F.concat_ws("/", p[0], p[1], F.substring(p[2], 3, 10))
    customer, product = (F.trim(c).try_cast("bigint") for c in ("CUSTOMER_ID", "PRODUCT_ID"))
    rows = df.where(F.size(p) == 3).select(F.concat_ws("-", day, customer.cast("string")).alias("basket"), product.alias("item"), customer.alias("c"))
    return rows.where("c IS NOT NULL AND item IS NOT NULL").drop("c")


def check_in_totals(check_ins: DataFrame) -> DataFrame:
    """(business_id, n): the sum of a map's values."""
    return check_ins.select("business_id", F.aggregate(F.map_values("time"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one file of JSON objects."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Rows with a header; one file only for results known to be small."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def edge_lines(values: DataFrame) -> DataFrame:
    """Lines such as ('1', '2'), 3.5 for (src, dst, value)."""
    return values.select(F.format_string("('%s', '%s'), %s", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("value").cast("string")).alias("value"))


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df as a catalog table bucketed and sorted by a key, so that later joins and groupings on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)
