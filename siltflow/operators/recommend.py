"""Collaborative filtering and rating features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltflow.operators.spread import PER_TASK, pairs_within


def ratings_of(df: DataFrame, user: str, item: str, rating: Column) -> DataFrame:
    """(user, item, rating): repeated pairs take their mean, so the result doesn't depend on the order of rows."""
    return df.groupBy(F.col(user).alias("user"), F.col(item).alias("item")).agg(F.avg(rating).alias("rating"))


def item_similarity(ratings: DataFrame, pairs: DataFrame | None = None, least_common: int = 2, digits: int = 8) -> DataFrame:
    """(i, j, sim) by Pearson's correlation over the users who rated both items.

    With fewer than `least_common` common users the similarity is (5 - |mean_i - mean_j|) / 5; where a deviation is zero it is
    0. For the given pairs, each as i <= j, or else for the pairs i < j with a common user. Sums are aggregated per pair, no
    vectors. Ratings aren't null.
    """
    mean = ratings.groupBy("item").agg(F.avg("rating").alias("m"))
    if pairs is None:
        # nearly all pairs are in the result: means go along with the ratings
        both, _ = pairs_within(ratings.join(mean, "item"), "user", "item", ("rating", "m"), per_task=PER_TASK)
        means = [F.first("a_m").alias("mi"), F.first("b_m").alias("mj")]
    else:
        both, _ = pairs_within(ratings, "user", "item", ("rating",), pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")), PER_TASK)
        means = [F.count_if(F.col("a_rating").isNull()).alias("asked")]
    x, y = F.col("a_rating"), F.col("b_rating")
    s = both.groupBy(F.col("a").alias("i"), F.col("b").alias("j")).agg(
        F.count(x).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), *means
    )
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy)
    flat = (vx <= 1e-9) | (vy <= 1e-9)
    known = F.when(F.col("n") >= least_common, F.when(flat, 0.0).otherwise(r))
    if pairs is not None:
        s = s.where("asked > 0").select("i", "j", known.alias("r"))
        s = s.join(mean.select(F.col("item").alias("i"), F.col("m").alias("mi")), "i").join(mean.select(F.col("item").alias("j"), F.col("m").alias("mj")), "j")
        known = F.col("r")
    return s.select("i", "j", F.round(F.coalesce(known, (5 - F.abs(F.col("mi") - F.col("mj"))) / 5), digits).alias("sim"))


def predict(ratings: DataFrame, asked: DataFrame, variant: int = 1, neighbours: int = 15, fallback: float = 2.5) -> DataFrame:
    """(user, item, prediction) from the user's `neighbours` most similar rated items, ties to the smaller item.

    Variant 1 keeps positive similarities and falls back to the item's mean; an unknown item gets the user's mean, an unknown
    user `fallback`. Variant 2 keeps all, and falls back to `fallback` throughout. Variant 3 is 2 without the asked item itself.
    """
    asked = asked.select("user", "item").distinct()
    rated = ratings.select("user", F.col("item").alias("j"), "rating")
    known = asked.join(ratings.select("item").distinct(), "item", "left_semi").join(rated, "user")
    if variant == 3:
        known = known.where("item <> j")
    sims = item_similarity(ratings, known.select(F.col("item").alias("i"), "j"))
    near = known.join(sims.select(F.col("i").alias("lo"), F.col("j").alias("hi"), "sim"), (F.least("item", "j") == F.col("lo")) & (F.greatest("item", "j") == F.col("hi"))).drop("lo", "hi")
    if variant == 1:
        near = near.where("sim > 0")
    top = near.withColumn("rn", F.row_number().over(Window.partitionBy("user", "item").orderBy(F.desc("sim"), "j"))).where(F.col("rn") <= neighbours)
    scored = top.groupBy("user", "item").agg(F.sum(F.col("sim") * F.col("rating")).alias("num"), F.sum(F.abs("sim")).alias("den"))
    cf = F.when(F.col("den") > 0, F.col("num") / F.col("den"))
    out = asked.join(scored, ["user", "item"], "left")
    if variant != 1:
        return out.select("user", "item", F.coalesce(cf, F.lit(fallback)).alias("prediction"))
    user_mean = ratings.groupBy("user").agg(F.avg("rating").alias("um"))
    item_mean = ratings.groupBy("item").agg(F.avg("rating").alias("im"))
    out = out.join(user_mean, "user", "left").join(item_mean, "item", "left")
    ladder = F.when(F.col("um").isNull(), F.lit(fallback)).when(F.col("im").isNull(), F.col("um")).otherwise(F.coalesce(cf, F.col("im")))
    return out.select("user", "item", ladder.alias("prediction"))


def join_features(rows: DataFrame, user_features: DataFrame, item_features: DataFrame, defaults: dict[str, float | None]) -> DataFrame:
    """Rows (user, item, ...) with the features of both; missing ones take named defaults, None staying null."""
    out = rows.join(user_features, "user", "left").join(item_features, "item", "left")
    return out.fillna({k: v for k, v in defaults.items() if v is not None})


def hybrid(cf: DataFrame, model: DataFrame, alpha: float = 0.1) -> DataFrame:
    """alpha * collaborative + (1 - alpha) * model, joined on (user, item), never by position."""
    a = cf.select("user", "item", F.col("prediction").alias("pc"))
    b = model.select("user", "item", F.col("prediction").alias("pm"))
    return a.join(b, ["user", "item"]).select("user", "item", (alpha * F.col("pc") + (1 - alpha) * F.col("pm")).alias("prediction"))


def check_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """df, whose evaluation fails with an error on a null, NaN or infinite feature; an empty frame fails here."""
    if df.isEmpty():
        raise ValueError("no rows")
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))
    return df.where(F.when(bad, F.raise_error(F.lit("a feature is null, NaN or infinite")).cast("boolean")).otherwise(True))


def boosted_trees(train: DataFrame, test: DataFrame, features: list[str], label: str = "rating", rate: float = 0.1, depth: int = 5, trees: int = 20, seed: int = 42) -> DataFrame:
    """test with a prediction of Spark's gradient-boosted trees."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    vector = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    model = GBTRegressor(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed).fit(vector.transform(train))
    return model.transform(vector.transform(test)).drop("_x")


def factorise(train: DataFrame, asked: DataFrame, rank: int = 8, rounds: int = 5, reg: float = 0.1, seed: int = 42) -> DataFrame:
    """asked with a prediction of alternating least squares; cold rows are dropped."""
    from pyspark.ml.recommendation import ALS

    als = ALS(rank=rank, maxIter=rounds, regParam=reg, seed=seed, userCol="user", itemCol="item", ratingCol="rating", coldStartStrategy="drop")
    return als.fit(train.select(F.col("user").cast("int"), F.col("item").cast("int"), "rating")).transform(asked.select(F.col("user").cast("int"), F.col("item").cast("int")))
