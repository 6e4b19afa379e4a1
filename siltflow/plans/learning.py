"""Machine-learning queries. Models have no SQL twin; transformers that are plain arithmetic do."""

from __future__ import annotations

from pyspark.ml import evaluation as E
from pyspark.ml import feature as X
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from siltflow.operators import learning as L
from siltflow.registry import query
from siltflow.tables import load


def _vectors(spark, sf_dir, two: bool = False):
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding"), (F.col("label") % 2 if two else F.col("label")).cast("double").alias("label"))
    return L.vectors(e, "embedding").drop("embedding")


def _rows(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount", "l_tax").alias("a"), (F.col("l_extendedprice") / 1000).alias("label"), F.lit(1.0).alias("censor"))
    return L.vectors(li, "a").drop("a")


def _classifier(name):
    @query(f"ml_classify_{name}")
    def run(spark, sf_dir):
        d = _vectors(spark, sf_dir, two=name != "one_vs_rest")
        return L.fit_predict(L.CLASSIFIERS[name](), d, d, ["vec_id"])


def _regressor(name):
    @query(f"ml_regress_{name}")
    def run(spark, sf_dir):
        d = _rows(spark, sf_dir)
        return L.fit_predict(L.REGRESSORS[name](), d, d, ["l_orderkey", "l_linenumber"])


def _clusterer(name):
    @query(f"ml_cluster_{name}")
    def run(spark, sf_dir):
        d = _vectors(spark, sf_dir)
        return L.fit_predict(L.CLUSTERERS[name](5), d, d, ["vec_id"])


def _vector_step(name):
    @query(f"ml_vector_{name}")
    def run(spark, sf_dir):
        return L.apply_step([L.VECTOR_STEPS[name]()], _vectors(spark, sf_dir), ["vec_id"])


def _text_step(name):
    @query(f"ml_text_{name}")
    def run(spark, sf_dir):
        return L.apply_step(L.TEXT_STEPS[name](), load(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])


for _make, _names in ((_classifier, L.CLASSIFIERS), (_regressor, L.REGRESSORS), (_clusterer, L.CLUSTERERS), (_vector_step, L.VECTOR_STEPS), (_text_step, L.TEXT_STEPS)):
    for _n in _names:
        _make(_n)


@query("ml_bucketizer", "SELECT p_partkey, CAST(CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 1 ELSE 2 END AS DOUBLE) AS bin FROM part")
def ml_bucketizer(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    return X.Bucketizer(splits=[float("-inf"), 10, 30, float("inf")], inputCol="p_size", outputCol="bin").transform(p).select("p_partkey", "bin")


@query("ml_string_indexer", "WITH f AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS i FROM customer GROUP BY 1) SELECT c_custkey, CAST(i AS DOUBLE) AS i FROM customer JOIN f ON s = c_mktsegment")
def ml_string_indexer(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return X.StringIndexer(inputCol="c_mktsegment", outputCol="i").fit(c).transform(c).select("c_custkey", "i")


@query("ml_imputer", "SELECT s_suppkey, round(CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE (SELECT avg(s_acctbal) FROM supplier WHERE s_acctbal > 0) END, 4) AS b FROM supplier")
def ml_imputer(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("x"))
    return X.Imputer(inputCols=["x"], outputCols=["b"]).fit(s).transform(s).select("s_suppkey", F.round("b", 4).alias("b"))


@query("ml_sql_transformer", "SELECT n_nationkey, n_regionkey * 2 AS d FROM nation")
def ml_sql_transformer(spark, sf_dir):
    return X.SQLTransformer(statement="SELECT n_nationkey, n_regionkey * 2 AS d FROM __THIS__").transform(load(spark, sf_dir, "nation"))


@query("ml_summary", "SELECT CAST(count(*) AS BIGINT) AS n, round(avg(embedding[1]), 6) AS mean0, round(var_samp(embedding[1]), 6) AS var0, round(max(embedding[64]::DOUBLE), 6) AS max63 FROM embeddings")
def ml_summary(spark, sf_dir):
    s = L.summary(_vectors(spark, sf_dir))
    return s.select(F.col("count").alias("n"), F.round(F.col("mean")[0], 6).alias("mean0"), F.round(F.col("variance")[0], 6).alias("var0"), F.round(F.col("max")[63], 6).alias("max63"))


@query("ml_correlation", "SELECT 0 AS i, 1 AS j, round(corr(l_quantity, l_discount), 6) AS r FROM lineitem UNION ALL SELECT 0, 2, round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 1, 2, round(corr(l_discount, l_tax), 6) FROM lineitem")
def ml_correlation(spark, sf_dir):
    return L.correlations(_rows(spark, sf_dir)).withColumn("r", F.round("r", 6))


@query("ml_topics")
def ml_topics(spark, sf_dir):
    return L.topics(load(spark, sf_dir, "documents").select("doc_id", "text"))


@query("ml_spectral")
def ml_spectral(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst"))
    return L.spectral(n)


@query("ml_chi_squared")
def ml_chi_squared(spark, sf_dir):
    d = load(spark, sf_dir, "part").select(F.array((F.col("p_size") % 3).cast("double"), (F.col("p_size") % 5).cast("double")).alias("a"), (F.col("p_size") % 2).cast("double").alias("label"))
    return L.chi_squared(L.vectors(d, "a"))


@query("ml_kolmogorov_smirnov")
def ml_kolmogorov_smirnov(spark, sf_dir):
    return L.kolmogorov_smirnov(load(spark, sf_dir, "embeddings").select(F.col("embedding")[0].cast("double").alias("x")), "x")


@query("ml_tuning")
def ml_tuning(spark, sf_dir):
    d = _vectors(spark, sf_dir, two=True).cache()
    try:
        return spark.createDataFrame([("folds", float(L.tuned(d))), ("split", float(L.tuned(d, None)))], "kind string, accuracy double")
    finally:
        d.unpersist()


# ---------------------------------------------------------------- steps that are plain arithmetic, value by value
_ELEMENTS = "el AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


def _values(df, col: str, digits: int = 6):
    """(vec_id, i, x): the elements of a vector column."""
    return df.select("vec_id", F.posexplode(vector_to_array(col)).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", digits).alias("x"))


def _by_value(name: str, step, sql: str):
    @query(f"ml_values_{name}", f"WITH {_ELEMENTS} {sql}")
    def run(spark, sf_dir):
        v = _vectors(spark, sf_dir)
        s = step()
        return _values((s.fit(v) if hasattr(s, "fit") else s).transform(v), "out")


for _name, _step, _sql in (
    ("binarizer", lambda: X.Binarizer(threshold=0.1, inputCol="features", outputCol="out"), "SELECT vec_id, i, CASE WHEN x > 0.1 THEN 1.0::DOUBLE ELSE 0 END AS x FROM el"),
    ("min_max", lambda: X.MinMaxScaler(inputCol="features", outputCol="out"), "SELECT vec_id, i, round((x - min(x) OVER d) / (max(x) OVER d - min(x) OVER d), 6) AS x FROM el WINDOW d AS (PARTITION BY i)"),
    ("max_abs", lambda: X.MaxAbsScaler(inputCol="features", outputCol="out"), "SELECT vec_id, i, round(x / max(abs(x)) OVER (PARTITION BY i), 6) AS x FROM el"),
    ("standard", lambda: X.StandardScaler(withMean=True, inputCol="features", outputCol="out"), "SELECT vec_id, i, round((x - avg(x) OVER d) / stddev_samp(x) OVER d, 6) AS x FROM el WINDOW d AS (PARTITION BY i)"),
    ("normalizer", lambda: X.Normalizer(p=1.0, inputCol="features", outputCol="out"), "SELECT vec_id, i, round(x / sum(abs(x)) OVER (PARTITION BY vec_id), 6) AS x FROM el"),
    ("slicer", lambda: X.VectorSlicer(indices=[5, 0, 9], inputCol="features", outputCol="out"), "SELECT vec_id, CASE i WHEN 5 THEN 0 WHEN 0 THEN 1 ELSE 2 END::BIGINT AS i, round(x, 6) AS x FROM el WHERE i IN (0, 5, 9)"),
    ("elementwise", lambda: X.ElementwiseProduct(scalingVec=[float(i % 3) for i in range(64)], inputCol="features", outputCol="out"), "SELECT vec_id, i, round(x * (i % 3), 6) AS x FROM el"),
    ("dct", lambda: X.DCT(inputCol="features", outputCol="out"), "SELECT a.vec_id, CAST(k.k AS BIGINT) AS i, round(sum(a.x * cos(pi() * (a.i + 0.5) * k.k / 64)) * sqrt(CASE WHEN k.k = 0 THEN 1 ELSE 2 END / 64.0), 6) AS x FROM el a, range(64) k(k) GROUP BY 1, 2, k.k"),
):
    _by_value(_name, _step, _sql)


@query("ml_values_polynomial", "SELECT p_partkey AS vec_id, i, CAST(x AS DOUBLE) AS x FROM (SELECT p_partkey, unnest([0, 1, 2, 3, 4])::BIGINT AS i, unnest([p_size, p_size * p_size, 3, 3 * p_size, 9]) AS x FROM part)")
def ml_values_polynomial(spark, sf_dir):
    """Of (size, 3) to the second degree."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), array_to_vector(F.array(F.col("p_size").cast("double"), F.lit(3.0))).alias("features"))
    return _values(X.PolynomialExpansion(degree=2, inputCol="features", outputCol="out").transform(p), "out")


@query("ml_values_interaction", "SELECT p_partkey AS vec_id, i, CAST(x AS DOUBLE) AS x FROM (SELECT p_partkey, unnest([0, 1])::BIGINT AS i, unnest([2 * p_size, p_size * (p_size % 5)]) AS x FROM part)")
def ml_values_interaction(spark, sf_dir):
    size = F.col("p_size").cast("double")
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), size.alias("a"), F.lit(2.0).alias("u"), (size % 5).alias("v"))
    p = X.VectorAssembler(inputCols=["u", "v"], outputCol="b").transform(p)
    return _values(X.Interaction(inputCols=["a", "b"], outputCol="out").transform(p), "out")


@query("ml_values_one_hot", "SELECT n_nationkey AS vec_id, CAST(i AS BIGINT) AS i, CASE WHEN n_regionkey = i THEN 1.0::DOUBLE ELSE 0 END AS x FROM nation, range(5) r(i)")
def ml_values_one_hot(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("vec_id"), F.col("n_regionkey").cast("double").alias("r"))
    return _values(X.OneHotEncoder(inputCols=["r"], outputCols=["out"], dropLast=False).fit(n).transform(n), "out")


@query("ml_values_assembler", "SELECT p_partkey AS vec_id, i, x FROM (SELECT p_partkey, unnest([0, 1, 2])::BIGINT AS i, unnest([CAST(p_size AS DOUBLE), p_retailprice, CAST(p_partkey AS DOUBLE)]) AS x FROM part)")
def ml_values_assembler(spark, sf_dir):
    """A vector whose size is checked first, and a number, as one vector."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), array_to_vector(F.array(F.col("p_size").cast("double"), "p_retailprice")).alias("a"), F.col("p_partkey").cast("double").alias("b"))
    sized = X.VectorSizeHint(inputCol="a", size=2, handleInvalid="error").transform(p)
    return _values(X.VectorAssembler(inputCols=["a", "b"], outputCol="out").transform(sized), "out")


@query("ml_index_to_string", "SELECT c_custkey, c_mktsegment AS segment FROM customer")
def ml_index_to_string(spark, sf_dir):
    """Names to indices and back."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    i = X.StringIndexer(inputCol="c_mktsegment", outputCol="i").fit(c)
    return X.IndexToString(inputCol="i", outputCol="segment", labels=i.labels).transform(i.transform(c)).select("c_custkey", "segment")


@query("ml_formula", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS label, p_retailprice AS x0 FROM part")
def ml_formula(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    out = X.RFormula(formula="p_size ~ p_retailprice").fit(p).transform(p)
    return out.select("p_partkey", "label", vector_to_array("features")[0].alias("x0"))


@query("ml_quantile_bins", "SELECT bin, count(*) BETWEEN 0.24 * c AND 0.26 * c AS even FROM (SELECT CAST(floor(4 * (rank() OVER (ORDER BY o_totalprice) - 1) / count(*) OVER ()) AS DOUBLE) AS bin, count(*) OVER () AS c FROM orders) GROUP BY bin, c")
def ml_quantile_bins(spark, sf_dir):
    """Four bins, each with about a quarter of the rows."""
    o = load(spark, sf_dir, "orders").select("o_totalprice")
    bins = X.QuantileDiscretizer(numBuckets=4, inputCol="o_totalprice", outputCol="bin", relativeError=0.0).fit(o).transform(o)
    return bins.groupBy("bin").agg(F.count("*").between(0.24 * o.count(), 0.26 * o.count()).alias("even"))


@query("ml_feature_hasher", "SELECT n_nationkey, 2.0::DOUBLE AS total FROM nation")
def ml_feature_hasher(spark, sf_dir):
    """Two categorical columns give two ones, wherever they fall; signs aren't used."""
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("r"))
    out = X.FeatureHasher(inputCols=["n_name", "r"], outputCol="out", numFeatures=1 << 16).transform(n)
    return out.select("n_nationkey", F.aggregate(vector_to_array("out"), F.lit(0.0), lambda t, x: t + x).alias("total"))


@query("ml_selector", "SELECT p_partkey, CAST(p_size % 2 AS DOUBLE) AS kept FROM part")
def ml_selector(spark, sf_dir):
    """Of three columns the one that the label depends on."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.array((F.col("p_size") % 7).cast("double"), (F.col("p_size") % 2).cast("double"), F.lit(1.0)).alias("a"), (F.col("p_size") % 2).cast("double").alias("label"))
    v = L.vectors(p, "a")
    out = X.VectorSlicer(indices=L.best_columns(v, 1), inputCol="features", outputCol="out").transform(v)
    return out.select("p_partkey", vector_to_array("out")[0].alias("kept"))


@query("ml_tokens", "SELECT conv_id, turn, string_split_regex(lower(text), '\\s') AS words FROM conversations")
def ml_tokens(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return X.RegexTokenizer(pattern=r"\s", minTokenLength=0, inputCol="text", outputCol="words").transform(c).select("conv_id", "turn", "words")


@query("ml_bigrams", "WITH w AS (SELECT conv_id, turn, string_split_regex(lower(text), '\\s') AS w FROM conversations) SELECT conv_id, turn, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS grams FROM w")
def ml_bigrams(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    w = X.RegexTokenizer(pattern=r"\s", minTokenLength=0, inputCol="text", outputCol="words").transform(c)
    return X.NGram(n=2, inputCol="words", outputCol="grams").transform(w).select("conv_id", "turn", "grams")


# ---------------------------------------------------------------- measures
@query(
    "ml_measures",
    """WITH p AS (SELECT l_quantity AS y, 25 + l_linenumber::DOUBLE AS g FROM lineitem), b AS (SELECT CAST(p_size % 2 AS DOUBLE) AS y, CAST(p_size % 3 = 1 AS INTEGER)::DOUBLE AS g FROM part)
SELECT 'rmse' AS measure, round(sqrt(avg(pow(y - g, 2))), 6) AS x FROM p UNION ALL SELECT 'mae', round(avg(abs(y - g)), 6) FROM p
UNION ALL SELECT 'r2', round(1 - sum(pow(y - g, 2)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) FROM p UNION ALL SELECT 'accuracy', round(avg(CASE WHEN y = g THEN 1.0 ELSE 0 END), 6) FROM b
UNION ALL SELECT 'precision1', round(count(*) FILTER (WHERE y = 1 AND g = 1) / count(*) FILTER (WHERE g = 1), 6) FROM b UNION ALL SELECT 'recall1', round(count(*) FILTER (WHERE y = 1 AND g = 1) / count(*) FILTER (WHERE y = 1), 6) FROM b
UNION ALL SELECT 'auc', round(0.5 * (1 + count(*) FILTER (WHERE y = 1 AND g = 1) / count(*) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 0 AND g = 1) / count(*) FILTER (WHERE y = 0)), 6) FROM b""",
)
def ml_measures(spark, sf_dir):
    """Evaluators on predictions that are known."""
    p = load(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("label"), (F.lit(25) + F.col("l_linenumber")).cast("double").alias("prediction"))
    b = load(spark, sf_dir, "part").select((F.col("p_size") % 2).cast("double").alias("label"), (F.col("p_size") % 3 == 1).cast("double").alias("prediction"))
    of = {"rmse": "rmse", "mae": "mae", "r2": "r2"}
    rows = [(k, E.RegressionEvaluator(metricName=m).evaluate(p)) for k, m in of.items()]
    rows += [(k, E.MulticlassClassificationEvaluator(metricName=m, metricLabel=1.0).evaluate(b)) for k, m in (("accuracy", "accuracy"), ("precision1", "precisionByLabel"), ("recall1", "recallByLabel"))]
    rows.append(("auc", E.BinaryClassificationEvaluator(rawPredictionCol="prediction").evaluate(b)))
    return spark.createDataFrame([(k, round(x, 6)) for k, x in rows], "measure string, x double")


@query("ml_model_quality", "SELECT 'logistic_regression' AS model, true AS better_than_chance UNION ALL SELECT 'random_forest', true UNION ALL SELECT 'naive_bayes', true")
def ml_model_quality(spark, sf_dir):
    """Classifiers beat the largest class's share of all vectors, each vector being judged by models fitted to the two thirds that
    it isn't in; the label is whether the sum of the first two elements is positive."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("embedding")[0] + F.col("embedding")[1] > 0).cast("double").alias("label"))
    v = L.vectors(e, "embedding").drop("embedding")
    most = v.groupBy("label").count().agg(F.max("count")).first()[0] / max(1, v.count())
    by = E.MulticlassClassificationEvaluator(metricName="accuracy")
    rows = [(m, bool(by.evaluate(L.held_out_predictions(L.CLASSIFIERS[m], v, "vec_id", ["label"])) > most)) for m in ("logistic_regression", "random_forest", "naive_bayes")]
    return spark.createDataFrame(rows, "model string, better_than_chance boolean")
