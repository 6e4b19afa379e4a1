"""Machine-learning operators as DataFrame functions: a registry of Spark's estimators and transformers with working defaults."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import evaluation as E
from pyspark.ml import feature as X
from pyspark.ml import regression as R
from pyspark.ml import stat as S
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 7
#: name -> estimator on (features, label)
CLASSIFIERS: dict[str, Callable] = {
    "logistic_regression": lambda: C.LogisticRegression(maxIter=10, regParam=0.01),
    "linear_svc": lambda: C.LinearSVC(maxIter=5),
    "decision_tree": lambda: C.DecisionTreeClassifier(maxDepth=4, seed=SEED),
    "random_forest": lambda: C.RandomForestClassifier(numTrees=5, maxDepth=4, seed=SEED),
    "boosted_trees": lambda: C.GBTClassifier(maxIter=3, maxDepth=3, seed=SEED),
    "naive_bayes": lambda: C.NaiveBayes(modelType="gaussian"),
    "perceptron": lambda: C.MultilayerPerceptronClassifier(layers=[64, 8, 2], maxIter=10, seed=SEED),
    "one_vs_rest": lambda: C.OneVsRest(classifier=C.LogisticRegression(maxIter=5)),
    "factorisation": lambda: C.FMClassifier(maxIter=5, factorSize=2, seed=SEED),
}
REGRESSORS: dict[str, Callable] = {
    "linear": lambda: R.LinearRegression(regParam=0.01),
    "decision_tree": lambda: R.DecisionTreeRegressor(maxDepth=4, seed=SEED),
    "random_forest": lambda: R.RandomForestRegressor(numTrees=5, maxDepth=4, seed=SEED),
    "generalised": lambda: R.GeneralizedLinearRegression(family="gaussian", link="identity"),
    "isotonic": lambda: R.IsotonicRegression(),
    "survival": lambda: R.AFTSurvivalRegression(censorCol="censor", maxIter=5),
    "factorisation": lambda: R.FMRegressor(maxIter=5, factorSize=2, seed=SEED),
}
CLUSTERERS: dict[str, Callable] = {
    "kmeans": lambda k: K.KMeans(k=k, seed=SEED, maxIter=5),
    "bisecting": lambda k: K.BisectingKMeans(k=k, seed=SEED, maxIter=5),
    "mixture": lambda k: K.GaussianMixture(k=k, seed=SEED, maxIter=3),
}
#: name -> transformer or estimator from column "features" to column "out"
VECTOR_STEPS: dict[str, Callable] = {
    "binarizer": lambda: X.Binarizer(threshold=0.0, inputCol="features", outputCol="out"),
    "dct": lambda: X.DCT(inputCol="features", outputCol="out"),
    "min_max": lambda: X.MinMaxScaler(inputCol="features", outputCol="out"),
    "max_abs": lambda: X.MaxAbsScaler(inputCol="features", outputCol="out"),
    "standard": lambda: X.StandardScaler(inputCol="features", outputCol="out", withMean=True),
    "robust": lambda: X.RobustScaler(inputCol="features", outputCol="out"),
    "normalizer": lambda: X.Normalizer(p=2.0, inputCol="features", outputCol="out"),
    "pca": lambda: X.PCA(k=4, inputCol="features", outputCol="out"),
    "slicer": lambda: X.VectorSlicer(indices=[0, 2, 5], inputCol="features", outputCol="out"),
    "indexer": lambda: X.VectorIndexer(maxCategories=3, inputCol="features", outputCol="out"),
    "variance": lambda: X.VarianceThresholdSelector(varianceThreshold=0.0, featuresCol="features", outputCol="out"),
    "univariate": lambda: X.UnivariateFeatureSelector(featuresCol="features", outputCol="out", labelCol="label").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(5),
    "projection_lsh": lambda: X.BucketedRandomProjectionLSH(bucketLength=0.5, numHashTables=2, seed=SEED, inputCol="features", outputCol="out"),
}
#: name -> chain from column "text" to column "out"
TEXT_STEPS: dict[str, Callable] = {
    "tokenizer": lambda: [X.Tokenizer(inputCol="text", outputCol="out")],
    "regex_tokenizer": lambda: [X.RegexTokenizer(pattern=r"\W+", inputCol="text", outputCol="out")],
    "stop_words": lambda: [X.Tokenizer(inputCol="text", outputCol="w"), X.StopWordsRemover(inputCol="w", outputCol="out")],
    "ngram": lambda: [X.Tokenizer(inputCol="text", outputCol="w"), X.NGram(n=2, inputCol="w", outputCol="out")],
    "hashing_tf": lambda: [X.Tokenizer(inputCol="text", outputCol="w"), X.HashingTF(numFeatures=64, inputCol="w", outputCol="out")],
    "tf_idf": lambda: [X.Tokenizer(inputCol="text", outputCol="w"), X.HashingTF(numFeatures=64, inputCol="w", outputCol="tf"), X.IDF(inputCol="tf", outputCol="out")],
    "count_vectorizer": lambda: [X.Tokenizer(inputCol="text", outputCol="w"), X.CountVectorizer(vocabSize=50, inputCol="w", outputCol="out")],
    "word2vec": lambda: [X.Tokenizer(inputCol="text", outputCol="w"), X.Word2Vec(vectorSize=4, minCount=5, maxIter=1, seed=SEED, inputCol="w", outputCol="out")],
    "min_hash": lambda: [X.Tokenizer(inputCol="text", outputCol="w"), X.HashingTF(numFeatures=1024, inputCol="w", outputCol="tf"), X.MinHashLSH(numHashTables=3, seed=SEED, inputCol="tf", outputCol="out")],
}


def vectors(df: DataFrame, array_col: str) -> DataFrame:
    """df with its array as the vector column `features`."""
    return df.withColumn("features", array_to_vector(F.col(array_col).cast("array<double>")))


def fit_predict(estimator, train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    return estimator.fit(train).transform(test).select(*keys, "prediction")


def held_out_predictions(make: Callable, df: DataFrame, key: str, keys: list[str], folds: int = 3) -> DataFrame:
    """A prediction for every row of df, by a model fitted to the folds that the row isn't in; key's hash deals the rows."""
    fold = F.pmod(F.xxhash64(key), F.lit(folds))
    return reduce(DataFrame.unionByName, [fit_predict(make(), df.where(fold != k), df.where(fold == k), keys) for k in range(folds)])


def apply_step(stages: list, df: DataFrame, keys: list[str]) -> DataFrame:
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.select(*keys, F.col("out").cast("string").alias("out"))


def topics(df: DataFrame, k: int = 4) -> DataFrame:
    """(topic, terms, weights) of a topic model over column `text`."""
    stages = [X.Tokenizer(inputCol="text", outputCol="w"), X.CountVectorizer(vocabSize=200, inputCol="w", outputCol="features")]
    counted = Pipeline(stages=stages).fit(df).transform(df)
    return K.LDA(k=k, maxIter=3, seed=SEED).fit(counted).describeTopics(5)


def spectral(edges: DataFrame, k: int = 2) -> DataFrame:
    """(id, cluster) by power iteration on (src, dst)."""
    return K.PowerIterationClustering(k=k, maxIter=5, srcCol="src", dstCol="dst").assignClusters(edges)


def evaluate(predictions: DataFrame, kind: str, metric: str) -> float:
    made = {"regression": E.RegressionEvaluator, "multiclass": E.MulticlassClassificationEvaluator, "binary": E.BinaryClassificationEvaluator, "clustering": E.ClusteringEvaluator, "ranking": E.RankingEvaluator}[kind]
    return made(metricName=metric).evaluate(predictions)


def tuned(train: DataFrame, folds: int | None = 2) -> float:
    """The best mean accuracy of a small grid, by cross-validation or, without folds, by one split."""
    lr = C.LogisticRegression(maxIter=3)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1]).build()
    by = E.MulticlassClassificationEvaluator(metricName="accuracy")
    if folds:
        return max(CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=by, numFolds=folds, seed=SEED).fit(train).avgMetrics)
    return max(TrainValidationSplit(estimator=lr, estimatorParamMaps=grid, evaluator=by, seed=SEED).fit(train).validationMetrics)


def correlations(df: DataFrame, method: str = "pearson") -> DataFrame:
    m = S.Correlation.corr(df, "features", method).first()[0].toArray()
    return df.sparkSession.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(i + 1, m.shape[1])], "i int, j int, r double")


def best_columns(df: DataFrame, n: int) -> list[int]:
    """The n features that a chi-squared test ties closest to the label, in their order. Over many rows several p-values are 0
    in floating point; the larger statistic then comes first."""
    found = chi_squared(df).orderBy("pValue", F.desc("statistic"), "featureIndex").limit(n).collect()
    return sorted(r["featureIndex"] for r in found)


def chi_squared(df: DataFrame) -> DataFrame:
    return S.ChiSquareTest.test(df, "features", "label", flatten=True)


def kolmogorov_smirnov(df: DataFrame, col: str) -> DataFrame:
    r = S.KolmogorovSmirnovTest.test(df, col, "norm", 0.0, 1.0).first()
    return df.sparkSession.createDataFrame([(r.pValue, r.statistic)], "p double, statistic double")


def summary(df: DataFrame) -> DataFrame:
    """One row of vector statistics as arrays."""
    s = df.agg(S.Summarizer.metrics("mean", "variance", "count", "max", "min").summary(F.col("features")).alias("s"))
    return s.select(*[vector_to_array(f"s.{c}").alias(c) for c in ("mean", "variance", "max", "min")], "s.count")
