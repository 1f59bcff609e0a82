"""Machine-learning workloads: MLlib estimators where they fit, full-batch gradient descent and closed forms as DataFrame aggregates."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, PCA, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaitwork.sources.datagen import normal, uniform


def vectors(df: DataFrame, features: str = "features") -> DataFrame:
    """The feature arrays as ML vectors."""
    return df.withColumn(features, array_to_vector(F.col(features).cast("array<double>")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


# clustering ---------------------------------------------------------------------------------------------------------


def kmeans(df: DataFrame, k: int, iterations: int = 20, seed: int = 127):
    return KMeans(k=k, maxIter=iterations, initMode="k-means||", seed=seed).fit(vectors(df))


def assign(df: DataFrame, centers: list[list[float]], features: str = "features") -> DataFrame:
    """df with the nearest center (ties: the first) and the squared distance to it, by column expressions."""
    squared = [F.aggregate(F.zip_with(F.col(features).cast("array<double>"), F.lit(c), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) for c in centers]
    best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(squared)]))
    return df.withColumn("__b", best).withColumn("cluster", F.col("__b.i")).withColumn("cost", F.col("__b.d")).drop("__b")


def wssse(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("cost").alias("wssse"))


def lloyd_step(assigned: DataFrame, dim: int, features: str = "features") -> DataFrame:
    """New centers: (cluster, center) as means of the assigned points, by partial sums per dimension."""
    means = F.array(*[F.avg(F.col(features)[j].cast("double")) for j in range(dim)])
    return assigned.groupBy("cluster").agg(means.alias("center"))


# linear models --------------------------------------------------------------------------------------------------------


def gradient_descent(df: DataFrame, dim: int, iterations: int, kind: str = "linear", step: float = 1.0, start: list[float] | None = None) -> list[float]:
    """Full-batch gradient descent with step / sqrt(i), from zero weights unless others are given; a round is one aggregate with partial sums.

    kind is linear (squared error), logistic, or svm (hinge loss, labels 0 and 1)."""
    weights = list(start) if start else [0.0] * dim
    for i in range(1, iterations + 1):
        score = dot(F.col("features"), F.lit(weights))
        if kind == "linear":
            pull = score - F.col("label")
        elif kind == "logistic":
            pull = 1 / (1 + F.exp(-score)) - F.col("label")
        else:
            sign = 2 * F.col("label") - 1
            pull = F.when(sign * score < 1, -sign).otherwise(0.0)
        row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(pull * F.col("features")[j]).alias(f"g{j}") for j in range(dim)]).first()
        if not row["n"]:
            return weights
        weights = [w - step / i**0.5 * row[f"g{j}"] / row["n"] for j, w in enumerate(weights)]
    return weights


def linear_regression(df: DataFrame, iterations: int = 100):
    return LinearRegression(maxIter=iterations).fit(vectors(df))


def logistic_regression(df: DataFrame, iterations: int = 100):
    return LogisticRegression(maxIter=iterations).fit(vectors(df))


def linear_svm(df: DataFrame, iterations: int = 100):
    """A linear SVM; rawPrediction holds raw scores."""
    return LinearSVC(maxIter=iterations).fit(vectors(df))


def mean_squared_error(df: DataFrame, a: str = "prediction", b: str = "label") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(a) - F.col(b), 2)).alias("mse"))


def area_under_roc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: the area by ranks, ties at their mean rank.  Counts per distinct score come first, so ranks are
    made of a running sum over scores by ranges, not of one window over all rows."""
    per = df.groupBy(score).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    # ranges of scores: totals of ranges are few, running sums inside a range are spread
    ranged = per.repartitionByRange(F.col(score)).withColumn("range", F.spark_partition_id())
    ranged = ranged.withColumn("below", F.sum("neg").over(Window.partitionBy("range").orderBy(score)) - F.col("neg"))
    parts = ranged.groupBy("range").agg(F.sum("neg").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("inner"))
    placed = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.agg((F.sum(F.col("inner") + F.col("p") * F.col("before")) / (F.sum("n") * F.sum("p"))).alias("auc"))


def evaluate_auc(df: DataFrame, raw: str = "rawPrediction", label: str = "label") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=raw, labelCol=label).evaluate(df)


# trees, factors, text -------------------------------------------------------------------------------------------------


def tree_classifier(df: DataFrame, depth: int = 5, bins: int = 100, seed: int = 42):
    return DecisionTreeClassifier(impurity="gini", maxDepth=depth, maxBins=bins, seed=seed).fit(vectors(df))


def tree_regressor(df: DataFrame, depth: int = 5, bins: int = 100, seed: int = 42):
    return DecisionTreeRegressor(impurity="variance", maxDepth=depth, maxBins=bins, seed=seed).fit(vectors(df))


def training_error(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    return df.agg(F.avg((F.col(prediction) != F.col(label)).cast("int")).alias("error"))


def als(ratings: DataFrame, rank: int, iterations: int, reg: float, seed: int = 42):
    return ALS(userCol="user", itemCol="item", ratingCol="rating", rank=rank, maxIter=iterations, regParam=reg, seed=seed, coldStartStrategy="drop").fit(ratings)


def select_als(train: DataFrame, validation: DataFrame, ranks=(8, 12), regs=(0.1,), iterations=(10,)):
    """(model, rmse, parameters) of the grid's model with the least validation RMSE."""
    best = None
    for rank in ranks:
        for reg in regs:
            for n in iterations:
                model = als(train, rank, n, reg)
                rmse = mean_squared_error(model.transform(validation), "prediction", "rating").first()[0]
                rmse = float("inf") if rmse is None else rmse**0.5
                if best is None or rmse < best[1]:
                    best = (model, rmse, {"rank": rank, "reg": reg, "iterations": n})
    return best


def digit_split(df: DataFrame, digit: str = "digit") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training (digit < 6), validation (6, 7) and test (8, 9) parts."""
    d = F.col(digit)
    return df.where(d < 6), df.where((d >= 6) & (d < 8)), df.where(d >= 8)


def baseline_rmse(train: DataFrame, test: DataFrame, rating: str = "rating") -> DataFrame:
    """One row: RMSE on test of the mean rating of train."""
    mean = train.agg(F.avg(rating).alias("mean"))
    return test.crossJoin(F.broadcast(mean)).agg(F.sqrt(F.avg(F.pow(F.col(rating) - F.col("mean"), 2))).alias("rmse"))  # mean is one row


def improvement(train: DataFrame, predicted: DataFrame, rating: str = "rating", prediction: str = "prediction") -> DataFrame:
    """One row: the RMSE on predicted of the mean rating of train, that of the predictions, and by how many per cent they are better."""
    off = lambda name: F.sqrt(F.avg(F.pow(F.col(rating) - F.col(name), 2)))
    mean = train.agg(F.avg(rating).alias("__mean"))
    both = predicted.crossJoin(F.broadcast(mean)).agg(off("__mean").alias("baseline"), off(prediction).alias("rmse"))  # mean is one row
    return both.withColumn("improvement", (F.col("baseline") - F.col("rmse")) / F.col("baseline") * 100)


def pca(df: DataFrame, k: int):
    return PCA(k=k, inputCol="features", outputCol="projected").fit(vectors(df))


def covariance(df: DataFrame, dim: int, features: str = "features") -> DataFrame:
    """(i, j, cov) for i <= j: the sample covariance that principal components come from, in one aggregate."""
    x = lambda j: F.col(features)[j].cast("double")
    row = df.agg(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.covar_samp(x(i), x(j)).alias("cov")) for i in range(dim) for j in range(i, dim)]).alias("c"))
    return row.select(F.explode("c").alias("c")).select("c.*")


def tf_idf(df: DataFrame, words: str = "words", features: int = 1 << 20, least: int = 2) -> DataFrame:
    counted = HashingTF(numFeatures=features, inputCol=words, outputCol="tf").transform(df)
    return IDF(minDocFreq=least, inputCol="tf", outputCol="tfidf").fit(counted).transform(counted)


def term_weights(df: DataFrame, id_col: str, words: str, least: int = 2) -> DataFrame:
    """(id, word, tf, idf, tfidf) by words: idf = ln((n + 1) / (df + 1)), zero below `least` documents."""
    tf = df.select(id_col, F.explode(words).alias("word")).groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("tf"))
    docs = df.agg(F.count(F.lit(1)).alias("n"))
    freq = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.when(F.col("df") >= least, F.log((F.col("n") + 1) / (F.col("df") + 1))).otherwise(0.0)
    weight = freq.crossJoin(F.broadcast(docs)).select("word", idf.alias("idf"))  # docs is one row
    return tf.join(weight, "word").select(id_col, "word", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def random_relabel(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    return df.withColumn("label", F.when(normal(seed, id_col) > 0, 1.0).otherwise(0.0))


def category_labels(df: DataFrame, category: str, buckets: int = 10) -> DataFrame:
    return df.withColumn("label", F.pmod(F.xxhash64(category), F.lit(buckets)).cast("double"))


def hash_split(df: DataFrame, id_col: str, share: float = 0.9, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the row id, so equal rows stay apart from the split of others."""
    marked = df.withColumn("__u", uniform(seed, id_col))
    return marked.where(F.col("__u") < share).drop("__u"), marked.where(F.col("__u") >= share).drop("__u")


def raw_scores(df: DataFrame) -> DataFrame:
    return df.withColumn("score", vector_to_array("rawPrediction")[1])
