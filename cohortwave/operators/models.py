"""Learned models on DataFrames with ``pyspark.ml``, out-of-fold prediction and comparison."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import islice

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, IndexToString, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import FRIENDLY_LABELS, code_map
from .agglomerate import assign, standard_points, ward_tree
from .baselines import class_weights, dummy_majority_cv, dummy_mean_cv
from .evaluate import binary_metrics, leaderboard, regression_metrics
from .kmeans import assign as nearest_centre
from .kmeans import best_of_starts
from .scale import append, materialise

MIN_LEAF = 1
FOLDS_AT_ONCE = 32  # folds whose predictions form one plan
MAX_DEPTH = 30  # the deepest tree Spark grows; the forests here have no limit of their own


def assemble(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep")


def scaled(features: list[str]) -> list:
    return [assemble(features, "_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)]


def rf_regressor(features: list[str], y: str, trees: int = 500, min_leaf: int = MIN_LEAF, seed: int = 42,
                 depth: int = MAX_DEPTH, bootstrap: bool = True) -> Pipeline:
    return Pipeline(stages=[assemble(features), RandomForestRegressor(
        labelCol=y, numTrees=trees, minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed,
        bootstrap=bootstrap)])


def rf_classifier(features: list[str], y: str, trees: int = 500, weight: str | None = "weight", seed: int = 42,
                  depth: int = MAX_DEPTH, bootstrap: bool = True) -> Pipeline:
    forest = RandomForestClassifier(labelCol=y, numTrees=trees, featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed, bootstrap=bootstrap)
    if weight:
        forest.setWeightCol(weight)
    return Pipeline(stages=[assemble(features), forest])


def gbt_regressor(features: list[str], y: str, rounds: int = 250, depth: int = 4, rate: float = 0.05,
                  frac: float = 0.85, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[assemble(features), GBTRegressor(
        labelCol=y, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=frac,
        featureSubsetStrategy=str(frac), seed=seed)])


def gbt_classifier(features: list[str], y: str, rounds: int = 200, depth: int = 4, rate: float = 0.05,
                   frac: float = 0.85, weight: str | None = "weight", seed: int = 42) -> Pipeline:
    trees = GBTClassifier(labelCol=y, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=frac,
                          featureSubsetStrategy=str(frac), seed=seed)
    if weight:
        trees.setWeightCol(weight)
    return Pipeline(stages=[assemble(features), trees])


def elastic_net(df: DataFrame, features: list[str], y: str, alpha: float = 0.1, l1_ratio: float = 0.5) -> Pipeline:
    """1/(2n)|y - Zb|^2 + alpha (l1 |b|_1 + (1 - l1)/2 |b|^2) on standardised features.

    Spark divides the squared part of its penalty by the spread of y, so both parameters are
    restated for the spread found in ``df``.
    """
    spread = float(df.agg(F.stddev_samp(y)).first()[0])
    reg = alpha * l1_ratio + alpha * (1 - l1_ratio) * spread
    return Pipeline(stages=[assemble(features), LinearRegression(
        labelCol=y, regParam=reg, elasticNetParam=alpha * l1_ratio / reg, standardization=True, maxIter=2000, tol=1e-9)])


def logistic_balanced(df: DataFrame, features: list[str], y: str, c: float = 1.0, weight: str = "weight") -> Pipeline:
    """Weighted logistic regression; Spark averages the loss, so C is restated for the weight in ``df``."""
    total = float(df.agg(F.sum(weight)).first()[0])
    return Pipeline(stages=[*scaled(features), LogisticRegression(
        labelCol=y, weightCol=weight, regParam=1.0 / (c * total), standardization=False, maxIter=500, tol=1e-8)])


def fourier_features(df: DataFrame, features: list[str], n_proj: int = 64, gamma: float | None = None,
                     seed: int = 42) -> tuple[DataFrame, list[str]]:
    """sqrt(2/D) cos(w.x + b) columns whose dot products approach exp(-gamma |x - x'|^2).

    ``features`` are standardised columns, for which the usual gamma is one over their number.
    """
    gamma = 1.0 / len(features) if gamma is None else gamma
    rng = np.random.default_rng(seed)
    w = rng.normal(0, np.sqrt(2 * gamma), (n_proj, len(features)))
    b = rng.uniform(0, 2 * np.pi, n_proj)
    scale = float(np.sqrt(2.0 / n_proj))
    dots = [" + ".join([f"({float(b[i])!r}D)", *[f"`{f}` * ({float(v)!r}D)" for f, v in zip(features, w[i])]])
            for i in range(n_proj)]
    cols = [f"rff_{i}" for i in range(n_proj)]
    return df.selectExpr("*", *[f"cos({d}) * {scale!r}D AS {c}" for d, c in zip(dots, cols)]), cols


def rbf_margin_classifier(projected: list[str], y: str, rows: int, c: float = 1.0, weight: str = "weight",
                          max_iter: int = 100) -> Pipeline:
    return Pipeline(stages=[assemble(projected), LinearSVC(
        labelCol=y, weightCol=weight, regParam=1.0 / (c * rows), standardization=False, maxIter=max_iter)])


def rbf_regressor(projected: list[str], y: str, rows: int, c: float = 1.0) -> Pipeline:
    return Pipeline(stages=[assemble(projected), LinearRegression(
        labelCol=y, loss="huber", regParam=1.0 / (c * rows), standardization=False, maxIter=200)])


def importance_table(model: PipelineModel, features: list[str], n: int = 20) -> DataFrame:
    """The n most important features with their rank."""
    weights = model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(features, (float(w) for w in weights)), key=lambda r: (-r[1], r[0]))[:n]
    rows = [(i, f, w) for i, (f, w) in enumerate(ranked, 1)]
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession().createDataFrame(rows, "rank int, feature string, importance double")


def top_features(df: DataFrame, features: list[str], y: str, n: int, trees: int = 500, depth: int = MAX_DEPTH,
                 seed: int = 42) -> list[str]:
    """Names of the n most important features; pass train rows only to keep test rows out."""
    if n >= len(features):
        return features
    model = rf_regressor(features, y, trees, seed=seed, depth=depth).fit(df)
    return [r["feature"] for r in importance_table(model, features, n).orderBy("rank").collect()]


def slice_features(model_features: list[str], chosen: list[str]) -> VectorSlicer:
    return VectorSlicer(inputCol="features", outputCol="selected", indices=[model_features.index(c) for c in chosen])


Estimator = Callable[[DataFrame], Pipeline] | Pipeline


def cross_val_predict(est: Estimator, df: DataFrame, fold: str, threads: int = 4,
                      prepare: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None,
                      most: int = FOLDS_AT_ONCE) -> DataFrame:
    """Out-of-fold prediction of every row.

    ``est`` may be a function of the train rows; ``prepare`` may fit anything else on them.
    The rows are written once for all fits, and folds are fitted side by side, ``most`` at a time: their predictions
    are written before the next ones are fitted, so neither the plan nor the driver grows with the number of folds.
    """
    rows = materialise(df)
    folds = materialise(rows.select(fold).distinct().orderBy(fold))
    if folds.count() < 2:
        raise ValueError("at least two folds are needed")

    def one(f):
        train, test = rows.where(F.col(fold) != f), rows.where(F.col(fold) == f)
        if prepare:
            train, test = prepare(train, test)
        pipeline = est(train) if callable(est) else est
        return pipeline.fit(train).transform(test)

    out = None
    names = (r[0] for r in folds.toLocalIterator())
    with ThreadPoolExecutor(max_workers=threads) as pool:
        while some := list(islice(names, most)):
            part = reduce(DataFrame.unionByName, pool.map(one, some))
            if out is None and len(some) < most:
                return part
            out = append(part, out)
    return out.read()


def positive_probability(df: DataFrame, out: str = "score", column: str = "probability") -> DataFrame:
    return df.withColumn(out, F.get(vector_to_array(F.col(column)), F.lit(1)))


def compare_regressors(models: dict[str, Estimator], df: DataFrame, y: str, fold: str,
                       ready: dict[str, DataFrame] | None = None) -> DataFrame:
    """Leaderboard of named models and of the mean, by RMSE and MAE. ``ready`` holds predictions made elsewhere."""
    predictions = {"DummyMean": dummy_mean_cv(df, fold, y, "prediction"), **(ready or {})}
    predictions |= {name: cross_val_predict(m, df, fold) for name, m in models.items()}
    tagged = None
    for name, p in predictions.items():
        part = p.select(F.lit(name).alias("model"), F.col(y).cast("double").alias("actual"),
                        F.col("prediction").alias("predicted"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return leaderboard(regression_metrics(tagged, ["model"]), ascending=["rmse", "mae"])


def compare_classifiers(models: dict[str, Estimator], df: DataFrame, y: str, fold: str, positive=1) -> DataFrame:
    """Leaderboard of named 0/1 classifiers and of the majority class, by F1, recall and accuracy."""
    predictions = {"DummyMajority": dummy_majority_cv(df, fold, y, "prediction")}
    predictions |= {name: cross_val_predict(m, df, fold) for name, m in models.items()}
    tagged = None
    for name, p in predictions.items():
        part = p.select(F.lit(name).alias("model"), F.col(y).cast("int").alias("actual_label"),
                        F.col("prediction").cast("int").alias("predicted_label"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return leaderboard(binary_metrics(tagged, positive, ["model"]), descending=["f1", "recall", "accuracy"])


def train_final(df: DataFrame, features: list[str], y: str, category: str, trees: int = 500,
                depth: int = MAX_DEPTH, seed: int = 42) -> PipelineModel:
    """A regressor for the label and a balanced classifier for its category, fitted on all rows."""
    weighted = class_weights(df, category)
    indexer = StringIndexer(inputCol=category, outputCol="_category", handleInvalid="keep").fit(weighted)
    stages = [
        assemble(features),
        RandomForestRegressor(labelCol=y, predictionCol="predicted_hours", numTrees=trees, maxDepth=depth,
                              featureSubsetStrategy="sqrt", seed=seed),
    ]
    hours = Pipeline(stages=stages).fit(weighted)
    forest = RandomForestClassifier(labelCol="_category", weightCol="weight", numTrees=trees, maxDepth=depth,
                                    predictionCol="_predicted", probabilityCol="probability",
                                    featureSubsetStrategy="sqrt", seed=seed)
    classes = forest.fit(indexer.transform(hours.stages[0].transform(weighted)))
    names = IndexToString(inputCol="_predicted", outputCol="predicted_category", labels=[*indexer.labels, "unknown"])
    return PipelineModel(stages=[*hours.stages, classes, names])


def predict_batch(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Hours, category and its friendly text for any number of subjects."""
    needed = model.stages[0].getInputCols()
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing {len(missing)} features, first ones: {missing[:3]}")
    out = model.transform(df)
    return out.withColumn("predicted_label", code_map(F.col("predicted_category"), FRIENDLY_LABELS,
                                                      FRIENDLY_LABELS["Normal"])) \
        .drop("features", "rawPrediction", "probability", "_predicted")


def kmeans(df: DataFrame, features: list[str], k: int = 3, restarts: int = 20, seed: int = 42,
           out: str = "cluster") -> DataFrame:
    """The best of several starts by within-cluster cost, on standardised features; clusters are numbered from the largest."""
    points = materialise(standard_points(df, features))
    centres, _ = best_of_starts(points, k, restarts, seed)
    return nearest_centre(points, centres, out).drop("x")


def hierarchical_clusters(df: DataFrame, features: list[str], k: int = 3, out: str = "cluster", most: int | None = None) -> DataFrame:
    """Ward clusters of the standardised features; with ``most`` those of at most so many clustering features (see ``agglomerate``)."""
    points = materialise(standard_points(df, features))
    return assign(points, ward_tree(points, most), k, out).drop("x")


def pca(df: DataFrame, features: list[str], k: int = 2) -> DataFrame:
    """The first k components of the standardised features as columns; their signs are arbitrary."""
    stages = [*scaled(features), PCA(k=k, inputCol="features", outputCol="_pcs")]
    out = Pipeline(stages=stages).fit(df).transform(df).withColumn("_pcs", vector_to_array("_pcs"))
    return out.withColumns({f"pc{i + 1}": F.get("_pcs", F.lit(i)) for i in range(k)}).drop("_pcs", "_raw", "features")


def weigh_train(label: str) -> Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """Class weights counted on the train rows alone."""
    return lambda train, test: (class_weights(train, label), test)


def silhouette(df: DataFrame, cluster: str, features: str = "features") -> DataFrame:
    """Mean silhouette under squared Euclidean distance."""
    score = ClusteringEvaluator(predictionCol=cluster, featuresCol=features).evaluate(df)
    return df.sparkSession.createDataFrame([(float(score),)], "silhouette double")
