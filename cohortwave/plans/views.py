"""Feature views x models: out-of-fold regression of the subject label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.baselines import dummy_mean_cv, impute_median
from ..operators.evaluate import leaderboard, prediction_range, regression_metrics
from ..operators.linear import elastic_net_search, pls_regression, ridge_path
from ..operators.models import cross_val_predict, rf_regressor
from ..operators.quality import require_groups
from ..operators.relative import baseline_relative, family_relative, raw_summary, taskwide_relative
from ..operators.scale import materialise
from ..operators.subjects import align, combine_views

MODELS = ["DummyMean", "RidgeCV", "ElasticNetFast", "PLSRegression", "RandomForest"]


VIEWS = ["raw_summary", "baseline_relative_summary", "task_family_relative", "task_wide_relative", "combined_relative"]


def build_views(df: DataFrame, features: list[str], tasks: list[str], families: list, baseline: str,
                names: list[str] = VIEWS) -> dict[str, DataFrame]:
    """The named views of a segment table, each one row per subject."""
    parts: dict[str, DataFrame] = {}
    if "baseline_relative_summary" in names or "combined_relative" in names:
        parts["summary"] = baseline_relative(df, features, baseline)
    if "task_family_relative" in names or "combined_relative" in names:
        parts["family"] = family_relative(df, features, families, baseline)
    make = {
        "raw_summary": lambda: raw_summary(df, features),
        "baseline_relative_summary": lambda: parts["summary"],
        "task_family_relative": lambda: parts["family"],
        "task_wide_relative": lambda: taskwide_relative(df, features, tasks, baseline),
        "combined_relative": lambda: combine_views(parts),
    }
    return {n: make[n]() for n in names}


def predict_view(table: DataFrame, features: list[str], models: list[str], label: str, trees: int, depth: int) -> DataFrame:
    """Long (model, subject, fold, actual, predicted, details); ``table`` has fold and inner."""
    keys = ["subject", "fold"]
    filled = None
    out = None
    for name in models:
        if name != "DummyMean" and filled is None:
            filled = materialise(impute_median(table, features, "fold").fillna(0.0, features))
        if name == "DummyMean":
            p = dummy_mean_cv(table.select(*keys, label), "fold", label).withColumn("details", F.lit(""))
        elif name == "RidgeCV":
            p = ridge_path(filled.select(*keys, label, *features), features, label, "fold")
        elif name == "ElasticNetFast":
            p = elastic_net_search(filled, features, label, "fold", "inner")
        elif name == "PLSRegression":
            p = pls_regression(filled, features, label, "fold", "inner")
        elif name == "RandomForest":
            forest = rf_regressor(features, label, trees, min_leaf=3, depth=depth)
            p = cross_val_predict(forest, filled, "fold").withColumnRenamed("prediction", "predicted") \
                .withColumn("details", F.lit(""))
        else:
            raise ValueError(f"unknown model {name}; there are {MODELS}")
        part = p.select(F.lit(name).alias("model"), *keys, F.col(label).alias("actual"), "predicted", "details")
        out = part if out is None else out.unionByName(part)
    return out


def compare_views(views: dict[str, DataFrame], targets: DataFrame, models: list[str] | None = None, label: str = "hours",
                  trees: int = 500, depth: int = 30) -> tuple[DataFrame, DataFrame]:
    """(metrics, predictions); ``targets`` has subject, label, fold and inner (see folds.kfold).

    Columns missing for every subject of a view's train rows are filled with 0, as nothing
    else is known of them.
    """
    require_groups(targets, "subject", 3)
    parts, widths = [], []
    for name, view in views.items():
        table = materialise(align(targets.select("subject", label, "fold", "inner"), view))
        # short names: generated ones are long, and dots or spaces in them need quoting
        wide = [c for c in table.columns if c not in ("subject", label, "fold", "inner")]
        short = [f"f{i}" for i in range(len(wide))]
        table = table.selectExpr("subject", label, "fold", "inner",
                                 *[f"CAST(`{c}` AS DOUBLE) AS {s}" for c, s in zip(wide, short)])
        p = predict_view(table, short, models or MODELS, label, trees, depth)
        parts.append(p.withColumn("view", F.lit(name)))
        widths.append((name, len(wide)))
    predictions = parts[0]
    for p in parts[1:]:
        predictions = predictions.unionByName(p)
    predictions = materialise(predictions)
    by = ["view", "model"]
    sizes = predictions.sparkSession.createDataFrame(widths, "view string, features int")
    metrics = (regression_metrics(predictions, by).join(prediction_range(predictions, by), by)
               .join(predictions.groupBy(*by).agg(F.min("details").alias("details")), by)
               .join(F.broadcast(sizes), "view"))
    return leaderboard(metrics, descending=["r2"], ascending=["rmse"]), predictions
