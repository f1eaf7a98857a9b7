"""Is there any signal: models against dummies, for both label rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import HOUR_LABELS, bin_label, bin_label_inclusive
from ..operators.baselines import dummy_majority_cv
from ..operators.evaluate import accuracy_and_macro_f1
from ..operators.folds import safe_k, stratified_kfold
from .voting import predict_labels


def signal_verdict(df: DataFrame, features: list[str], label: str = "hours", k: int = 5, seed: int = 42,
                   key: tuple[str, ...] = ("subject",), labels: list[str] = HOUR_LABELS, **forest) -> DataFrame:
    """Accuracy and macro F1 of a balanced forest and of the majority class per label rule.

    A rule whose smallest class has a single row is left out.
    """
    out = None
    for rule, expr in (("left_closed", bin_label(F.col(label))), ("inclusive", bin_label_inclusive(F.col(label)))):
        rows = df.withColumn("actual_label", expr).where(F.col("actual_label").isNotNull())
        folds = safe_k(rows, "actual_label", k).first()["k"]
        if not folds:
            continue
        folded = stratified_kfold(rows.select(*key, "actual_label", *features), "actual_label", folds, seed, list(key))
        forest_pred = predict_labels(folded, features, labels, **forest).select("actual_label", "predicted_label")
        dummy_pred = dummy_majority_cv(folded, "fold", "actual_label").select("actual_label", "predicted_label")
        both = forest_pred.withColumn("model", F.lit("RandomForest")).unionByName(
            dummy_pred.withColumn("model", F.lit("DummyMajority")))
        scores = accuracy_and_macro_f1(both, labels, ["model"]).withColumn("rule", F.lit(rule))
        out = scores if out is None else out.unionByName(scores)
    if out is None:
        raise ValueError("no label rule leaves two rows in every class")
    return out.select("rule", "model", "accuracy", "macro_f1")
