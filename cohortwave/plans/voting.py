"""Subject-disjoint classification of segments or windows, with a vote per subject."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import (
    classification_report, confusion_matrix, majority_vote, outcome_table, prediction_by_task, prediction_crosstab,
    two_stage_vote,
)
from ..operators.folds import group_kfold, leave_one_group_out
from ..operators.models import cross_val_predict, rf_classifier, weigh_train
from ..operators.quality import require_groups
from ..operators.scale import materialise

SCHEMES = ("each", "groups")


@dataclass(frozen=True)
class Votes:
    rows: DataFrame        # out-of-fold prediction of every row, with p_<label>
    subjects: DataFrame    # one vote per subject
    report: DataFrame
    confusion: DataFrame
    crosstab: DataFrame
    by_task: DataFrame
    segments: DataFrame | None = None


def subject_folds(df: DataFrame, subject: str = "subject", scheme: str = "each", k: int = 10) -> DataFrame:
    """The caller's scheme, whatever the size of the cohort: a fold for ``each`` subject, or k folds of ``groups`` of them."""
    if scheme not in SCHEMES:
        raise ValueError(f"scheme is one of {SCHEMES}")
    return leave_one_group_out(df, subject) if scheme == "each" else group_kfold(df, subject, k)


def predict_labels(df: DataFrame, features: list[str], labels: list[str], fold: str = "fold",
                   pipeline: Pipeline | None = None, **forest) -> DataFrame:
    """Adds predicted_label and one probability column per label; ``df`` has actual_label."""
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("actual_label")) - 1
    rows = df.withColumn("_y", index.cast("double"))
    model = pipeline or rf_classifier(features, "_y", **forest)
    out = cross_val_predict(model, rows, fold, prepare=weigh_train("_y"))
    probability = vector_to_array("probability")
    named = F.get(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int"))
    return out.withColumn("_p", probability).select(
        *df.columns, named.alias("predicted_label"),
        *[F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)).alias(f"p_{x}") for i, x in enumerate(labels)])


def vote_cv(df: DataFrame, features: list[str], labels: list[str], subject: str = "subject", fold: str = "fold",
            segment: list[str] | None = None, pipeline: Pipeline | None = None, **forest) -> Votes:
    """``df`` has subject, task, actual_label, fold and the features; with ``segment`` windows vote twice."""
    require_groups(df, subject, 2)
    rows = materialise(predict_labels(df, features, labels, fold, pipeline, **forest))
    scores = {x: f"p_{x}" for x in labels}
    segments = None
    if segment:
        segments, subjects = two_stage_vote(rows, segment, [subject], labels, scores)
    else:
        others: list[Column] = [F.min("actual_label").alias("actual_label"), F.count(F.lit(1)).alias("num_stimuli")]
        subjects = majority_vote(rows, [subject], labels, scores=scores, others=others)
    subjects = outcome_table(subjects)
    return Votes(rows, subjects, classification_report(subjects, labels), confusion_matrix(subjects, labels),
                 prediction_crosstab(rows), prediction_by_task(rows, labels), segments)
