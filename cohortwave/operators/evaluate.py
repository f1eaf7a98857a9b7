"""Scores, votes and reports over prediction tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_corr
from .quantiles import quantile_agg


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 on an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def regression_metrics(pred: DataFrame, by: list[str] = (), actual: str = "actual",
                       predicted: str = "predicted") -> DataFrame:
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"))


def fold_metrics(pred: DataFrame, positive, fold: str = "fold", actual: str = "actual_label",
                 predicted: str = "predicted_label") -> DataFrame:
    return binary_metrics(pred, positive, [fold], actual, predicted)


def null_baseline(pred: DataFrame, by: list[str] = (), actual: str = "actual",
                  predicted: str = "predicted") -> DataFrame:
    """RMSE of always saying the mean (the ddof-0 spread of the actuals) and the gain over it."""
    e = F.col(actual) - F.col(predicted)
    rmse, null = F.sqrt(F.avg(e * e)), F.stddev_pop(actual)
    return pred.groupBy(*by).agg(null.alias("null_rmse"), rmse.alias("rmse"), (null - rmse).alias("gain"))


def prediction_range(pred: DataFrame, by: list[str] = (), actual: str = "actual",
                     predicted: str = "predicted") -> DataFrame:
    return pred.groupBy(*by).agg(safe_corr(F.col(actual), F.col(predicted)).alias("pearson_r"),
                                 F.min(predicted).alias("prediction_min"), F.max(predicted).alias("prediction_max"))


def binary_metrics(pred: DataFrame, positive, by: list[str] = (), actual: str = "actual_label",
                   predicted: str = "predicted_label") -> DataFrame:
    a, p = F.col(actual) == positive, F.col(predicted) == positive
    hit, said, there = F.count_if(a & p), F.count_if(p), F.count_if(a)
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"),
        _ratio(hit, said).alias("precision"), _ratio(hit, there).alias("recall"),
        _ratio(2 * hit, said + there).alias("f1"))


def classification_report(pred: DataFrame, labels: list[str], by: list[str] = (), actual: str = "actual_label",
                          predicted: str = "predicted_label") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted rows.

    One aggregate row per group of three counts per label is turned into the report, so a
    class nobody predicted still has its row.
    """
    a, p = F.col(actual), F.col(predicted)
    counts = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(a == p).alias("_right"),
        *[c for i, x in enumerate(labels) for c in (
            F.count_if((a == x) & (p == x)).alias(f"_hit{i}"), F.count_if(p == x).alias(f"_said{i}"),
            F.count_if(a == x).alias(f"_there{i}"))])
    rows = []
    for i, x in enumerate(labels):
        hit, said, there = F.col(f"_hit{i}"), F.col(f"_said{i}"), F.col(f"_there{i}")
        rows.append((F.lit(x), _ratio(hit, said), _ratio(hit, there), _ratio(2 * hit, said + there), there))

    def struct(name, precision, recall, f1, support):
        return F.struct(name.alias("label"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), support.cast("long").alias("support"))

    support = sum((r[4] for r in rows), F.lit(0))

    def macro(j: int) -> Column:
        return sum((r[j] for r in rows), F.lit(0.0)) / len(rows)

    def weighted(j: int) -> Column:
        return _ratio(sum((r[j] * r[4] for r in rows), F.lit(0.0)), support)

    accuracy = _ratio(F.col("_right"), F.col("_n"))
    report = F.array(*[struct(*r) for r in rows],
                     struct(F.lit("accuracy"), accuracy, accuracy, accuracy, F.col("_n")),
                     struct(F.lit("macro avg"), macro(1), macro(2), macro(3), support),
                     struct(F.lit("weighted avg"), weighted(1), weighted(2), weighted(3), support))
    return counts.select(*by, F.inline(report))


def accuracy_and_macro_f1(pred: DataFrame, labels: list[str], by: list[str] = (), actual: str = "actual_label",
                          predicted: str = "predicted_label") -> DataFrame:
    report = classification_report(pred, labels, by, actual, predicted)
    row = F.col("label")
    return report.groupBy(*by).agg(F.max(F.when(row == "accuracy", F.col("f1"))).alias("accuracy"),
                                   F.max(F.when(row == "macro avg", F.col("f1"))).alias("macro_f1"))


def confusion_matrix(pred: DataFrame, labels: list[str], actual: str = "actual_label",
                     predicted: str = "predicted_label") -> DataFrame:
    """Counts for every pair of labels, 0 included: one row per actual label."""
    a, p = F.col(actual), F.col(predicted)
    rows = F.array(*[
        F.struct(F.lit(x).alias("actual"), *[F.count_if((a == x) & (p == y)).alias(f"pred_{y}") for y in labels])
        for x in labels])
    return pred.agg(rows.alias("rows")).select(F.inline("rows"))


def majority_vote(pred: DataFrame, key: list[str], labels: list[str], label: str = "predicted_label",
                  scores: dict[str, str] | None = None, others: list[Column] = ()) -> DataFrame:
    """One label per key by number of votes; ties go to the larger score sum, then to the first label.

    ``scores`` maps a label to the column with its probability (or earlier votes); votes are
    kept as ``votes_<label>``. Everything is one aggregate over the rows.
    """
    mass = {x: F.sum(scores[x]) if scores else F.lit(0.0) for x in labels}
    votes = pred.groupBy(*key).agg(
        *[F.count_if(F.col(label) == x).alias(f"votes_{x}") for x in labels],
        *[mass[x].alias(f"_mass_{x}") for x in labels], *others)
    ranked = F.array_sort(F.array(*[
        F.struct((-F.col(f"votes_{x}")).alias("v"), (-F.coalesce(F.col(f"_mass_{x}"), F.lit(0.0))).alias("m"),
                 F.lit(x).alias("label")) for x in labels]))
    return votes.withColumn(label, F.get(ranked, F.lit(0))["label"]).drop(*[f"_mass_{x}" for x in labels])


def vote_rank(votes: DataFrame, key: list[str], label: str, count: str, mass: str) -> DataFrame:
    """The winning class row of each key; a key has at most one row per class."""
    order = Window.partitionBy(*key).orderBy(F.desc(count), F.desc(mass), label)
    return votes.withColumn("_place", F.row_number().over(order)).where(F.col("_place") == 1).drop("_place")


def two_stage_vote(pred: DataFrame, segment: list[str], subject: list[str], labels: list[str],
                   scores: dict[str, str] | None = None, label: str = "predicted_label",
                   carry: tuple[str, ...] = ("actual_label",)) -> tuple[DataFrame, DataFrame]:
    """Windows vote on their segment, segments on their subject; second ties by the summed first votes."""
    kept = [F.min(c).alias(c) for c in carry]
    first = majority_vote(pred, segment, labels, label, scores, [*kept, F.count(F.lit(1)).alias("num_windows")])
    second = majority_vote(first.withColumnsRenamed({f"votes_{x}": f"_first_{x}" for x in labels}), subject, labels,
                           label, {x: f"_first_{x}" for x in labels},
                           [*kept, F.count(F.lit(1)).alias("num_stimuli"), F.sum("num_windows").alias("num_windows")])
    return first, second


def subject_aggregate(pred: DataFrame, subject: str = "subject", actual: str = "actual",
                      predicted: str = "predicted") -> DataFrame:
    """Mean and median of a subject's segment predictions."""
    return quantile_agg(pred, [subject], {"median_prediction": (predicted, 0.5)}, [
        F.avg(predicted).alias("mean_prediction"), F.min(actual).alias("actual"),
        F.count(F.lit(1)).alias("num_stimuli")])


def outcome_table(subjects: DataFrame, actual: str = "actual_label", predicted: str = "predicted_label") -> DataFrame:
    return subjects.withColumn("correct", F.col(actual) == F.col(predicted))


def prediction_crosstab(pred: DataFrame, task: str = "task", actual: str = "actual_label",
                        predicted: str = "predicted_label") -> DataFrame:
    return pred.groupBy(task, actual, predicted).count().orderBy(task, actual, predicted)


def prediction_by_task(pred: DataFrame, labels: list[str], task: str = "task",
                       predicted: str = "predicted_label") -> DataFrame:
    """Counts per task with one column per label, 0 included."""
    return pred.groupBy(task).agg(*[F.count_if(F.col(predicted) == x).alias(x) for x in labels]).orderBy(task)


def leaderboard(metrics: DataFrame, descending: list[str] = (), ascending: list[str] = ()) -> DataFrame:
    return metrics.orderBy(*[F.desc(c) for c in descending], *[F.asc(c) for c in ascending])


def pick_best(metrics: DataFrame, predictions: DataFrame, keys: list[str], descending: list[str],
              ascending: list[str]) -> DataFrame:
    """The predictions of the one best entry of a leaderboard."""
    best = metrics.orderBy(*[F.desc(c) for c in descending], *[F.asc(c) for c in ascending], *keys) \
        .limit(1).select(*keys)
    return predictions.join(F.broadcast(best), keys, "left_semi")


def threshold_table(scored: DataFrame, thresholds: list[float], by: list[str], score: str = "score",
                    positive: str = "is_positive") -> DataFrame:
    """F1, precision, recall and accuracy of ``score >= t`` for every threshold.

    Rows are counted once by how many thresholds they reach; each threshold's hits are sums of
    those few counts.
    """
    cuts = sorted(thresholds)
    reached = reduce(lambda a, b: a + b, [(F.col(score) >= t).cast("int") for t in cuts])
    p = F.col(positive).cast("boolean")
    counts = scored.groupBy(*by, reached.alias("_level")).agg(F.count_if(p).alias("_pos"), F.count_if(~p).alias("_neg"))
    return threshold_cells(counts, cuts, by)


def threshold_cells(counts: DataFrame, cuts: list[float], by: list[str]) -> DataFrame:
    """The same from (``_level``, ``_pos``, ``_neg``): rows of each class by how many of the sorted cuts they reach."""
    def cell(i: int, t: float) -> Column:
        above = F.col("_level") > i
        zero = F.lit(0)
        tp, fp = F.sum(F.when(above, F.col("_pos")).otherwise(zero)), F.sum(F.when(above, F.col("_neg")).otherwise(zero))
        there, rows = F.sum("_pos"), F.sum(F.col("_pos") + F.col("_neg"))
        return F.struct(F.lit(t).alias("threshold"), _ratio(2 * tp, tp + fp + there).alias("f1"),
                        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, there).alias("recall"),
                        _ratio(rows - there - fp + tp, rows).alias("accuracy"))

    return counts.groupBy(*by).agg(F.array(*[cell(i, t) for i, t in enumerate(cuts)]).alias("cells")) \
        .select(*by, F.inline("cells"))


def tune_threshold(scored: DataFrame, thresholds: list[float], by: list[str], outer: list[str],
                   score: str = "score", positive: str = "is_positive") -> DataFrame:
    """The best setting per outer fold by F1, recall and accuracy, then the smallest settings."""
    return best_threshold(threshold_table(scored, thresholds, by, score, positive), by, outer)


def best_threshold(table: DataFrame, by: list[str], outer: list[str]) -> DataFrame:
    settings = [c for c in by if c not in outer] + ["threshold"]
    order = F.struct(-F.col("f1"), -F.col("recall"), -F.col("accuracy"), *[F.col(c) for c in settings])
    best = F.min_by(F.struct(*settings, "f1", "precision", "recall", "accuracy"), order)
    return table.groupBy(*outer).agg(best.alias("b")).select(*outer, "b.*")
