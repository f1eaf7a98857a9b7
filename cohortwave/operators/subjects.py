"""Subject-level tables, lookups on them and simple counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import GENDER_CODES, bin_label, bin_label_inclusive, clean_key, code_map, row_mean
from .agglomerate import leaf_order, ward
from .quantiles import quantile_agg
from .scale import attach, materialise, running_counts, settle
from .segments import first_known


def enrich_inner(df: DataFrame, lookup: DataFrame, task: str = "task", key: str = "task") -> DataFrame:
    """Inner join on the cleaned task name; a repeated lookup key repeats the row."""
    keyed = lookup.withColumn("_key", clean_key(F.col(key))).drop(key)
    return attach(df.withColumn("_key", clean_key(F.col(task))), keyed, ["_key"]).drop("_key")


def enrich_subject(df: DataFrame, meta: DataFrame, subject: str = "subject") -> DataFrame:
    return attach(df, meta, [subject])


def join_aggregates(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left")


def align(targets: DataFrame, view: DataFrame, subject: str = "subject") -> DataFrame:
    return targets.join(view, subject, "inner")


def combine_views(views: dict[str, DataFrame], subject: str = "subject") -> DataFrame:
    """Outer join of views on subject, columns prefixed with the view's name."""
    combined = None
    for name, view in views.items():
        named = view.withColumnsRenamed({c: f"{name}__{c}" for c in view.columns if c != subject})
        combined = named if combined is None else combined.join(named, subject, "full_outer")
    return combined


def subject_mean(df: DataFrame, features: list[str], label: str = "hours", order: tuple[str, ...] = ("task",),
                 subject: str = "subject", others: list[Column] = ()) -> DataFrame:
    return df.groupBy(subject).agg(*[F.avg(f).alias(f) for f in features],
                                   first_known(label, list(order)).alias(label), *others)


def subject_mean_gender(df: DataFrame, features: list[str], label: str = "hours", gender: str = "gender",
                        codes: dict = GENDER_CODES, order: tuple[str, ...] = ("task",),
                        subject: str = "subject") -> DataFrame:
    table = subject_mean(df, features, label, order, subject,
                         [first_known(gender, list(order)).alias(gender)])
    return table.withColumn(gender, code_map(F.col(gender), codes))


def subject_mean_tasks(df: DataFrame, features: list[str], tasks: list[str], label: str = "hours",
                       order: tuple[str, ...] = ("task",), subject: str = "subject") -> DataFrame:
    return subject_mean(df.where(F.col("task").isin(tasks)), features, label, order, subject)


def coverage(df: DataFrame, features: list[str], subject: str = "subject") -> DataFrame:
    """Subjects in a subject table and missing cells in it."""
    gaps = sum((F.count_if(F.col(f).isNull()) for f in features), F.lit(0))
    return df.agg(F.count_distinct(subject).alias("subjects"), gaps.cast("long").alias("missing_values"))


def distinct_counts(df: DataFrame, subject: str = "subject", task: str = "task") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(subject).alias("subjects"),
                  F.count_distinct(task).alias("tasks"), F.count_distinct(subject, task).alias("pairs"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.desc("count"), col)


def distinct_members(df: DataFrame, by: str, col: str) -> DataFrame:
    """The distinct values per group as one sorted text; the values are a bounded list of names."""
    pairs = df.where(F.col(col).isNotNull()).select(by, col).distinct()
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias("members"),
                                 F.array_join(F.sort_array(F.collect_list(col)), ", ").alias("names"))


def describe_target(df: DataFrame, label: str = "hours") -> DataFrame:
    """One row: moments of the label and class sizes under both label rules."""
    x = F.col(label)
    left_closed, inclusive = bin_label(x), bin_label_inclusive(x)
    counts = [F.count_if(rule == name).alias(f"{tag}_{name.lower()}")
              for tag, rule in (("left_closed", left_closed), ("inclusive", inclusive))
              for name in ("Short", "Normal", "Long")]
    return quantile_agg(df, [], {"median": (label, 0.5)}, [
        F.count(label).alias("n"), F.avg(label).alias("mean"), F.stddev_samp(label).alias("std"),
        F.min(label).alias("min"), F.max(label).alias("max"), *counts])


def subject_targets(df: DataFrame, label: str = "hours", task: str = "task", subject: str = "subject") -> DataFrame:
    return df.groupBy(subject).agg(first_known(label, [task]).alias(label),
                                   F.count_distinct(task).alias("num_stimuli"))


def group_rollup(df: DataFrame, keys: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """Per key and column group (band or channel): the mean of the column means."""
    columns = sorted({c for cols in groups.values() for c in cols})
    means = df.groupBy(*keys).agg(*[F.expr(f"avg(`{c}`) AS `{c}`") for c in columns])
    return means.select(*keys, *[row_mean(*cols).alias(g) for g, cols in groups.items()])


def dense_grid_median(df: DataFrame, groups: list[str], subject: str = "subject", task: str = "task",
                      fill: float | None = 0.0) -> DataFrame:
    """Median per task over all subjects, where a subject without the task counts as ``fill``.

    Values are counted, and the absent cells of a task are one more count of ``fill``: no cell is made up. With
    ``fill=None`` absent cells stay out.
    """
    if fill is None:
        return quantile_agg(df, [task], {g: (g, 0.5) for g in groups})
    df = materialise(df)
    total = df.select(subject).distinct().count()
    fill = float(fill)
    cells = F.inline(F.array(*[F.struct(F.lit(g).alias("_g"), F.coalesce(F.col(g).cast("double"), F.lit(fill)).alias("_x")) for g in groups]))
    present = df.select(task, cells).groupBy(task, "_g", "_x").agg(F.count(F.lit(1)).alias("_c"))
    seen = df.select(task, subject).distinct().groupBy(task).agg(F.count(F.lit(1)).alias("_seen"))
    absent = seen.select(task, F.explode(F.array(*[F.lit(g) for g in groups])).alias("_g"), F.lit(fill).alias("_x"),
                         (F.lit(total) - F.col("_seen")).alias("_c")).where("_c > 0")
    keys = [task, "_g"]
    counts = settle(present.unionByName(absent).groupBy(*keys, "_x").agg(F.sum("_c").alias("_c")))
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ordered = attach(running_counts(counts, keys, "_x", ["_c"]), sizes, keys)

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_c_before") <= position) & (position < F.col("_c_before") + F.col("_c")), F.col("_x")))

    middle = (F.col("_n") - 1) / F.lit(2)
    medians = ordered.groupBy(*keys).agg(((at(F.floor(middle)) + at(F.ceil(middle))) / 2).alias("_m"))
    return medians.groupBy(task).agg(*[F.max(F.when(F.col("_g") == g, F.col("_m"))).alias(g) for g in groups])


def _order(names: list[str], points: np.ndarray) -> list[str]:
    return [names[i] for i in leaf_order(len(names), ward(np.ones(len(names)), points))]


def map_order(df: DataFrame, metrics: list[str], subject: str = "subject", task: str = "task") -> DataFrame:
    """Long (subject, axis, name, position): where the rows (``task``) and columns (``metric``) of a subject's clustered map stand.

    A subject's map is its table of mean metrics by task. Metrics without any value and then tasks with a missing one are left out; what is left is
    scaled to 0-1 per metric, and both sides are ordered as the leaves of their Ward tree. Equal distances go by name. A subject with fewer than two
    tasks or metrics has no map. One subject's map, as many cells as it has tasks and metrics, is held at once.
    """
    means = df.groupBy(subject, task).agg(*[F.avg(m).alias(m) for m in metrics])
    maps = means.where(F.col(task).isNotNull()).groupBy(subject).agg(F.array_sort(F.collect_list(F.struct(
        F.col(task).cast("string").alias("name"), F.array(*[F.col(f"`{m}`").cast("double") for m in metrics]).alias("x")))).alias("map"))

    def run(batches):
        for pdf in batches:
            out = []
            for key, rows in zip(pdf[subject], pdf["map"]):
                names = [r["name"] for r in rows]
                x = np.array([[np.nan if v is None else v for v in r["x"]] for r in rows], float)
                some = ~np.isnan(x).all(axis=0)
                whole = ~np.isnan(x[:, some]).any(axis=1)
                x = x[whole][:, some]
                if x.shape[0] < 2 or x.shape[1] < 2:
                    continue
                span = x.max(axis=0) - x.min(axis=0)
                x = (x - x.min(axis=0)) / np.where(span > 0, span, 1.0)
                tasks, kept = [n for n, w in zip(names, whole) if w], [m for m, k in zip(metrics, some) if k]
                by_name = np.argsort(kept)
                columns = _order([kept[i] for i in by_name], x.T[by_name])
                out += [(key, "task", n, i) for i, n in enumerate(_order(tasks, x))] + [(key, "metric", n, i) for i, n in enumerate(columns)]
            yield pd.DataFrame(out, columns=[subject, "axis", "name", "position"])

    return maps.mapInPandas(run, f"`{subject}` {dict(df.dtypes)[subject]}, axis string, name string, position int")


def metric_by_task(df: DataFrame, metrics: list[str], subject: str = "subject", task: str = "task") -> DataFrame:
    """Mean metric per subject and task, and the same scaled to 0-1 within the subject."""
    means = df.groupBy(subject, task).agg(*[F.avg(m).alias(m) for m in metrics])
    spans = means.groupBy(subject).agg(*[F.min(m).alias(f"_min_{m}") for m in metrics],
                                       *[F.max(m).alias(f"_max_{m}") for m in metrics])
    scaled = {f"{m}_scaled": F.try_divide(F.col(m) - F.col(f"_min_{m}"), F.col(f"_max_{m}") - F.col(f"_min_{m}"))
              for m in metrics}
    return (attach(means, spans, [subject]).withColumns(scaled)
            .drop(*[f"_min_{m}" for m in metrics], *[f"_max_{m}" for m in metrics]))


def run_summary(df: DataFrame, features: list[str], subject: str = "subject", task: str = "task") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(subject).alias("subjects"),
                  F.count_distinct(task).alias("tasks"), F.lit(len(features)).cast("long").alias("features"))


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows and non-missing values."""
    types = dict(df.dtypes)
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in types])
    long = counts.unpivot(["_rows"], list(types), "column_name", "non_null")
    kind = F.create_map(*[F.lit(v) for pair in types.items() for v in pair])
    return long.select("column_name", kind[F.col("column_name")].alias("type"), F.col("_rows").alias("rows"), "non_null")


def concat_rows(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name; a column a frame lacks is missing there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)
