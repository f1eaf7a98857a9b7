"""Feature views relative to each subject's baseline task.

Views have hundreds of generated columns. They are computed in long form, one row per subject,
task and feature, so that a few expressions serve any number of features, and turned wide at
the end. Grouping by (subject, feature) also spreads a subject that holds many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import BASELINE_TASK, TASK_FAMILIES, safe_name, signed_log1p, task_family
from .quantiles import quantile_agg
from .scale import attach

STATS = ("median", "mean", "std", "iqr")


def _long(df: DataFrame, features: list[str], order: tuple[str, ...], subject: str, task: str) -> DataFrame:
    """subject, task, order columns, feature, value."""
    ids = list(dict.fromkeys([subject, task, *order]))
    rows = df.selectExpr(*[f"`{c}`" for c in ids], *[f"CAST(`{f}` AS DOUBLE) AS `{f}`" for f in features])
    return rows.unpivot(ids, features, "feature", "value")


def _wide(df: DataFrame, subject: str, key: str, names: dict[str, list[str]], values: list[str]) -> DataFrame:
    """One row per subject; ``names`` gives, per value of ``key``, the column name of each of ``values``."""
    cells = [F.first(v).alias(f"v{i}") for i, v in enumerate(values)]
    wide = df.groupBy(subject).pivot(key, list(names)).agg(*cells)
    # a pivot with a single aggregate does not add the aggregate's name
    given = [[k if len(values) == 1 else f"{k}_v{i}" for i in range(len(values))] for k in names]
    found = wide.select(subject, *[f"`{g}`" for gs in given for g in gs])
    return found.toDF(subject, *[n for ns in names.values() for n in ns])


def _baselines(df: DataFrame, long: DataFrame, baseline: str, order: tuple[str, ...], subject: str, task: str) -> DataFrame:
    """(subject, feature, base, has_baseline, others): the baseline task's value, else the subject's own
    median, and the number of rows of other tasks.

    A subject with a baseline row keeps that row's value even where it is missing.
    """
    is_base = F.col(task) == baseline
    place = F.when(is_base, F.struct(*(order or (task,))))
    table = quantile_agg(long, [subject, "feature"], {"_med": ("value", 0.5)}, [
        F.min_by(F.struct("value"), place).alias("_row"), F.count_if(is_base).alias("_n"),
        F.count_if(~is_base).alias("others")], sized_by=(df, [subject]))
    has = F.col("_n") > 0
    return table.select(subject, "feature", F.when(has, F.col("_row.value")).otherwise(F.col("_med")).alias("base"),
                        has.alias("has_baseline"), "others")


def baseline_lookup(df: DataFrame, features: list[str], baseline: str = BASELINE_TASK, order: tuple[str, ...] = (),
                    subject: str = "subject", task: str = "task") -> DataFrame:
    """One row per subject: the baseline of every feature, and whether it is a baseline-task row."""
    base = _baselines(df, _long(df, features, order, subject, task), baseline, order, subject, task)
    wide = _wide(base, subject, "feature", {f: [f] for f in features}, ["base"])
    has = base.groupBy(subject).agg(F.bool_or("has_baseline").alias("has_baseline"))
    return wide.join(has, subject)


def differences(df: DataFrame, features: list[str], baseline: str = BASELINE_TASK, order: tuple[str, ...] = (),
                subject: str = "subject", task: str = "task") -> DataFrame:
    """Long rows with ``base`` and the plain and signed-log difference from it."""
    long = _long(df, features, order, subject, task)
    placed = attach(long, _baselines(df, long, baseline, order, subject, task), [subject, "feature"])
    return placed.withColumns({
        "delta": F.col("value") - F.col("base"),
        "log_delta": signed_log1p(F.col("value")) - signed_log1p(F.col("base")),
    })


def _four(source: str) -> tuple[dict[str, tuple[str, float]], list[Column]]:
    return ({f"{source}_median": (source, 0.5), f"_q1_{source}": (source, 0.25), f"_q3_{source}": (source, 0.75)},
            [F.avg(source).alias(f"{source}_mean"), F.stddev_pop(source).alias(f"{source}_std")])


def _summary(df: DataFrame, rows: DataFrame, features: list[str], subject: str, task: str, sources: dict[str, str],
             extra: dict[str, Column]) -> DataFrame:
    """Four statistics of each source per subject and feature, wide; ``sources``: column -> name prefix."""
    quantiles, others = {}, []
    for s in sources:
        q, o = _four(s)
        quantiles |= q
        others += o
    table = quantile_agg(rows, [subject, "feature"], quantiles, [*others, *[c.alias(k) for k, c in extra.items()]],
                         sized_by=(df, [subject]))
    table = table.withColumns({f"{s}_iqr": F.col(f"_q3_{s}") - F.col(f"_q1_{s}") for s in sources})
    values = [f"{s}_{k}" for s in sources for k in STATS] + list(extra)
    names = {f: [f"{p}_{k}__{f}" for p in sources.values() for k in STATS] + [f"{k}__{f}" for k in extra] for f in features}
    return _wide(table, subject, "feature", names, values).join(_stimuli(df, subject, task), subject)


def _stimuli(df: DataFrame, subject: str, task: str) -> DataFrame:
    return df.groupBy(subject).agg(F.count_distinct(task).alias("meta_num_stimuli"))


def raw_summary(df: DataFrame, features: list[str], subject: str = "subject", task: str = "task") -> DataFrame:
    """Median, mean, std (ddof 0) and IQR of the signed-log features, and the task count."""
    logged = _long(df, features, (), subject, task).withColumn("raw", signed_log1p(F.col("value")))
    return _summary(df, logged, features, subject, task, {"raw": "raw"}, {})


def baseline_relative(df: DataFrame, features: list[str], baseline: str = BASELINE_TASK,
                      order: tuple[str, ...] = (), subject: str = "subject", task: str = "task") -> DataFrame:
    """Statistics of the difference from the baseline, plain and signed-log, and the baseline itself.

    Rows of the baseline task are left out, unless a subject has no other.
    """
    rows = differences(df, features, baseline, order, subject, task) \
        .where((F.col(task) != baseline) | (F.col("others") == 0))
    return _summary(df, rows, features, subject, task, {"delta": "delta", "log_delta": "log_delta"},
                    {"baseline_log": signed_log1p(F.first("base"))})


def family_relative(df: DataFrame, features: list[str], families: list = TASK_FAMILIES,
                    baseline: str = BASELINE_TASK, order: tuple[str, ...] = (), subject: str = "subject",
                    task: str = "task") -> DataFrame:
    """Median difference per task family, one set of columns per family."""
    known = sorted({f for _, f in families if f != "baseline"} | {"other"})
    rows = differences(df, features, baseline, order, subject, task) \
        .withColumn("_key", F.concat_ws("__", task_family(F.col(task), families, baseline), "feature"))
    table = quantile_agg(rows, [subject, "_key"], {k: (k, 0.5) for k in ("delta", "log_delta")}, sized_by=(df, [subject]))
    names = {f"{fam}__{f}": [f"family_{fam}_delta_median__{f}", f"family_{fam}_log_delta_median__{f}"]
             for fam in known for f in features}
    return _wide(table, subject, "_key", names, ["delta", "log_delta"]).join(_stimuli(df, subject, task), subject)


def taskwide_relative(df: DataFrame, features: list[str], tasks: list[str], baseline: str = BASELINE_TASK,
                      order: tuple[str, ...] = (), subject: str = "subject", task: str = "task") -> DataFrame:
    """One signed-log difference per task and feature; of repeated task rows the last one counts."""
    rows = differences(df, features, baseline, order, subject, task) \
        .withColumn("_key", F.concat_ws("__", safe_name(F.col(task)), "feature"))
    last = F.max_by(F.struct("log_delta"), F.struct(*(order or (task,))))
    table = rows.groupBy(subject, "_key").agg(last.alias("_row")).select(subject, "_key", "_row.log_delta")
    wanted = [t.replace(" ", "_") for t in tasks if t != baseline]
    names = {f"{t}__{f}": [f"task_{t}_log_delta__{f}"] for t in wanted for f in features}
    return _wide(table, subject, "_key", names, ["log_delta"]).join(_stimuli(df, subject, task), subject)
