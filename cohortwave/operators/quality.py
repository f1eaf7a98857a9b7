"""Signal-quality rules on recordings, and rules about missing values."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import round_half_even, to_double
from .scale import attach

MIN_OVERALL_CQ = 0.7
MIN_CHANNEL_CQ = 2.0


@dataclass(frozen=True)
class QualitySpec:
    """Which columns carry the quality of a sample and what a good sample has."""

    subject: str = "subject"
    interpolated: str = "EEG_Interpolated"
    overall: str = "CQ_Overall"
    channels: list[str] = field(default_factory=list)
    min_overall: float = MIN_OVERALL_CQ
    min_channel: float = MIN_CHANNEL_CQ


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: to_double(F.col(c)) for c in cols})


def overall_cut(largest: Column, frac: float) -> Column:
    """The cut in the recording's own scale: 0-1 if its maximum is at most 1, else 0-100."""
    return F.when(largest <= 1.0, F.lit(frac)).otherwise(F.lit(frac * 100))


def adaptive_threshold(df: DataFrame, col: str, frac: float, by: str, out: str = "threshold") -> DataFrame:
    cuts = df.groupBy(by).agg(overall_cut(F.max(col), frac).alias(out))
    return attach(df, cuts, [by], "left")


def all_at_least(cols: list[str], threshold: float) -> Column:
    """True where every column reaches the threshold; a missing one fails."""
    tests = [F.coalesce(F.col(c) >= threshold, F.lit(False)) for c in cols]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def quality_mask(df: DataFrame, spec: QualitySpec, out: str = "ok") -> DataFrame:
    cut = adaptive_threshold(df, spec.overall, spec.min_overall, spec.subject, "_cut")
    ok = (F.coalesce(F.col(spec.interpolated) == 0, F.lit(False))
          & F.coalesce(F.col(spec.overall) >= F.col("_cut"), F.lit(False))
          & all_at_least(spec.channels, spec.min_channel))
    return cut.withColumn(out, ok).drop("_cut")


def drop_missing(df: DataFrame, cols: list[str], how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=cols)


def fill_missing(df: DataFrame, value, cols: list[str] | None = None) -> DataFrame:
    return df.fillna(value, subset=cols)


def drop_sparse(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Long (by, task rows..., metric, value): per subject the metrics with any value, on the
    rows without a gap in them, for subjects left with two rows and two metrics."""
    seen = df.groupBy(by).agg(*[(F.count(c) > 0).alias(f"_has_{c}") for c in cols])
    marked = attach(df, seen, [by])
    gap = reduce(lambda a, b: a | b, [F.col(f"_has_{c}") & F.col(c).isNull() for c in cols])
    whole = marked.where(~gap)
    width = sum((F.col(f"_has_{c}").cast("int") for c in cols), F.lit(0))
    keep = (whole.groupBy(by).agg(F.count(F.lit(1)).alias("_rows"), F.first(width).alias("_width"))
            .where((F.col("_rows") > 1) & (F.col("_width") > 1)).select(by))
    kept = attach(whole, keep, [by], "left_semi").drop(*[f"_has_{c}" for c in cols])
    ids = [c for c in df.columns if c not in cols]
    return kept.unpivot(ids, cols, "metric", "value").where(F.col("value").isNotNull())


def exclude_holdout(df: DataFrame, col: str, ids: list) -> DataFrame:
    return df.where(~F.col(col).isin(ids))


def select_subset(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """Rows whose trimmed, case-folded value is listed."""
    return df.where(F.upper(F.trim(F.col(col).cast("string"))).isin([v.strip().upper() for v in values]))


def split_by_threshold(df: DataFrame, col: str, cut: float, closed: str = "left") -> tuple[DataFrame, DataFrame]:
    """Rows below and above a cut; ``closed`` says which side the cut itself belongs to."""
    low = F.col(col) <= cut if closed == "left" else F.col(col) < cut
    high = F.col(col) > cut if closed == "left" else F.col(col) >= cut
    return df.where(low), df.where(high)


def reference_all_missing(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Groups in which the reference feature is missing on every row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("segment_rows"), F.count(col).alias("_c")) \
        .where(F.col("_c") == 0).drop("_c")


def require_groups(df: DataFrame, col: str, n: int, classes: str | None = None, min_classes: int = 2) -> DataFrame:
    """The frame itself, or an error if it has too few groups or classes."""
    wanted = [F.count_distinct(col).alias("groups")]
    if classes:
        wanted.append(F.count_distinct(classes).alias("classes"))
    found = df.agg(*wanted).first()
    if found["groups"] < n:
        raise ValueError(f"at least {n} distinct {col} values are needed, found {found['groups']}")
    if classes and found["classes"] < min_classes:
        raise ValueError(f"at least {min_classes} distinct {classes} values are needed, found {found['classes']}")
    return df


def _percent(test: Column) -> Column:
    return 100 * F.avg(F.coalesce(test, F.lit(False)).cast("double"))


def quality_report(df: DataFrame, spec: QualitySpec, digits: int = 2) -> DataFrame:
    """One row per recording: usable share, pass rates and mean contact per channel."""
    cut = adaptive_threshold(df, spec.overall, spec.min_overall, spec.subject, "_cut")
    clean = F.col(spec.interpolated) == 0
    overall = F.col(spec.overall) >= F.col("_cut")
    channels = all_at_least(spec.channels, spec.min_channel)
    both = (F.coalesce(clean, F.lit(False)) & F.coalesce(overall, F.lit(False)) & channels)
    measures = {
        "usable_pct": 100 * (1 - F.coalesce(F.sum(spec.interpolated), F.lit(0)) / F.count(F.lit(1))),
        "overall_cq": F.avg(spec.overall),
        "interpolated_pass_pct": _percent(clean),
        "overall_pass_pct": _percent(overall),
        "channels_pass_pct": _percent(channels),
        "retained_pct": _percent(both),
        **{f"mean_{c}": F.avg(c) for c in spec.channels},
    }
    return cut.groupBy(spec.subject).agg(*[round_half_even(m, digits).alias(n) for n, m in measures.items()])


def row_attrition(df: DataFrame, subject: str = "subject", ok: str = "ok") -> DataFrame:
    return df.groupBy(subject).agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(F.col(ok)).alias("clean_rows"))
