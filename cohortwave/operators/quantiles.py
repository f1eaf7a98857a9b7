"""Exact interpolated quantiles that hold for groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one buffer, which is the
right plan for a segment and the wrong one for a group of a billion rows. Groups above a bound
are answered in two passes that combine on the map side: an approximate quantile brackets the
wanted ranks, then only the values inside the bracket are counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import attach, fits_broadcast, hot_groups, materialise, running_counts, settle

QUANTILE_ROWS = 100_000  # rows of a group the built-in percentile may buffer

Quantiles = dict[str, tuple[str, float]]  # output name -> (column, share)


def quantile_agg(df: DataFrame, keys: list[str], quantiles: Quantiles,
                 others: list[Column] = (), limit: int = QUANTILE_ROWS,
                 sized_by: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """One row per group with exact quantiles and any further aggregates.

    ``sized_by`` names a cheaper frame and keys whose groups are at least as large as these:
    where none of those is large, the groups here need not be counted.
    """
    if not keys:
        return quantile_agg(df.withColumn("_all", F.lit(1)), ["_all"], quantiles, others, limit).drop("_all")
    built_in = [F.percentile(c, p).alias(out) for out, (c, p) in quantiles.items()]
    hot = hot_groups(*sized_by, limit) if sized_by else hot_groups(df, keys, limit)
    if hot is not None and sized_by:
        df = materialise(df)
        hot = hot_groups(df, keys, limit)
    if hot is None:
        return df.groupBy(*keys).agg(*built_in, *others)

    largest = hot.agg(F.max("_n")).first()[0]
    hot_keys = F.broadcast(hot.drop("_n")) if fits_broadcast(hot) else hot.drop("_n")
    cold = df.join(hot_keys, keys, "left_anti").groupBy(*keys).agg(*built_in, *others)
    hot_rows = df.join(hot_keys, keys, "left_semi")
    answer = _bracketed(hot_rows, keys, quantiles, largest, limit)
    if others:
        answer = answer.join(hot_rows.groupBy(*keys).agg(*others), keys, "inner")
    return cold.unionByName(answer)


def _bracketed(df: DataFrame, keys: list[str], quantiles: Quantiles, largest: int, limit: int) -> DataFrame:
    names = list(quantiles)
    accuracy = max(1_000, math.ceil(8 * largest / limit))
    slack = 2.0 / accuracy
    while True:
        answer, missed = _bracket_pass(df, keys, quantiles, accuracy, slack)
        if not missed:
            break
        slack *= 8
    return answer.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_q") == i, F.col("_value"))).alias(out) for i, out in enumerate(names)]
    )


def _bracket_pass(df: DataFrame, keys: list[str], quantiles: Quantiles, accuracy: int,
                  slack: float) -> tuple[DataFrame, bool]:
    specs = list(quantiles.values())
    infinity = F.lit(float("inf"))

    def bound(c: str, share: float) -> Column:
        if share <= 0 or share >= 1:
            return infinity if share >= 1 else -infinity
        return F.percentile_approx(c, share, accuracy).cast("double")

    bounds = df.groupBy(*keys).agg(
        *[bound(c, p - slack).alias(f"_lo{i}") for i, (c, p) in enumerate(specs)],
        *[bound(c, p + slack).alias(f"_hi{i}") for i, (c, p) in enumerate(specs)],
    )
    placed = attach(df, bounds, keys)
    ranks = settle(
        placed.groupBy(*keys).agg(
            F.array(*[
                F.struct(F.lit(i).alias("_q"), F.lit(float(p)).alias("_p"), F.count(c).alias("_n"),
                         F.count_if(F.col(c) < F.col(f"_lo{i}")).alias("_below"))
                for i, (c, p) in enumerate(specs)
            ]).alias("_r")
        ).select(*keys, F.inline("_r"))
    )
    inside = placed.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_q"),
                 F.when(F.col(c).between(F.col(f"_lo{i}"), F.col(f"_hi{i}")),
                        F.col(c).cast("double")).alias("_x"))
        for i, (c, _) in enumerate(specs)
    ]))).where(F.col("_x").isNotNull())
    counts = inside.groupBy(*keys, "_q", "_x").agg(F.count(F.lit(1)).alias("_c"))
    ordered = running_counts(counts, keys + ["_q"], "_x", ["_c"])
    ranked = attach(ordered, ranks, keys + ["_q"])
    first = F.col("_below") + F.col("_c_before")
    rank = F.col("_p") * (F.col("_n") - 1)

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position < first + F.col("_c")), F.col("_x")))

    picked = ranked.groupBy(*keys, "_q").agg(
        F.first("_p").alias("_p"), F.first("_n").alias("_n"),
        at(F.floor(rank)).alias("_v0"), at(F.ceil(rank)).alias("_v1"),
    )
    share = F.col("_p") * (F.col("_n") - 1) - F.floor(F.col("_p") * (F.col("_n") - 1))
    answer = settle(
        ranks.select(*keys, "_q", F.col("_n").alias("_total"))
        .join(picked, keys + ["_q"], "left")
        .select(*keys, "_q", "_total",
                (F.col("_v0") + share * (F.col("_v1") - F.col("_v0"))).alias("_value"))
    )
    missed = not answer.where((F.col("_total") > 0) & F.col("_value").isNull()).isEmpty()
    return answer, missed
