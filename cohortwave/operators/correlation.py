"""Correlation of features with each other and with the label."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_corr
from ..functions.tails import pearson_p
from .products import TILE, matrix_sums, tile_sums
from .quantiles import quantile_agg
from .segments import first_known

CONSTANT = 1e-13  # spread below this share of the mean is rounding of a constant column


def pair_products(block: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Kernel for tile_sums: counts, sums, squares and products of every pair of columns, each over the rows that have both."""
    seen, there = (~np.isnan(x) for x in (block, other))
    x, y = np.where(seen, block, 0.0), np.where(there, other, 0.0)
    seen, there = seen.astype(float), there.astype(float)
    return np.concatenate([m.ravel() for m in (seen.T @ there, x.T @ there, seen.T @ y, (x * x).T @ there, seen.T @ (y * y), x.T @ y)])


def _pairwise(df: DataFrame, cols: list[str], tile: int = TILE) -> DataFrame:
    """Long (a, b, r) over all ordered pairs of columns from one scan, summed and solved tile by tile."""
    means = df.agg(*[F.expr(f"avg(`{c}`)") for c in cols]).first()
    centre = np.array([0.0 if m is None else float(m) for m in means])
    rows = df.selectExpr(*[f"CAST(`{c}` AS DOUBLE) - ({float(m)!r}D) AS x{i}" for i, (c, m) in enumerate(zip(cols, centre))])
    sums = tile_sums(rows, [f"x{i}" for i in range(len(cols))], pair_products, tile)
    names = np.array(cols, object)

    def run(batches):
        for pdf in batches:
            for i, j, values in zip(pdf["i"], pdf["j"], pdf["values"]):
                own, other = slice(i * tile, (i + 1) * tile), slice(j * tile, (j + 1) * tile)
                a, b = names[own], names[other]
                n, s, t, q, u, p = np.asarray(values, float).reshape(6, len(a), len(b))
                with np.errstate(divide="ignore", invalid="ignore"):
                    x, y = q - s * s / n, u - t * t / n  # spreads of either column over the rows that have both
                    r = (p - s * t / n) / np.sqrt(x * y)
                flat = (x <= n * (CONSTANT * np.abs(centre[own])[:, None]) ** 2) | (y <= n * (CONSTANT * np.abs(centre[other])[None, :]) ** 2)
                r = pd.Series(r.ravel()).where(pd.Series(((n >= 2) & ~flat & np.isfinite(r)).ravel()), None)
                yield pd.DataFrame({"a": np.repeat(a, len(b)), "b": np.tile(b, len(a)), "r": r})
                if i != j:
                    yield pd.DataFrame({"a": np.tile(b, len(a)), "b": np.repeat(a, len(b)), "r": r})

    return sums.mapInPandas(run, "a string, b string, r double")


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Full symmetric matrix in long form."""
    return _pairwise(df, cols)


def _long(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """One row per feature value: a handful of sums per key then does for any number of features."""
    rows = df.selectExpr(*[f"`{c}`" for c in ids], *[f"CAST(`{f}` AS DOUBLE) AS `{f}`" for f in features])
    return rows.unpivot(ids, features, "feature", "_x")


def corr_with_target(df: DataFrame, features: list[str], label: str = "hours") -> DataFrame:
    long = _long(df.withColumn("_y", F.col(label)), ["_y"], features)
    return long.groupBy("feature").agg(safe_corr(F.col("_x"), F.col("_y")).alias("r")).orderBy("r", "feature")


def corr_strength(corr: DataFrame, cuts: tuple[float, ...] = (0.20, 0.30, 0.40)) -> DataFrame:
    """Median |r| and the number of features at or above each cut."""
    size = corr.withColumn("_abs", F.abs("r"))
    return quantile_agg(size, [], {"median_abs_r": ("_abs", 0.5)},
                        [F.count_if(F.col("_abs") >= c).alias(f"n_ge_{int(c * 100)}") for c in cuts])


def corr_block(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    r = _pairwise(df, [*left, *right]).where(F.col("a").isin(left) & F.col("b").isin(right))
    return r.select(F.col("a").alias("feature"), F.col("b").alias("metric"), "r")


def corr_block_region(block: DataFrame, regions: dict[str, list[str]]) -> DataFrame:
    """The block with a region per feature; a feature belongs to each region with a sensor in its name."""
    hits = [F.when(reduce(lambda a, b: a | b, [F.col("feature").contains(s) for s in sensors]), region)
            for region, sensors in regions.items()]
    return block.withColumn("region", F.explode(F.array_compact(F.array(*hits))))


def corr_by_group(df: DataFrame, by: str, features: list[str], label: str = "hours", min_n: int = 5) -> DataFrame:
    long = _long(df, [by, label], features)
    return (long.groupBy(by, "feature").agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("_x"), F.col(label)).alias("r"))
            .where(F.col("n") > min_n))


def task_corr(df: DataFrame, features: list[str], label: str = "hours", min_n: int = 10,
              subject: str = "subject", task: str = "task", with_p: bool = True) -> DataFrame:
    """Per task and feature: r with the label over subjects that have every feature."""
    means = df.groupBy(task, subject).agg(*[F.avg(f).alias(f) for f in features],
                                          first_known(label, [label]).alias(label))
    whole = _long(means.dropna(subset=[*features, label]), [task, label], features)
    long = (whole.groupBy(task, "feature")
            .agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("_x"), F.col(label)).alias("r"))
            .where(F.col("n") >= min_n))
    return long.withColumn("p", pearson_p(F.col("r"), F.col("n"))) if with_p else long


def band_heatmap(corr: DataFrame, bands: list[str], task: str = "task", band: str = "band") -> DataFrame:
    return corr.groupBy(task).pivot(band, bands).agg(F.avg("r"))


def order_by_row_max(df: DataFrame, cols: list[str], out: str = "max_abs") -> DataFrame:
    """Rows ordered by their largest absolute value, missing cells left out."""
    sizes = [F.abs(c) for c in cols]
    largest = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    return df.withColumn(out, largest).orderBy(out)


def ols_line(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return both.agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"),
                    F.count(F.lit(1)).alias("n"))
