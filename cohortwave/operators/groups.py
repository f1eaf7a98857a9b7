"""Comparing groups: means, rank tests, effect sizes, similarity, histograms."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import exact_u_p, normal_p
from .products import matrix_sums
from .scale import GROUP_ROWS, attach, running_counts

EXACT_GROUP = 8


def _long(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """One row per feature value: a handful of sums per key then does for any number of features."""
    rows = df.selectExpr(*[f"`{c}`" for c in ids], *[f"CAST(`{f}` AS DOUBLE) AS `{f}`" for f in features])
    return rows.unpivot(list(ids), features, "feature", "_x")


def group_minmax(df: DataFrame, features: list[str], by: list[str] = ()) -> DataFrame:
    """Long (by, feature, min, max)."""
    return _long(df, by, features).groupBy(*by, "feature").agg(F.min("_x").alias("min"), F.max("_x").alias("max"))


def cluster_summary(df: DataFrame, cluster: str, label: str = "hours", subject: str = "subject",
                    distinct: bool = False) -> DataFrame:
    size = F.count_distinct(subject) if distinct else F.count(subject)
    return df.groupBy(cluster).agg(size.alias("n_subjects"), F.avg(label).alias("mean_label"),
                                   F.stddev_samp(label).alias("std_label"), F.min(label).alias("min_label"),
                                   F.max(label).alias("max_label"))


def group_mean_sem(df: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """Long (by, feature, mean, sem, n)."""
    x = F.col("_x")
    return _long(df, by, features).groupBy(*by, "feature").agg(
        F.avg(x).alias("mean"), F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x))).alias("sem"), F.count(x).alias("n"))


# Rising shares of the Poisson distribution of mean 1, up to 7
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183,
           0.9999167588507119, 0.9999897508033253)
PRIME = 2147483647


def bootstrap_weights(key: np.ndarray, times: int, seed: int) -> np.ndarray:
    """(row, draw) numbers of times each row is drawn, Poisson with mean 1, from integer keys below 2^31.

    The draws are whole-number arithmetic modulo a prime, so that any engine can repeat them.
    """
    b = np.arange(1, times + 1, dtype=np.int64)[None, :]
    x = (key.astype(np.int64)[:, None] * 48271 + b * 69621 + seed) % PRIME
    x = (x * x + 40014 * b) % PRIME
    x = (x * 16807 + x // 127773) % PRIME
    x = (x * x + x) % PRIME
    return np.searchsorted(np.array(POISSON), x / PRIME, side="right")


def bootstrap_mean(df: DataFrame, by: list[str], features: list[str], key: list[str], times: int = 1000, level: float = 0.68,
                   seed: int = 42) -> DataFrame:
    """Long (by, feature, mean, low, high, n): the mean and the middle ``level`` of its bootstrap distribution.

    Instead of drawing n of n rows, every row is drawn a Poisson number of times, which a hash of its ``key`` decides; so one
    scan adds up all ``times`` weighted sums and no row is copied or moved. Missing values count in no sum.
    """
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])), 1, 7), 16, 10).cast("double")
    rows = df.select(*by, number.alias("_key"), *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    count = len(features)

    def kernel(block: np.ndarray) -> np.ndarray:
        total = np.zeros((count, 2, times + 1))
        for low in range(0, len(block), 2048):
            part = block[low : low + 2048]
            weight = np.column_stack((np.ones(len(part)), bootstrap_weights(part[:, 0], times, seed)))
            seen = ~np.isnan(part[:, 1:])
            total[:, 0] += seen.T.astype(float) @ weight
            total[:, 1] += np.where(seen, part[:, 1:], 0.0).T @ weight
        return total.ravel()

    sums = matrix_sums(rows, by, ["_key", *[f"x{i}" for i in range(count)]], kernel)
    edge = (1 - level) / 2

    def finish(batches):
        for pdf in batches:
            out = []
            for key_, values in zip(pdf[by].itertuples(index=False), pdf["values"]):
                n, s = np.moveaxis(np.asarray(values, float).reshape(count, 2, times + 1), 1, 0)
                for i, f in enumerate(features):
                    means = s[i, 1:][n[i, 1:] > 0] / n[i, 1:][n[i, 1:] > 0]
                    low, high = np.quantile(means, (edge, 1 - edge)) if len(means) else (None, None)
                    out.append((*key_, f, s[i, 0] / n[i, 0] if n[i, 0] else None, low, high, int(n[i, 0])))
            yield pd.DataFrame(out, columns=[*by, "feature", "mean", "low", "high", "n"])

    types = dict(df.dtypes)
    spec = ", ".join(f"`{c}` {types[c]}" for c in by)
    return sums.mapInPandas(finish, f"{spec}, feature string, mean double, low double, high double, n long")


def pairwise_groups(df: DataFrame, group: str) -> DataFrame:
    """Every unordered pair of group names; the names are a short list."""
    names = df.select(group).where(F.col(group).isNotNull()).distinct()
    left, right = names.withColumnRenamed(group, "group1"), names.withColumnRenamed(group, "group2")
    return left.join(right, F.col("group1") < F.col("group2"), "inner")


def average_rank(df: DataFrame, keys: list[str], x: str, out: str = "rank", limit: int = GROUP_ROWS) -> DataFrame:
    """Mid-rank of x in its group: values are counted first, so ties and large groups stay cheap."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_counts(counts, keys, x, ["_n"], limit).select(
        *keys, x, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(out))
    return attach(df, ranks, [*keys, x], "left")


def mann_whitney(df: DataFrame, group: str, groups: list[str], features: list[str],
                 min_n: int = 3, limit: int = GROUP_ROWS) -> DataFrame:
    """U of the first group and a two-sided p for every feature and pair of groups.

    U needs only, per value, how many rows of the one group lie below and at it, so each
    feature is reduced to counts per value and read once for all pairs. The p is exact for a
    group of at most eight without ties, else normal with tie and continuity correction; it is
    1 where a group has fewer than ``min_n`` rows.
    """
    pairs = list(combinations(range(len(groups)), 2))
    long = _long(df.where(F.col(group).isin(groups)), [group], features).where(F.col("_x").isNotNull())
    sizes = [f"_n{i}" for i in range(len(groups))]
    counts = long.groupBy("feature", "_x").agg(
        *[F.count_if(F.col(group) == g).alias(n) for g, n in zip(groups, sizes)])
    running = running_counts(counts, ["feature"], "_x", sizes, limit)

    def cell(i: int, j: int):
        a, b = F.col(sizes[i]).cast("double"), F.col(sizes[j]).cast("double")
        ties = a + b
        return F.struct(
            F.lit(groups[i]).alias("group1"), F.lit(groups[j]).alias("group2"),
            F.sum(sizes[i]).alias("n1"), F.sum(sizes[j]).alias("n2"),
            F.sum(a * (F.col(f"{sizes[j]}_before") + b / 2)).alias("u"),
            F.sum(ties * ties * ties - ties).alias("_ties"),
        )

    tests = running.groupBy("feature").agg(F.array(*[cell(i, j) for i, j in pairs]).alias("cells")) \
        .select("feature", F.inline("cells"))
    n1, n2, u = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("u")
    n = n1 + n2
    larger = F.greatest(u, n1 * n2 - u)
    variance = n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1)))
    z = F.try_divide(larger - n1 * n2 / 2 - 0.5, F.sqrt(variance))
    small = F.least(n1, n2) < min_n
    exact = (F.least(n1, n2) <= EXACT_GROUP) & (F.col("_ties") == 0)
    normal = F.when(z > 0, normal_p(z)).otherwise(F.lit(1.0))
    exact_in = [F.when(exact & ~small, c) for c in (u, n1, n2)]
    p = (F.when(small, F.lit(1.0)).when(exact, exact_u_p(*exact_in)).otherwise(normal))
    return tests.withColumn("p", p).drop("_ties")


def bonferroni(tests: DataFrame, features: int, pairs: int, alpha: float = 0.05, p: str = "p") -> DataFrame:
    """Corrected level alpha / (features x pairs) and the verdict of each test."""
    level = alpha / (features * pairs)
    return tests.withColumns({
        "alpha_corrected": F.lit(level),
        "verdict": F.when(F.col(p) < level, "* (Bonf.)").otherwise("n.s. (Bonf.)"),
    })


def cohens_d(df: DataFrame, features: list[str], group: str) -> DataFrame:
    """|mean1 - mean0| / pooled sd per feature for a 0/1 group column, from one aggregate.

    Sizes are row counts of the groups, missing values included, as the pooled weights are.
    """
    x = F.col("_x")
    low, high = F.col(group) == 0, F.col(group) == 1
    x0, x1 = F.when(low, x), F.when(high, x)
    n0, n1 = F.count_if(low), F.count_if(high)
    pooled = F.sqrt(F.try_divide((n0 - 1) * F.var_samp(x0) + (n1 - 1) * F.var_samp(x1), (n0 + n1 - 2).cast("double")))
    return _long(df, [group], features).groupBy("feature").agg(
        F.abs(F.try_divide(F.avg(x0) - F.avg(x1), pooled)).alias("d"))


def effect_summary(effects: DataFrame) -> DataFrame:
    return effects.agg(F.max("d").alias("max_d"), F.avg("d").alias("mean_d"),
                       F.max_by("feature", "d").alias("top_feature"))


def mean_cv(df: DataFrame, features: list[str], by: list[str] = ()) -> DataFrame:
    """Mean over features of |std / mean|; a feature with mean 0 is left out."""
    ratio = F.abs(F.try_divide(F.stddev_samp("_x"), F.avg("_x")))
    per_feature = _long(df, by, features).groupBy(*by, "feature").agg(ratio.alias("_r"))
    return per_feature.groupBy(*by).agg(F.avg("_r").alias("mean_cv"))


def _unit_sums(block: np.ndarray) -> np.ndarray:
    """Kernel for matrix_sums: the sum of the unit rows, and how many rows have a direction."""
    x = np.nan_to_num(block)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return np.append(unit.sum(axis=0), float((norm > 0).sum()))


def mean_pairwise_cosine(df: DataFrame, dims: list[str], by: list[str] = ()) -> DataFrame:
    """Mean cosine over all row pairs of a group without forming a pair.

    With unit rows u and s = sum u the mean is (|s|^2 - sum |u|^2) / (n (n - 1)). A missing
    value counts as 0 and an all-zero row as the zero vector. ``dims`` holds one SQL expression
    per dimension.
    """
    cols = [f"_x{i}" for i in range(len(dims))]
    rows = df.selectExpr(*([f"`{c}`" for c in by] or ["1 AS _all"]),
                         *[f"CAST({d} AS DOUBLE) AS {c}" for d, c in zip(dims, cols)])
    sums = matrix_sums(rows, list(by) or ["_all"], cols, _unit_sums)
    units = F.get("values", F.lit(len(dims)))
    length = F.aggregate(F.slice("values", 1, len(dims)), F.lit(0.0), lambda a, x: a + x * x)
    n = F.col("n")
    return sums.select(*by, n.cast("long").alias("n"), F.try_divide(length - units, n * (n - 1)).alias("mean_cosine"))


def histogram(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """Counts in fixed bins, empty ones included; bins are left-closed, the last one is closed."""
    x = F.col(col)
    last = len(edges) - 2
    bin_of = None
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        inside = (x >= low) & ((x <= high) if i == last else (x < high))
        bin_of = F.when(inside, i) if bin_of is None else bin_of.when(inside, i)
    counts = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(low)).alias("low"),
                                F.lit(float(high)).alias("high"), F.lit((low + high) / 2).alias("centre"),
                                F.count_if(bin_of == i).alias("count"))
                       for i, (low, high) in enumerate(zip(edges, edges[1:]))])
    return df.agg(counts.alias("cells")).select(F.inline("cells"))


def zscore_by(df: DataFrame, key: str, features: list[str], fill: float | None = 0.0) -> DataFrame:
    """(x - mean) / std within the key; 0 where the key has no spread, and ``fill`` for a missing x."""
    stats = df.groupBy(key).agg(*[F.expr(f"{fn}(`{f}`) AS `_{p}_{f}`") for f in features
                                  for p, fn in (("m", "avg"), ("s", "stddev_samp"))])
    placed = attach(df, stats, [key], "left")

    def score(f: str) -> str:
        spread = f"`_s_{f}`"
        z = f"IF({spread} IS NULL OR {spread} = 0, `{f}` * 0D, (`{f}` - `_m_{f}`) / {spread})"
        return z if fill is None else f"coalesce({z}, {float(fill)}D)"

    wanted = set(features)
    return placed.selectExpr(*[f"{score(c)} AS `{c}`" if c in wanted else f"`{c}`" for c in df.columns])


def zscore_columns(df: DataFrame, features: list[str]) -> DataFrame:
    """z-score over the whole table: one aggregate row read back as literals."""
    stats = df.agg(*[F.expr(f"{fn}(`{f}`)") for f in features for fn in ("avg", "stddev_samp")]).first()
    moments = {f: (stats[2 * i], stats[2 * i + 1]) for i, f in enumerate(features)}

    def score(f: str) -> str:
        mean, sd = moments[f]
        return "CAST(NULL AS DOUBLE)" if not sd else f"(`{f}` - ({mean!r}D)) / {sd!r}D"

    return df.selectExpr(*[f"{score(c)} AS `{c}`" if c in moments else f"`{c}`" for c in df.columns])


def top_abs(df: DataFrame, col: str, k: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.abs(F.col(col)).desc_nulls_last(), *ties).limit(k)


def top_k_features(df: DataFrame, score: str, k: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), *ties).limit(k)


def arg_max(df: DataFrame, by: list[str], item: str, score: str) -> DataFrame:
    """The item with the largest score per group; equal scores go to the first name."""
    ranked = df.where(F.col(score).isNotNull())
    return ranked.groupBy(*by).agg(F.min_by(item, F.struct(-F.col(score), F.col(item))).alias(item),
                                   F.max(score).alias(score))
