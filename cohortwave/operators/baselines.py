"""Fold-wise preparation and baselines that need sums only, never a loop over folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantile_agg
from .scale import attach, materialise, row_numbers, settle


def dummy_mean_cv(df: DataFrame, fold: str, y: str, out: str = "predicted") -> DataFrame:
    """Mean label of the other folds for every row: total minus own fold."""
    sums = settle(df.groupBy(fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n")))
    total = sums.agg(F.sum("_s").alias("s"), F.sum("_n").alias("n")).first()
    mean = F.try_divide(F.lit(total["s"]) - F.coalesce(F.col("_s"), F.lit(0.0)),
                        (F.lit(total["n"]) - F.col("_n")).cast("double"))
    return attach(df, sums.select(fold, mean.alias(out)), [fold])


def dummy_majority_cv(df: DataFrame, fold: str, y: str, out: str = "predicted_label") -> DataFrame:
    """Most frequent class of the other folds; equal counts go to the first label."""
    counts = settle(df.where(F.col(y).isNotNull()).groupBy(fold, y).agg(F.count(F.lit(1)).alias("_n")))
    totals = counts.groupBy(y).agg(F.sum("_n").alias("_t"))
    classes = totals.agg(F.array_sort(F.collect_list(F.struct(F.col(y).alias("label"), F.col("_t").alias("n"))))
                         .alias("_all"))
    own = counts.groupBy(fold).agg(F.map_from_entries(F.collect_list(F.struct(y, "_n"))).alias("_own"))
    left = F.transform("_all", lambda c: F.struct(
        (F.coalesce(F.try_element_at("_own", c["label"]), F.lit(0)) - c["n"]).alias("minus"), c["label"].alias("label")))
    folds = df.select(fold).distinct().join(own, fold, "left").join(F.broadcast(classes))
    table = folds.withColumn("_own", F.coalesce("_own", F.create_map().cast(own.schema["_own"].dataType)))
    return attach(df, table.select(fold, F.get(F.array_sort(left), F.lit(0))["label"].alias(out)), [fold])


def standardize(df: DataFrame, features: list[str], fold: str | None = None, ddof: int = 0) -> DataFrame:
    """(x - mean) / std fitted on the rows outside a row's own fold (all rows without ``fold``).

    Sums are taken around the overall mean, so subtracting a fold keeps its digits. A constant
    feature is only centred.
    """
    keyed = df if fold else df.withColumn("_fold", F.lit(1))
    key = fold or "_fold"
    means = df.agg(*[F.expr(f"avg(`{f}`)") for f in features]).first()
    # a feature without any value is only centred, which leaves it missing
    centre = {f: 0.0 if m is None else float(m) for f, m in zip(features, means)}
    shifted = {f: f"(`{f}` - ({m!r}D))" for f, m in centre.items()}
    parts = settle(keyed.groupBy(key).agg(*[F.expr(e) for f in features for e in (
        f"count(`{f}`) AS `_n_{f}`", f"coalesce(sum({shifted[f]}), 0D) AS `_s_{f}`",
        f"coalesce(sum({shifted[f]} * {shifted[f]}), 0D) AS `_q_{f}`")]))
    total = parts.agg(*[F.expr(f"sum(`_{k}_{f}`)") for f in features for k in "nsq"]).first()

    def fitted(i: int, f: str) -> list[str]:
        own = 1 if fold else 0
        n, s, q = [f"({total[3 * i + j]!r}{'' if k == 'n' else 'D'} - {own} * `_{k}_{f}`)" for j, k in enumerate("nsq")]
        var = f"try_divide({q} - {s} * try_divide({s}, {n}), {n} - {ddof})"
        return [f"try_divide({s}, {n}) AS `_m_{f}`", f"IF({var} > 0, sqrt({var}), 1D) AS `_sd_{f}`"]

    stats = parts.selectExpr(f"`{key}`", *[e for i, f in enumerate(features) for e in fitted(i, f)])
    placed = attach(keyed, stats, [key])
    return placed.selectExpr(*[f"({shifted[c]} - `_m_{c}`) / `_sd_{c}` AS `{c}`" if c in centre else f"`{c}`"
                               for c in df.columns])


def fold_medians(df: DataFrame, features: list[str], fold: str) -> DataFrame:
    """(fold, medians): per fold the interpolated median of every feature over the rows outside it, in the order of ``features``.

    No row is copied for a train set. Each value has a rank among all values of its feature and one among those of its fold.
    Of the values outside a fold, the k-th (from 0) has rank k plus the number of the fold's values that come before it, and
    those are the ones whose two ranks differ by at most k. So the ranks, counts per (feature, fold) and a look-up of two ranks each
    answer for all folds together, however many there are.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("_f"), F.col(f"`{f}`").cast("double").alias("_x")) for i, f in enumerate(features)])
    long = df.select(F.col(fold).alias("_fold"), F.inline(cells)).where(F.col("_x").isNotNull())
    long = materialise(long.withColumn("_id", F.monotonically_increasing_id()))
    ranked = materialise(row_numbers(long, ["_f"], ["_x", "_id"], "_at").drop("_id"))
    own = row_numbers(ranked.drop("_x"), ["_f", "_fold"], ["_at"], "_own")
    sizes = settle(ranked.groupBy("_f", "_fold").agg(F.count(F.lit(1)).alias("_n")))
    every = settle(df.select(F.col(fold).alias("_fold")).distinct()).withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    left = every.join(sizes, ["_f", "_fold"], "left").join(sizes.groupBy("_f").agg(F.sum("_n").alias("_all")), "_f", "left")
    left = left.withColumn("_left", F.col("_all") - F.coalesce("_n", F.lit(0))).where("_left > 0")
    left = settle(left.select("_f", "_fold", F.floor((F.col("_left") - 1) / 2).alias("_low"), F.ceil((F.col("_left") - 1) / 2).alias("_high")))
    lead = F.col("_at") - F.col("_own")
    passed = attach(own, left, ["_f", "_fold"]).groupBy("_f", "_fold").agg(
        F.count_if(lead <= F.col("_low")).alias("_a"), F.count_if(lead <= F.col("_high")).alias("_b"))
    wanted = left.join(passed, ["_f", "_fold"], "left").select("_f", "_fold", F.explode(F.array(
        F.col("_low") + F.coalesce("_a", F.lit(0)) + 1, F.col("_high") + F.coalesce("_b", F.lit(0)) + 1)).alias("_at"))
    wanted = settle(wanted)
    found = attach(ranked.select("_f", "_at", "_x"), wanted.select("_f", "_at").distinct(), ["_f", "_at"], salts=1)
    middle = wanted.join(found, ["_f", "_at"]).groupBy("_f", "_fold").agg(
        (F.min("_x") + (F.max("_x") - F.min("_x")) * 0.5).alias("_m"))
    placed = every.join(middle, ["_f", "_fold"], "left").groupBy("_fold").agg(F.array_sort(F.collect_list(F.struct("_f", "_m"))).alias("_all"))
    return placed.select(F.col("_fold").alias(fold), F.col("_all._m").alias("medians"))


def impute_median(df: DataFrame, features: list[str], fold: str | None = None) -> DataFrame:
    """Missing values become the interpolated median of the train rows."""
    if fold is None:
        medians = quantile_agg(df, [], {f: (f, 0.5) for f in features}).first().asDict()
        return df.fillna({f: v for f, v in medians.items() if v is not None})
    medians = fold_medians(df, features, fold).withColumnRenamed("medians", "_medians")
    placed = attach(df, medians, [fold])
    return placed.withColumns({f: F.coalesce(F.col(f"`{f}`"), F.get("_medians", F.lit(i))) for i, f in enumerate(features)}).drop("_medians")


def one_hot(df: DataFrame, col: str, values: list[str] | None = None) -> DataFrame:
    """One 0/1 column per known value; an unseen value is 0 in all of them. The plan has a column per value."""
    if values is None:
        values = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).collect()]
    return df.select("*", *[F.coalesce((F.col(col) == v).cast("int"), F.lit(0)).alias(f"{col}_{v}") for v in values])


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight n / (classes x n_class) on every row."""
    sizes = settle(df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n")))
    total = sizes.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    if not total["k"]:
        raise ValueError(f"{label} has no classes")
    weight = F.lit(float(total["n"])) / (F.lit(float(total["k"])) * F.col("_n"))
    return attach(df, sizes.select(label, weight.alias(out)), [label])
