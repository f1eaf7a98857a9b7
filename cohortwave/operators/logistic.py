"""Balanced logistic regression, all folds in shared scans (see ``newton``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .many_folds import MOST_FEATURES, near_models
from .newton import Table, logistic
from .scale import attach, materialise, settle

MANY_FOLDS, FOLD_ROWS = 200, 1000  # above so many folds, none of them larger than so many rows, their models are found near that of all rows


def fold_sets(df: DataFrame, fold: str) -> tuple[DataFrame, dict]:
    """Rows with ``_out``, the number of the train set that their own fold is left out of, and the numbers by fold.

    A model per fold comes back to the driver, so its list of folds is no longer than that of its models.
    """
    folds = [r[0] for r in settle(df.select(fold).distinct()).orderBy(fold).collect()]
    if len(folds) < 2:
        raise ValueError("at least two folds are needed")
    place = df.sparkSession.createDataFrame([(f, [i]) for i, f in enumerate(folds)], f"`{fold}` {dict(df.dtypes)[fold]}, _out array<int>")
    return attach(df, place, [fold]), {f: i for i, f in enumerate(folds)}


def logistic_cv(df: DataFrame, features: list[str], label: str, fold: str, c: float = 1.0, ddof: int = 0, out: str = "score") -> DataFrame:
    """Out-of-fold probability of label 1 for every row; features are standardised and classes weighed on the train rows."""
    if len(features) <= MOST_FEATURES:
        y = F.col(label).cast("double")
        sizes = settle(df.groupBy(fold).agg(F.count(F.lit(1)).alias("rows"), F.count_if(y > 0).alias("up"), F.count_if(y <= 0).alias("down")))
        count, most, *sides = sizes.agg(F.count(F.lit(1)), F.max("rows"), F.max("up"), F.max("down"), F.sum("up"), F.sum("down")).first()
        if count > MANY_FOLDS and most <= FOLD_ROWS:
            if sides[0] >= sides[2] or sides[1] >= sides[3]:
                raise ValueError("every train set needs rows of both classes")
            return _many_folds(df, features, label, fold, c, ddof, out)
    return _by_scans(df, features, label, fold, c, ddof, out)


def _by_scans(df: DataFrame, features: list[str], label: str, fold: str, c: float, ddof: int, out: str) -> DataFrame:
    rows, sets = fold_sets(df, fold)
    fits = Table(rows, features, label, "_out", len(sets), ddof).fit([(i, c) for i in sets.values()])
    return fits.predict(df, fold, sets, out).drop("_penalty")


def _many_folds(df: DataFrame, features: list[str], label: str, fold: str, c: float, ddof: int, out: str) -> DataFrame:
    """Models from the series where it is known to suffice; the other folds' in shared scans of all rows, as ever."""
    models = materialise(near_models(df, features, label, fold, c, ddof))
    z = F.aggregate(F.zip_with(F.array(*[F.col(f"`{f}`").cast("double") for f in features]), "_b", lambda x, b: x * b), F.col("_b0"), lambda total, term: total + term)
    sure = attach(df, models.where("sure").drop("sure"), [fold], salts=1).withColumn(out, logistic(z)).drop("_b0", "_b")
    rest = [r[0] for r in models.where("not sure").select(fold).collect()]
    if not rest:
        return sure
    place = {f: i for i, f in enumerate(sorted(rest))}
    left = df.sparkSession.createDataFrame([(f, [i]) for f, i in place.items()], f"`{fold}` {dict(df.dtypes)[fold]}, _out array<int>")
    rows = attach(df, left, [fold], "left").withColumn("_out", F.coalesce("_out", F.expr("array()").cast("array<int>")))
    fits = Table(rows, features, label, "_out", len(place), ddof).fit([(i, c) for i in place.values()])
    return sure.unionByName(fits.predict(attach(df, left.select(fold), [fold], "left_semi"), fold, place, out).drop("_penalty"))
