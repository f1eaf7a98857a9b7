"""Assigning rows or subjects to evaluation folds. Folds are numbered from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from .sampling import DRAW_SLOTS, random_rank
from .scale import attach, materialise, settle


def kfold(df: DataFrame, k: int, seed: int, key: list[str], out: str = "fold") -> DataFrame:
    """Shuffled folds whose sizes differ by at most one row."""
    return _deal(random_rank(df, [], seed, key, "_rank"), k, out)


def stratified_kfold(df: DataFrame, label: str, k: int, seed: int, key: list[str], out: str = "fold") -> DataFrame:
    return _deal(random_rank(df, [label], seed, key, "_rank"), k, out)


def _deal(ranked: DataFrame, k: int, out: str) -> DataFrame:
    return ranked.withColumn(out, (F.pmod(F.col("_rank") - 1, F.lit(k)) + 1).cast("int")).drop("_rank")


def safe_k(df: DataFrame, label: str, k: int) -> DataFrame:
    """One row: folds that leave each class in every fold; 0 where a class has one row."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("smallest")).select(
        "smallest", F.when(F.col("smallest") < 2, F.lit(0)).otherwise(F.least(F.col("smallest"), F.lit(k)))
        .cast("long").alias("k"))


def group_kfold(df: DataFrame, group: str, k: int, out: str = "fold") -> DataFrame:
    """No group in two folds, folds near equal in rows.

    A group larger than an even share takes a fold of its own; the others are dealt to the
    remaining folds by size, there and back.
    """
    sizes = settle(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")))
    total = sizes.agg(F.sum("_n")).first()[0]
    large = sizes.where(F.col("_n") * k > total).count()  # fewer than k by arithmetic
    large = min(large, k - 1)
    ranked = _rank_by_size(sizes, group)
    free = k - large
    place = F.col("_rank") - 1 - large
    round_, at = F.floor(place / free), F.pmod(place, F.lit(free))
    there_and_back = F.when(F.pmod(round_, F.lit(2)) == 0, at).otherwise(free - 1 - at)
    fold = F.when(F.col("_rank") <= large, F.col("_rank")).otherwise(large + there_and_back + 1)
    return attach(df, ranked.select(group, fold.cast("int").alias(out)), [group])


def _rank_by_size(sizes: DataFrame, group: str) -> DataFrame:
    """Largest first, equal sizes in a fixed shuffled order; sorted per (size, slot)."""
    drawn = sizes.withColumn("_u", uniform(0, F.col(group))) \
        .withColumn("_slot", F.floor(F.col("_u") * DRAW_SLOTS).cast("int"))
    per_size = drawn.groupBy("_n").agg(F.count(F.lit(1)).alias("_c"))
    per_size = per_size.select("_n", F.coalesce(F.sum("_c").over(
        Window.orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_larger"))
    per_slot = drawn.groupBy("_n", "_slot").agg(F.count(F.lit(1)).alias("_c"))
    per_slot = per_slot.select("_n", "_slot", F.coalesce(F.sum("_c").over(
        Window.partitionBy("_n").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_earlier"))
    at = F.row_number().over(Window.partitionBy("_n", "_slot").orderBy("_u", group))
    placed = attach(attach(drawn.withColumn("_r", at), per_size, ["_n"]), per_slot, ["_n", "_slot"])
    return placed.select(group, (F.col("_larger") + F.col("_earlier") + F.col("_r")).alias("_rank"))


def leave_one_group_out(df: DataFrame, group: str, out: str = "fold") -> DataFrame:
    """One fold per group, numbered in the order of the group ids.

    Ids are numbered range by range: sorted files are ranges of ids, so each is numbered by
    itself and shifted by the ids before it.
    """
    ids = materialise(df.select(group).distinct().orderBy(group)
                      .select(group, F.spark_partition_id().alias("_part")))
    counts = ids.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(group))
    numbered = attach(ids.withColumn("_r", at), offsets, ["_part"])
    return attach(df, numbered.select(group, (F.col("_before") + F.col("_r")).cast("int").alias(out)), [group])


def group_holdout(df: DataFrame, group: str, frac: float, seed: int, out: str = "is_test") -> DataFrame:
    """A share of the groups, rounded up, is the test side with all its rows."""
    groups = materialise(df.select(group).distinct())
    ranked = random_rank(groups, [], seed, [group], "_rank", "_size")
    side = ranked.select(group, (F.col("_rank") <= F.ceil(F.col("_size") * frac)).alias(out))
    return attach(df, side, [group])


def stratified_holdout(df: DataFrame, label: str, frac: float, seed: int, key: list[str],
                       out: str = "is_test") -> DataFrame:
    ranked = random_rank(df, [label], seed, key, "_rank", "_size")
    return ranked.withColumn(out, F.col("_rank") <= F.round(F.col("_size") * frac)).drop("_rank", "_size")


def nested_folds(df: DataFrame, label: str, outer: int, inner: int, seed: int, key: list[str]) -> DataFrame:
    """Each row once per outer fold it trains in, with an inner fold drawn inside that train set."""
    folded = materialise(stratified_kfold(df, label, outer, seed, key, "_own"))
    sides = F.explode(F.array(*[F.lit(i) for i in range(1, outer + 1)]))
    train = folded.withColumn("outer_fold", sides).where(F.col("_own") != F.col("outer_fold")).drop("_own")
    ranked = random_rank(train, ["outer_fold", label], seed + 1, key, "_rank")
    return _deal(ranked, inner, "inner_fold")


def leakage_check(df: DataFrame, fold: str, group: str) -> DataFrame:
    """Groups that lie in more than one fold; must be empty."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where(F.col("folds") > 1)
