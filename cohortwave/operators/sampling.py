"""Seeded sampling, balancing and augmentation.

Draws are hashes of seed and key, so they are the same on any number of partitions and after
a lost executor. Ranks of draws are taken per slot of the unit interval and shifted by the
rows of earlier slots, so no task sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from .groups import group_minmax
from .scale import attach, materialise

DRAW_SLOTS = 4096


def random_rank(df: DataFrame, by: list[str], seed: int, key: list[str], out: str = "rank",
                size: str | None = None, slots: int = DRAW_SLOTS) -> DataFrame:
    """1-based place of each row in a seeded shuffle of its group; ``size`` adds the group's rows."""
    drawn = df.withColumn("_u", uniform(seed, *[F.col(k) for k in key])) \
        .withColumn("_slot", F.floor(F.col("_u") * slots).cast("int"))
    counts = drawn.groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_slot", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"),
                            F.sum("_c").over(group).alias("_total"))
    within = Window.partitionBy(*by, "_slot").orderBy("_u", *key)
    ranked = attach(drawn.withColumn("_r", F.row_number().over(within)), offsets, [*by, "_slot"], salts=1)
    ranked = ranked.withColumn(out, F.col("_before") + F.col("_r"))
    if size:
        ranked = ranked.withColumn(size, F.col("_total"))
    return ranked.drop("_u", "_slot", "_r", "_before", "_total")


def stratified_quota(df: DataFrame, stratum: Column, quota: dict[str, int], seed: int, key: list[str]) -> DataFrame:
    """A fixed number of rows per stratum."""
    allowed = None
    for name, n in quota.items():
        hit = F.col("stratum") == name
        allowed = F.when(hit, n) if allowed is None else allowed.when(hit, n)
    ranked = random_rank(df.withColumn("stratum", stratum).where(F.col("stratum").isNotNull()),
                         ["stratum"], seed, key, "_rank")
    return ranked.where(F.col("_rank") <= allowed).drop("_rank")


def undersample_rows(df: DataFrame, label: str, seed: int, key: list[str]) -> DataFrame:
    """Every class cut to the size of the smallest, in a seeded order ``shuffle_key``."""
    smallest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    kept = random_rank(df, [label], seed, key, "_rank").where(F.col("_rank") <= smallest).drop("_rank")
    return kept.withColumn("shuffle_key", uniform(f"{seed}-shuffle", *[F.col(k) for k in key]))


def undersample_groups(df: DataFrame, subject: str, label: str, seed: int) -> DataFrame:
    """Equal numbers of subjects per class, with all their rows."""
    subjects = materialise(df.select(subject, label).distinct())
    chosen = undersample_rows(subjects, label, seed, [subject]).select(subject)
    return attach(df, chosen, [subject], "left_semi")


def sample_cap(df: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """At most n rows, the first of a seeded order."""
    return df.withColumn("_u", uniform(seed, *[F.col(k) for k in key])).orderBy("_u", *key).limit(n).drop("_u")


def balance_counts(df: DataFrame, minority: Column) -> DataFrame:
    """Rows on either side and rows to make for balance."""
    low, high = F.count_if(F.coalesce(minority, F.lit(False))), F.count_if(F.coalesce(~minority, F.lit(False)))
    return df.agg(F.count(F.lit(1)).alias("rows"), low.alias("minority_rows"), high.alias("majority_rows"),
                  (high - low).alias("to_generate"))


def rows_to_generate(df: DataFrame, minority: Column) -> int:
    found = balance_counts(df, minority).first()
    if found["minority_rows"] == 0 or found["majority_rows"] == 0:
        raise ValueError("both groups must be present")
    if found["to_generate"] <= 0:
        raise ValueError("the minority group is already as large as the other")
    return found["to_generate"]


def _numbered(df: DataFrame, value: Column, order: list[str], seed: int) -> tuple[DataFrame, int]:
    """Values numbered from 0 in a seeded order, to be picked by index."""
    values = df.select(value.alias("_value"), *order).where(F.col("_value").isNotNull())
    values = materialise(random_rank(values, [], seed, order, "_rank")
                         .select((F.col("_rank") - 1).alias("_pick"), "_value"))
    return values, values.count()


def augment_uniform(df: DataFrame, minority: Column, features: list[str], n: int, seed: int, key: list[str],
                    categories: list[str] = ("task", "gender"), subject: str = "subject", label: str = "hours",
                    label_range: tuple[float, float] = (5.0, 6.9)) -> DataFrame:
    """n made-up minority rows.

    A number is uniform between the group's minimum and maximum (missing without bounds), a
    category is that of an observed row, the label is uniform in ``label_range``, and the id
    names an observed subject.
    """
    low = materialise(df.where(minority).select(*dict.fromkeys([subject, *key, *categories, *features])))
    bounds = {r["feature"]: (r["min"], r["max"]) for r in group_minmax(low, features).collect()}
    i = F.col("_i")
    rows = df.sparkSession.range(1, n + 1).withColumnRenamed("id", "_i")

    def number(f: str) -> Column:
        lo, hi = bounds[f]
        if lo is None:
            return F.lit(None).cast("double")
        return F.lit(float(lo)) + uniform(f"{seed}-{f}", i) * F.lit(float(hi) - float(lo))

    made = rows.withColumns({f: number(f) for f in features}).withColumn(
        label, F.lit(label_range[0]) + uniform(f"{seed}-{label}", i) * F.lit(label_range[1] - label_range[0]))
    for c in categories:
        values, size = _numbered(low, F.col(c).cast("string"), key, seed)
        pick = F.floor(uniform(f"{seed}-{c}", i) * size).cast("long")
        made = attach(made.withColumn("_pick", pick), values.withColumnRenamed("_value", c), ["_pick"], salts=1).drop("_pick")
    subjects = low.select(F.col(subject).cast("string").alias("_s")).where(F.col("_s").isNotNull()).distinct()
    values, size = _numbered(subjects, F.col("_s"), ["_s"], seed)
    made = attach(made.withColumn("_pick", F.floor(uniform(f"{seed}-subject", i) * size).cast("long")),
                  values.withColumnRenamed("_value", "_source"), ["_pick"], salts=1)
    name = F.concat(F.lit("SYNTH_LOW_"), F.when(F.length(i.cast("string")) < 4, F.lpad(i.cast("string"), 4, "0"))
                    .otherwise(i.cast("string")), F.lit("_FROM_"), F.col("_source"))
    return made.withColumn(subject, name).select(subject, *categories, *features, label)
