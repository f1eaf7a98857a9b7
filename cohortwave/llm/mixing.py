"""Mixing sources to target weights by capped water-filling.

Each source has a weight and a size. The wanted total is shared by weight; a source that would
be repeated more often than the cap is clamped there and its excess shared among the others, until none is above.
A source then takes every document ``floor(epochs)`` times, and once more those documents whose seeded draw lies
below the threshold at which their sizes come nearest to the rest.

Defined cases: a null source is a source of its own; a null or empty text has size 0 and takes nothing; an empty
table gives an empty table; identical rows of one id share a draw and go together. Other columns are kept; working columns
start with an underscore pair, so no column of the input clashes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import attach, draw, key_of, materialise, positions, settle, threshold

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
SEED = 20


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_weights(sizes: DataFrame, source: str, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Sources in code-point order, null last, weigh ``weights`` in turn."""
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    placed = positions(sizes, source, "__at")
    return placed.withColumn("__weight", F.get(cycle, (F.col("__at") % len(weights)).cast("int"))).drop("__at")


def water_fill(sources: DataFrame, size: str, weight: str, share: float, max_epochs: float) -> DataFrame:
    """Adds ``__target`` to a table of one row per source.

    A round takes two sums over the sources and clamps all that lie above their cap. A source stays clamped,
    and the others' share only grows, so the rounds end when none is above.
    """
    cap = F.col(size) * max_epochs
    state = settle(sources.withColumn("__full", F.lit(False)))
    total = state.agg(F.sum(size)).first()[0] or 0
    wanted = total * share
    while True:
        rest, weights = state.agg(
            F.lit(wanted) - F.coalesce(F.sum(F.when(F.col("__full"), cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~F.col("__full"), F.col(weight))), F.lit(0))).first()
        if not weights:
            return state.withColumn("__target", cap.cast("double")).drop("__full")
        fair = F.lit(float(rest)) * F.col(weight) / F.lit(float(weights))
        above = state.where(~F.col("__full") & (fair > cap))
        if above.isEmpty():
            return state.withColumn("__target", F.when(F.col("__full"), cap.cast("double")).otherwise(fair)).drop("__full")
        state = settle(state.withColumn("__full", F.col("__full") | (fair > cap)))


def plan(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
         weights: Sequence[int] = WEIGHTS, share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS,
         seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Documents as (__id, __key, __size, __draw), and per source (__key, __source_size, __target, __whole, __last).

    ``__key`` names the source. A document is taken ``__whole`` times, and once more if ``__draw <= __last``.
    """
    sized = materialise(docs.select(
        F.col(doc_id).alias("__id"), F.col(source).alias("__source"), key_of(F.col(source)).alias("__key"),
        word_count(F.col(text)).alias("__size"), draw(seed, F.col(doc_id)).alias("__draw")))
    sizes = sized.groupBy("__source", "__key").agg(F.sum("__size").alias("__source_size"))
    targets = water_fill(source_weights(sizes, "__source", weights), "__source_size", "__weight", share, max_epochs)
    whole = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0)
    targets = settle(targets.withColumn("__whole", whole.cast("long")).withColumn(
        "__rest", F.col("__target") - F.col("__whole") * F.col("__source_size")))
    last = threshold(sized, targets, "__key", "__draw", "__size", "__rest", "__last")
    return sized.drop("__source"), settle(
        targets.join(last, "__key").select("__key", "__source_size", "__target", "__whole", "__last"))


def repeats() -> Column:
    return F.col("__whole") + F.when(F.col("__draw") <= F.col("__last"), 1).otherwise(0)


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes."""
    return attach(*plan(docs, **options), ["__key"]).select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__size") * repeats()).cast("long").alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
        weights: Sequence[int] = WEIGHTS, share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED) -> DataFrame:
    """The documents as the mix holds them: a row per repetition, all columns kept.

    Only a few numbers per source are joined to the rows, so texts do not move when sources are few.
    """
    _, each = plan(docs, doc_id, source, text, weights, share, max_epochs, seed)
    rows = docs.withColumns({"__key": key_of(F.col(source)), "__draw": draw(seed, F.col(doc_id))})
    taken = attach(rows, each.select("__key", "__whole", "__last"), ["__key"]).withColumn("__times", repeats())
    copies = F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))
    return taken.where("__times > 0").withColumn("__copy", copies).select(*docs.columns)
