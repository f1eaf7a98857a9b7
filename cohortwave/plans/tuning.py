"""Nested tuning of a balanced logistic model: penalty and threshold are chosen inside each outer train set."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import best_threshold, threshold_cells
from ..operators.folds import nested_folds, stratified_kfold
from ..operators.newton import Fits, Table
from ..operators.scale import materialise, settle

# The grids
PENALTIES = (0.01, 0.1, 0.3, 1.0, 3.0, 10.0)
THRESHOLDS = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50)


@dataclass(frozen=True)
class Tuned:
    table: DataFrame        # inner F1, precision, recall and accuracy per outer fold, penalty and threshold
    chosen: DataFrame       # the best setting per outer fold
    predictions: DataFrame  # every row once, by the model of its outer fold's train rows and the setting chosen there


def _level_counts(fits: Fits, outer: int, inner: int, penalties: tuple[float, ...], thresholds: list[float]) -> DataFrame:
    """(outer_fold, c, _level, _pos, _neg): train rows of an outer fold, scored by the inner fit that left them out, by how many thresholds they reach."""
    blocks, models = fits.table.blocks, len(fits.settings)
    beta, cuts = fits.beta.reshape(outer, inner, len(penalties), -1), np.array(thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((outer, len(penalties), len(cuts) + 1, 2), np.int64)
        for batch in batches:
            for a, y, inside in blocks(batch, models):
                side = inside.reshape(len(a), outer, inner + 1)
                for o in range(outer):
                    for i in range(inner):
                        rows = np.flatnonzero((side[:, o, 0] > 0) & (side[:, o, i + 1] == 0))
                        score = 1 / (1 + np.exp(-(a[rows] @ beta[o, i].T)))
                        level = np.searchsorted(cuts, score, side="right")
                        for k in range(len(penalties)):
                            np.add.at(total[o, k], (level[:, k], y[rows].astype(int)), 1)
        o, k, level = np.nonzero(total.sum(axis=3))
        yield pa.RecordBatch.from_arrays([pa.array((o + 1).astype(np.int32)), pa.array(np.array(penalties, float)[k]), pa.array(level.astype(np.int32)),
                                          pa.array(total[o, k, level, 1]), pa.array(total[o, k, level, 0])],
                                         ["outer_fold", "c", "_level", "_pos", "_neg"])

    counted = fits.table.rows.mapInArrow(run, "outer_fold int, c double, _level int, _pos long, _neg long")
    return counted.groupBy("outer_fold", "c", "_level").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))


def nested_tuning(df: DataFrame, features: list[str], label: str, key: list[str], outer: int = 5, inner: int = 4,
                  penalties: tuple[float, ...] = PENALTIES, thresholds: tuple[float, ...] = THRESHOLDS, seed: int = 42,
                  ddof: int = 0) -> Tuned:
    """``label`` is 0 or 1. Test rows of an outer fold take no part in the choice of its setting.

    The outer x inner x penalties fits of the choice share their scans, and so do the outer fits.
    Train set (o, i) of the table has number (o - 1)(inner + 1) + i, where i = 0 is the whole of outer fold o's train rows.
    """
    rows = stratified_kfold(df, label, outer, seed, key, "outer_fold")
    dealt = nested_folds(df.select(*key, label), label, outer, inner, seed, key)
    dealt = dealt.groupBy(*key).agg(F.collect_list((F.col("outer_fold") - 1) * (inner + 1) + F.col("inner_fold")).alias("_inner"))
    own = F.transform(F.sequence(F.lit(0), F.lit(inner)), lambda i: (F.col("outer_fold") - 1) * (inner + 1) + i)
    rows = materialise(rows.join(dealt, key).withColumn("_out", F.concat(own, F.col("_inner").cast("array<int>"))).drop("_inner"))
    table = Table(rows, features, label, "_out", outer * (inner + 1), ddof)
    fits = table.fit([(o * (inner + 1) + i, c) for o in range(outer) for i in range(1, inner + 1) for c in penalties])
    cuts = sorted(thresholds)
    cells = settle(threshold_cells(_level_counts(fits, outer, inner, penalties, cuts), cuts, ["outer_fold", "c"]))
    chosen = settle(best_threshold(cells, ["outer_fold", "c"], ["outer_fold"]))
    picked = {r["outer_fold"]: r for r in chosen.collect()}
    whole = table.fit([((o - 1) * (inner + 1), r["c"]) for o, r in sorted(picked.items())])
    tested = whole.predict(rows.drop("_out"), "outer_fold", {o: (o - 1) * (inner + 1) for o in picked})
    tested = tested.join(F.broadcast(chosen.select("outer_fold", "threshold")), "outer_fold")
    tested = tested.select(*key, label, "outer_fold", "score", F.col("_penalty").alias("c"), "threshold")
    return Tuned(cells, chosen, tested.withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int")))
