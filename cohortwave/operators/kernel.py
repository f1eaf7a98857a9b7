"""Kernel machines as linear ones: Nyström features of the Gaussian kernel, support vector regression and classification on them.

Landmarks are rows drawn by a hash of their values. A row's features are its kernel values with the landmarks times the inverse square root of
the landmarks' own kernel, so that their dot products are the kernel exactly between landmarks, and between all
rows where every distinct row is one. The machines are fitted by Newton's method in shared scans, on a loss whose corners are rounded
over a width that shrinks step by step; every model reports its duality gap, which bounds how far its objective lies above the least one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .logistic import fold_sets
from .newton import Fits, Hinge, Insensitive, Table
from .scale import materialise

LANDMARKS = 128
WIDTHS = (1.0, 0.2, 0.05, 0.01, 0.002)


def gaussian(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1), 0.0))


@dataclass(frozen=True)
class Nystroem:
    """``root`` has a column per feature: kernel values with the landmarks times it are a row's features."""

    landmarks: np.ndarray
    root: np.ndarray
    gamma: float

    def of(self, x: np.ndarray) -> np.ndarray:
        return gaussian(x, self.landmarks, self.gamma) @ self.root

    def add(self, df: DataFrame, features: list[str], out: str = "phi") -> DataFrame:
        of = self.of

        @F.pandas_udf("array<double>")
        def phi(x: pd.Series) -> pd.Series:
            return pd.Series(list(of(np.stack(x.to_numpy()).astype(float)))) if len(x) else pd.Series([], dtype=object)

        return df.withColumn(out, phi(F.array(*[F.col(f"`{f}`").cast("double") for f in features])))


def nystroem(df: DataFrame, features: list[str], most: int = LANDMARKS, gamma: float | None = None, seed: int = 42) -> Nystroem:
    """Up to ``most`` distinct rows as landmarks; directions in which they hardly differ are left out."""
    gamma = 1.0 / len(features) if gamma is None else gamma
    cols = [F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    rows = df.select(*cols).dropna().distinct()
    names = [f"x{i}" for i in range(len(features))]
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), *names), *names).limit(most).collect()
    x = np.array([list(r) for r in drawn], float).reshape(-1, len(features))
    values, vectors = np.linalg.eigh(gaussian(x, x, gamma))
    keep = values > 1e-10 * max(values.max(initial=0), 1e-300)
    return Nystroem(x, vectors[:, keep] / np.sqrt(values[keep]), gamma)


def kernel_error(map_: Nystroem, df: DataFrame, features: list[str]) -> DataFrame:
    """One row (mean_gap, max_gap, rows): how much of each row's kernel value with itself, which is 1, its features miss.

    The error between two rows is at most the geometric mean of their gaps.
    """
    of = map_.of

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gap = np.maximum(1 - (of(pdf.to_numpy(float)) ** 2).sum(axis=1), 0)
            yield pd.DataFrame({"total": [gap.sum()], "most": [gap.max(initial=0)], "n": [len(gap)]})

    rows = df.select(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]).dropna()
    told = rows.mapInPandas(run, "total double, most double, n long")
    return told.agg((F.sum("total") / F.sum("n")).alias("mean_gap"), F.max("most").alias("max_gap"), F.sum("n").alias("rows"))


def duality_gaps(fits: Fits, loss) -> list[tuple[float, float, float]]:
    """Per model its objective, the gap to the dual one, and by how much the dual's balance is off, all in units of C times the loss.

    The dual variables are the slopes of the rounded loss, which lie within their bounds; where the model is settled, they add up to 0.
    """
    table, sets = fits.table, np.array([s for s, _ in fits.settings], int)
    c, (up, down), beta = np.array([c for _, c in fits.settings]), table.weights(sets), fits.beta
    free = loss.free if isinstance(loss, Insensitive) else None

    def kernel(a, y, inside):
        z = a @ beta.T
        weight = inside[:, sets] * np.where(y[:, None] > 0, up, down) * c
        if free is None:
            side = np.where(y > 0, 1.0, -1.0)[:, None]
            value = np.maximum(1 - side * z, 0)
            alpha = -weight * loss.terms(y[:, None], z)[1]
            linear = alpha * side
        else:
            value = np.maximum(np.abs(z - y[:, None]) - free, 0)
            alpha = -weight * loss.terms(y[:, None], z)[1]
            linear = alpha * y[:, None] - free * np.abs(alpha)
        return np.column_stack(((weight * value).sum(axis=0), linear.sum(axis=0), alpha.T @ a))

    out = []
    for v, b in zip(table.sums(kernel, 3 + beta.shape[1] - 1, len(sets)), beta, strict=True):
        primal = 0.5 * float(b[1:] @ b[1:]) + v[0]
        dual = v[1] - 0.5 * float(v[3:] @ v[3:])
        out.append((float(primal), float(primal - dual), float(v[2])))
    return out


def _machine(df: DataFrame, features: list[str], label: str, fold: str, c: float, losses: list, balanced: bool, most: int,
             gamma: float | None, seed: int, out: str) -> tuple[DataFrame, DataFrame]:
    map_ = nystroem(df, features, most, gamma, seed)
    rows, sets = fold_sets(materialise(map_.add(df, features, "_phi")), fold)
    table = Table(rows, "_phi", label, "_out", len(sets), None, balanced, map_.root.shape[1])
    settings, beta = [(i, c) for i in sets.values()], None
    for loss in losses:
        fits = table.fit(settings, loss, beta, 1e-8 if loss is losses[-1] else 1e-3)
        beta = fits.beta
    told = duality_gaps(fits, losses[-1])
    gaps = df.sparkSession.createDataFrame([(f, *told[i]) for f, i in sets.items()], f"`{fold}` {dict(df.dtypes)[fold]}, objective double, gap double, balance double")
    return fits.answer(rows, fold, sets, out).drop("_penalty", "_phi", "_out"), gaps


def rbf_regressor_cv(df: DataFrame, features: list[str], label: str, fold: str, c: float = 1.0, free: float = 0.2, most: int = LANDMARKS,
                     gamma: float | None = None, seed: int = 42, out: str = "prediction", widths: tuple[float, ...] = WIDTHS) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold support vector regression with a loss that is free of charge up to ``free``; (rows, gap per fold).

    ``features`` are standardised columns (see ``baselines.standardize``), for which the usual gamma is one over their number.
    """
    return _machine(df, features, label, fold, c, [Insensitive(free, w) for w in widths], False, most, gamma, seed, out)


def rbf_classifier_cv(df: DataFrame, features: list[str], label: str, fold: str, c: float = 1.0, most: int = LANDMARKS,
                      gamma: float | None = None, seed: int = 42, out: str = "margin", widths: tuple[float, ...] = WIDTHS) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold margin of label 1 by a balanced support vector classifier, and ``prediction`` 1 where it is above 0; (rows, gap per fold)."""
    rows, gaps = _machine(df, features, label, fold, c, [Hinge(w) for w in widths], True, most, gamma, seed, out)
    return rows.withColumn("prediction", (F.col(out) > 0).cast("double")), gaps
