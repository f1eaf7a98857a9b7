"""Balanced logistic models of very many folds, each of few rows, in work that grows with the rows.

A model per fold and a scan of all rows per model is the square of the rows where every row is a fold. But the train sets are the whole table
less a few rows, so all models lie near that of all rows. Around it the summed loss of each class is a power series in the
coefficients; one scan adds up its terms to ``ORDER``. A fold's model is found by Newton's method on the series less the fold's own rows, which are taken
exactly. What the series leaves out is bounded by its next term and the largest value of each feature; folds for which that
could move a coefficient by ``TOL`` are not answered here and go the plain way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations_with_replacement
from math import factorial, prod

import numpy as np
import pandas as pd
from numpy.polynomial import Polynomial
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .newton import Table

ORDER = 7          # of the highest sums: the gradient's series ends at the power before
TOL = 1e-9
ROUNDS = 30
MOST_FEATURES = 5  # sums are C(features + 1 + ORDER, ORDER)


@cache
def derivatives(order: int = ORDER + 1) -> list[Polynomial]:
    """Of log(1 + exp(z)), the first to ``order``, as polynomials of the chance 1 / (1 + exp(-z))."""
    out = [Polynomial([0.0, 1.0])]
    for _ in range(order - 1):
        out.append(out[-1].deriv() * Polynomial([0.0, 1.0, -1.0]))
    return out


@cache
def _terms(p: int) -> tuple[list[list[tuple[int, ...]]], list[dict[tuple[int, ...], int]]]:
    names = [list(combinations_with_replacement(range(p), d)) for d in range(ORDER + 1)]
    return names, [{m: i for i, m in enumerate(n)} for n in names]


def _powers(x: np.ndarray, degree: int) -> list[np.ndarray]:
    """Per degree the products of columns of ``x``, one column per multiset of columns."""
    names, at = _terms(x.shape[1])
    out = [np.ones((len(x), 1))]
    for d in range(1, degree + 1):
        out.append(np.column_stack([out[-1][:, at[d - 1][m[:-1]]] * x[:, m[-1]] for m in names[d]]))
    return out


def _series(sums: list[np.ndarray], powers: list[np.ndarray], extra: tuple[int, ...], p: int) -> np.ndarray:
    """The series of the derivative by the coefficients ``extra``, per fold."""
    names, at = _terms(p)
    total = 0.0
    for d in range(ORDER + 1 - len(extra)):
        share = np.array([sums[d + len(extra)][at[d + len(extra)][tuple(sorted(m + extra))]] / prod(factorial(m.count(j)) for j in set(m))
                          for m in names[d]])
        total = total + powers[d] @ share
    return total


def near_models(df: DataFrame, features: list[str], label: str, fold: str, c: float, ddof: int) -> DataFrame:
    """(fold, sure, _b0, _b) per fold: the model of all other rows in the features' own units, and whether the series is known to suffice."""
    whole = Table(df.withColumn("_out", F.expr("array()").cast("array<int>")), features, label, "_out", 1, ddof)
    middle = whole.fit([(0, c)], tol=1e-12).beta[0]
    p = len(middle)
    rises = derivatives()

    def kernel(a, y, inside):
        chance = 1 / (1 + np.exp(-(a @ middle)))
        powers, rows = _powers(a, ORDER), []
        for side in (0, 1):
            own = (y > 0) == side
            cells = [np.array([own.sum()]), a[own].sum(axis=0), (a[own] ** 2).sum(axis=0)]
            for d in range(1, ORDER + 1):
                slope = rises[d - 1](chance[own]) - (side if d == 1 else 0)
                cells.append(slope @ powers[d][own])
            rows.append(np.concatenate(cells))
        return np.array(rows)

    names, _ = _terms(p)
    added = whole.sums(kernel, 1 + 2 * p + sum(len(n) for n in names[1:]), 2)
    counts, first, second = added[:, 0], added[:, 1 : 1 + p].sum(axis=0), added[:, 1 + p : 1 + 2 * p].sum(axis=0)
    ends = np.cumsum([1 + 2 * p, *[len(n) for n in names[1:]]])
    sums = [[np.zeros(1), *[added[s, x:y] for x, y in zip(ends, ends[1:])]] for s in (0, 1)]
    reach = whole.rows.agg(*[f(F.get("x", F.lit(i))) for i in range(p - 1) for f in (F.min, F.max)]).first()
    far = np.array([1.0, *[max(abs((float(v or 0) - m) / s) for v in reach[2 * i : 2 * i + 2])
                           for i, (m, s) in enumerate(zip(whole.mean, whole.std))]])
    steepest = np.abs(rises[ORDER](np.linspace(0, 1, 10001))).max() / factorial(ORDER)
    mean, std = whole.mean, whole.std

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = np.array([len(r) for r in pdf["own"]])
            of = np.repeat(np.arange(len(pdf)), size)
            flat = np.array([[*r["x"], r["y"]] for rows in pdf["own"] for r in rows], float).reshape(-1, p)
            a, y = np.column_stack((np.ones(len(flat)), (flat[:, :-1] - mean) / std)), (flat[:, -1] > 0).astype(int)

            def per_fold(values: np.ndarray) -> np.ndarray:
                total = np.zeros((len(pdf), *values.shape[1:]))
                np.add.at(total, of, values)
                return total

            n = [counts[s] - per_fold((y == s).astype(float)) for s in (0, 1)]
            rows = n[0] + n[1]
            weight = [rows / (2 * n[s]) for s in (0, 1)]
            square = (second - per_fold(a**2) - (first - per_fold(a)) ** 2 / rows[:, None]) / np.maximum(rows - ddof, 1)[:, None]
            pen = np.where(square > 1e-20, square, 1.0) / c
            pen[:, 0] = 0
            move, own_weight = np.zeros((len(pdf), p)), np.where(y > 0, weight[1][of], weight[0][of])
            for _ in range(ROUNDS):
                powers, beta = _powers(move, ORDER - 1), middle + move
                chance = 1 / (1 + np.exp(-(a * beta[of]).sum(axis=1)))
                slope = pen * beta - per_fold((own_weight * (chance - y))[:, None] * a)
                bend = (own_weight * chance * (1 - chance))[:, None, None] * a[:, :, None] * a[:, None, :]
                curve = -per_fold(bend) + pen[:, :, None] * np.eye(p) + 1e-12 * np.eye(p)
                for s in (0, 1):
                    for j in range(p):
                        slope[:, j] += weight[s] * _series(sums[s], powers, (j,), p)
                        for k in range(j, p):
                            x = weight[s] * _series(sums[s], powers, (j, k), p)
                            curve[:, j, k] += x
                            if k > j:
                                curve[:, k, j] += x
                back = np.linalg.pinv(curve, hermitian=True)
                step = -(back @ slope[:, :, None])[:, :, 0]
                move = move + step
                if not (np.abs(step).max(axis=1) > 1e-12 * (1 + np.abs(middle).max())).any():
                    break
            # the first power left out, at the farthest row, of all rows, through the inverse of the curvature
            missed = steepest * (np.abs(move) @ far) ** ORDER * rows
            off = (np.abs(back) @ far) * missed[:, None]
            sure = (off.max(axis=1) <= TOL) & (np.abs(step).max(axis=1) <= TOL) & np.isfinite(move).all(axis=1)
            beta = middle + move
            slopes = beta[:, 1:] / std
            yield pd.DataFrame({fold: pdf[fold], "sure": sure, "_b0": beta[:, 0] - slopes @ mean, "_b": list(slopes)})

    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    row = F.when(F.col(label).isNotNull(), F.struct(x.alias("x"), F.col(label).cast("double").alias("y")))
    own = df.groupBy(fold).agg(F.collect_list(row).alias("own"))
    return own.mapInPandas(solve, f"`{fold}` {dict(df.dtypes)[fold]}, sure boolean, _b0 double, _b array<double>")
