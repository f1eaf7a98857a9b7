"""Tail probabilities Spark has no function for, as Arrow UDFs on small result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    x = np.clip(x, 0.0, 1.0)
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(lgamma(a + b) - lgamma(a) - math.lgamma(b)
                   + a * np.log(inside) + b * np.log1p(-inside))
    direct = front * _beta_fraction(a, b, inside) / a
    # the fraction converges fast only below the mean of the distribution
    mirrored = 1.0 - front * _beta_fraction(np.full_like(x, b), a, 1 - inside) / b
    out = np.where(inside < (a + 1) / (a + b + 2), direct, mirrored)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


@F.pandas_udf(T.DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    tv, dv = t.to_numpy(float), df.to_numpy(float)
    ok = np.isfinite(tv) & np.isfinite(dv) & (dv > 0)
    out = np.full(len(t), np.nan)
    if ok.any():
        out[ok] = incomplete_beta(dv[ok] / 2, 0.5, dv[ok] / (dv[ok] + tv[ok] ** 2))
    return pd.Series(out).where(ok, None)


@F.pandas_udf(T.DoubleType())
def _normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: min(1.0, math.erfc(abs(v) / math.sqrt(2))) if v == v else None).astype(float)


def t_statistic(r: Column, n: Column) -> Column:
    return r * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r))


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p of a Pearson r over n pairs; 0 for a perfect r, 1 for two pairs."""
    p = _t_two_sided(t_statistic(r, n), (n - 2).cast("double"))
    return F.when(n == 2, F.lit(1.0)).when(F.abs(r) >= 1, F.lit(0.0)).otherwise(F.nanvl(p, F.lit(None)))


def normal_p(z: Column) -> Column:
    return F.nanvl(_normal_two_sided(z), F.lit(None).cast("double"))


def _exact_u_tail(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties: the counts are the coefficients of a Gaussian binomial."""
    m, n = min(n1, n2), max(n1, n2)
    counts = np.zeros(m * n + 1)
    counts[0] = 1.0
    for i in range(1, m + 1):
        if n + i < len(counts):
            counts[n + i:] = counts[n + i:] - counts[:-(n + i)].copy()
        for start in range(i):
            counts[start::i] = np.cumsum(counts[start::i])
        counts /= counts.max()
    counts /= counts.sum()
    return float(counts[int(math.ceil(u)):].sum())


@F.pandas_udf(T.DoubleType())
def exact_u_p(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Two-sided exact p of the larger U for two small groups without ties."""
    out = [min(1.0, 2 * _exact_u_tail(max(a, b * c - a), int(b), int(c)))
           if a == a and b == b and c == c else None for a, b, c in zip(u, n1, n2)]
    return pd.Series(out, dtype=float)
