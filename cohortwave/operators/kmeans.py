"""k-means from many starts, all of them in the same scans.

Starts are seeded by k-means||: a pass draws rows in proportion to their squared distance from the start's candidates, as a hash of the row's
values decides, so that the same rows are drawn on any number of partitions; the candidates, weighted by the rows nearest to them,
are reduced to k centres on the driver. Every pass of Lloyd's steps assigns a batch to the centres of all starts by one matrix product and adds up
numbers, sums and costs per (start, centre). Twenty starts cost the scans of the slowest one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .products import add_rows

SEEDING = 4       # passes that draw candidates
OVER = 2          # candidates a pass draws per centre, on average
ITERATIONS = 300
TOL = 1e-4        # squared shift of a start's centres, against the mean variance, at which it is done


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(x: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """Uniform draws in [0, 1) of each row's values per stream."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    row = np.zeros(len(x), np.uint64)
    for j in range(x.shape[1]):
        row = _mix(row + bits[:, j] + np.uint64(j + 1))
    return (_mix(row[:, None] ^ _mix(stream.astype(np.uint64))[None, :]) >> np.uint64(11)).astype(float) * 2.0**-53


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0.0)


def _blocks(batches: Iterator[pd.DataFrame], rows: int = 4096) -> Iterator[np.ndarray]:
    for pdf in batches:
        for low in range(0, len(pdf), rows):
            yield np.stack(pdf["x"].iloc[low : low + rows].to_numpy()).astype(float)


def _sums(points: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], width: int, models: int) -> np.ndarray:
    """What ``kernel`` gives per start (models x width), added up over all rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((models, width))
        for x in _blocks(batches):
            total += kernel(x)
        yield pd.DataFrame({"model": np.arange(models, dtype=np.int32), "n": 1.0, "values": list(total)})

    rows = add_rows(points.mapInPandas(run, "model int, n double, values array<double>"), ["model"]).collect()
    return np.array([list(r["values"]) for r in sorted(rows, key=lambda r: r["model"])]).reshape(models, width)


def _candidates(points: DataFrame, starts: int, k: int, seed: int) -> list[np.ndarray]:
    """Per start the rows drawn as candidates: one by the least draw, then some per pass."""
    streams = np.arange(starts, dtype=np.uint64) + np.uint64(seed * 1_000_003)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = [(2.0, None)] * starts
        for x in _blocks(batches):
            u = draws(x, streams)
            for s, i in enumerate(np.argmin(u, axis=0)):
                if u[i, s] < least[s][0]:
                    least[s] = float(u[i, s]), x[i]
        rows = [(s, u, x.tolist()) for s, (u, x) in enumerate(least) if x is not None]
        yield pd.DataFrame(rows, columns=["start", "u", "x"])

    told = points.mapInPandas(first, "start int, u double, x array<double>").groupBy("start").agg(F.min_by("x", F.struct("u", "x")).alias("x"))
    found = {r["start"]: np.array([list(r["x"])]) for r in told.collect()}
    if not found:
        return []
    held, cost = [found[s] for s in range(starts)], None
    for at in range(SEEDING + 1):
        all_, cuts = np.concatenate(held), np.concatenate(([0], np.cumsum([len(h) for h in held])[:-1]))
        own, share = streams + np.uint64(1009 * (at + 1)), None if cost is None else OVER * k / np.maximum(cost, 1e-300)

        def near(batches, all_=all_, cuts=cuts, own=own, share=share):
            total, rows = np.zeros(starts), []
            for x in _blocks(batches):
                d = np.minimum.reduceat(_distances(x, all_), cuts, axis=1)
                total += d.sum(axis=0)
                if share is not None:
                    i, s = np.nonzero(draws(x, own) < d * share)
                    rows += [(int(b), 0.0, x[a].tolist()) for a, b in zip(i, s)]
            rows += [(s, float(v), None) for s, v in enumerate(total)]
            yield pd.DataFrame(rows, columns=["start", "cost", "x"])

        rows = points.mapInPandas(near, "start int, cost double, x array<double>").groupBy("start").agg(
            F.sum("cost").alias("cost"), F.array_sort(F.collect_set("x")).alias("x")).collect()
        cost = np.zeros(starts)
        for r in rows:
            cost[r["start"]] = r["cost"]
            if r["x"]:
                held[r["start"]] = np.unique(np.concatenate((held[r["start"]], np.array([list(x) for x in r["x"]]))), axis=0)
    return held


def _reduce(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of weighted candidates: k-means++ and Lloyd's steps on them."""
    centres = points[[int(rng.choice(len(points), p=weight / weight.sum()))]]
    while len(centres) < min(k, len(points)):
        d = weight * _distances(points, centres).min(axis=1)
        if d.sum() <= 0:
            break
        centres = np.concatenate((centres, points[[int(rng.choice(len(points), p=d / d.sum()))]]))
    for _ in range(50):
        near = _distances(points, centres).argmin(axis=1)
        n = np.bincount(near, weight, len(centres))
        s = np.stack([np.bincount(near, weight * points[:, j], len(centres)) for j in range(points.shape[1])], axis=1)
        new = np.where(n[:, None] > 0, s / np.maximum(n, 1e-300)[:, None], centres)
        if np.array_equal(new, centres):
            break
        centres = new
    # fewer distinct candidates than centres: the rest repeat the first one and stay empty
    return np.concatenate((centres, np.repeat(centres[:1], k - len(centres), axis=0)))


def best_of_starts(points: DataFrame, k: int, starts: int = 20, seed: int = 42, iterations: int = ITERATIONS,
                   tol: float = TOL) -> tuple[np.ndarray, float]:
    """The centres of least cost, largest cluster first, and that cost. ``points`` is a written table of arrays ``x``."""
    points = points.where(F.col("x").isNotNull()).select("x")
    held = _candidates(points, starts, k, seed)
    if not held:
        return np.zeros((0, 0)), 0.0
    p, cuts = held[0].shape[1], np.concatenate(([0], np.cumsum([len(h) for h in held])))
    all_, widest = np.concatenate(held), max(map(len, held))

    def weigh(x: np.ndarray) -> np.ndarray:
        d = _distances(x, all_)
        return np.stack([np.bincount(d[:, a:b].argmin(axis=1), minlength=widest) for a, b in zip(cuts, cuts[1:])]).astype(float)

    weights = _sums(points, weigh, widest, starts)
    rng = [np.random.default_rng((seed, s)) for s in range(starts)]
    centres = np.stack([_reduce(h, np.maximum(w[: len(h)], 1e-9), k, r) for h, w, r in zip(held, weights, rng)])
    spread = np.concatenate(held).var(axis=0).mean()
    cost, size, busy = np.zeros(starts), np.zeros((starts, k)), np.arange(starts)
    for _ in range(iterations):
        now = centres[busy].reshape(-1, p)

        def step(x: np.ndarray, now=now, m=len(busy)) -> np.ndarray:
            d = _distances(x, now).reshape(len(x), m, k)
            near, least = d.argmin(axis=2), d.min(axis=2)
            out = np.zeros((m, k, p + 2))
            for s in range(m):
                out[s, :, 0] = np.bincount(near[:, s], minlength=k)
                out[s, :, 1] = np.bincount(near[:, s], least[:, s], k)
                for j in range(p):
                    out[s, :, 2 + j] = np.bincount(near[:, s], x[:, j], k)
            return out.reshape(m, -1)

        told = _sums(points, step, k * (p + 2), len(busy)).reshape(len(busy), k, p + 2)
        n = told[:, :, 0]
        new = np.where(n[:, :, None] > 0, told[:, :, 2:] / np.maximum(n, 1)[:, :, None], centres[busy])
        shift = ((new - centres[busy]) ** 2).sum(axis=(1, 2))
        cost[busy], size[busy], centres[busy] = told[:, :, 1].sum(axis=1), n, new
        busy = busy[shift > tol * max(spread, 1e-300)]
        if not len(busy):
            break
    best = int(np.argmin(cost))
    order = sorted(range(k), key=lambda c: (-size[best, c], tuple(centres[best, c])))
    return centres[best, order], float(cost[best])


def assign(points: DataFrame, centres: np.ndarray, out: str = "cluster") -> DataFrame:
    """The nearest centre of each row's array ``x``, the first of equally near ones; null without an array."""
    @F.pandas_udf("int")
    def nearest(x: pd.Series) -> pd.Series:
        known = x.notna().to_numpy()
        answer = pd.Series(np.full(len(x), None, object))
        if known.any() and len(centres):
            answer[known] = np.concatenate([_distances(b, centres).argmin(axis=1) for b in _blocks(iter([pd.DataFrame({"x": x[known]})]))])
        return answer

    return points.withColumn(out, nearest("x"))
