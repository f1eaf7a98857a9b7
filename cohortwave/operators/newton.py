"""Penalised models of many train sets and settings at once, by Newton's method in shared scans.

A model's loss, gradient and curvature are sums over rows. One pass over the table adds
them up for every (train set, C): a row says which train sets it is left out of, so no row is copied for a fold. The sums of a model are turned into
its step where they lie; only the coefficients come back, and all models still on their way go into the next pass. So five times four
folds and six penalties cost some eight scans together.

A model minimises the weighted loss plus 1/C times half its squared slopes; the intercept is free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .products import add_sums
from .scale import attach

CELLS = 2_000_000  # rows times models that are held at once
PAIRED = 32  # columns up to which their products are formed once for all models
ROUNDS = 60
# where a loss has straight parts, a pass tries steps whose curvature is Newton's with these shares of the safe one, in these lengths, and the safe one
SHARES = (0.0, 1e-5, 1e-4, 1e-3, 0.01, 0.03, 0.1, 0.3)
STEPS, SAFE = (1.0, 0.5, 0.2, 0.05), (1.0, 1.6, 3.0)


# --- losses: value, slope and curvature in z, the model's answer. Those with straight parts also have the curvature of a parabola that
# touches the loss at z and lies above it: its lowest point is a safe step, where Newton's may be far too long

@dataclass(frozen=True)
class Logistic:
    """Log loss of labels 0 and 1."""

    straight = False

    def terms(self, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chance = 1 / (1 + np.exp(-z))
        return np.logaddexp(0, z) - y * z, chance - y, chance * (1 - chance)


def _ramp(t: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """max(t, 0) with its corner rounded over ``width``; at most half of that below it."""
    rise = np.clip(t / width, 0, 1)
    return np.where(t > width, t - width / 2, rise * rise * width / 2), rise, ((t > 0) & (t < width)) / width


@dataclass(frozen=True)
class Insensitive:
    """max(|z - y| - free, 0), its corners rounded over ``width``."""

    free: float
    width: float
    straight = True

    def terms(self, y, z):
        value, rise, bend = _ramp(np.abs(z - y) - self.free, self.width)
        return value, np.sign(z - y) * rise, bend

    def cover(self, y, z):
        return sum(1 / (2 * np.maximum(np.abs(z - y + side * self.free), self.width)) for side in (-1, 1))


@dataclass(frozen=True)
class Hinge:
    """max(1 - side z, 0) of labels 0 and 1, whose sides are -1 and 1; its corner rounded over ``width``."""

    width: float
    straight = True

    def terms(self, y, z):
        side = np.where(y > 0, 1.0, -1.0)
        value, rise, bend = _ramp(1 - side * z, self.width)
        return value, -side * rise, bend

    def cover(self, y, z):
        return 1 / (2 * np.maximum(np.abs(1 - np.where(y > 0, z, -z)), self.width))


# --- the table

@dataclass(frozen=True)
class Blocks:
    """Cuts a batch into blocks of rows: 1 and the features, standardised over all rows, the labels, and per train set whether a row is in it."""

    mean: np.ndarray
    std: np.ndarray
    sets: int

    def __call__(self, batch: pa.RecordBatch, models: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        p = len(self.mean)
        size = max(1, CELLS // max(1, models, self.sets, p**2 // 2 if p < PAIRED else 4 * p))
        for low in range(0, batch.num_rows, size):
            part = batch.slice(low, size)
            n = part.num_rows
            a = np.ones((n, p + 1))
            a[:, 1:] = (part.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, p) - self.mean) / self.std
            inside = np.ones((n, self.sets))
            out = part.column("out")
            inside[np.repeat(np.arange(n), np.diff(out.offsets.to_numpy())), out.flatten().to_numpy(zero_copy_only=False)] = 0
            yield a, part.column("y").to_numpy(zero_copy_only=False), inside


def curvatures(a: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Per column of ``weight`` the upper triangle of the weighted products of all columns, added up over the rows."""
    low, high = np.triu_indices(a.shape[1])
    if a.shape[1] <= PAIRED:
        return weight.T @ (a[:, low] * a[:, high])
    return np.array([((a * w[:, None]).T @ a)[low, high] for w in weight.T])


class Table:
    """Rows with a label and ``left_out``, an array of the train sets (from 0) that a row takes no part in; written before use.

    ``features`` is a list of columns, or one array column of ``width`` numbers. With ``ddof`` the penalty is on features standardised by the
    train set, without it on the features as they are. ``balanced`` labels are 0 and 1, and a row's weight is n / (2 n_class) of its train set.
    """

    def __init__(self, df: DataFrame, features: list[str] | str, label: str, left_out: str, sets: int, ddof: int | None = 0,
                 balanced: bool = True, width: int = 0):
        array = F.col(features) if isinstance(features, str) else F.array(*[F.col(f"`{f}`").cast("double") for f in features])
        self.array, self.sets, self.balanced = array, sets, balanced
        self.rows = df.where(F.col(label).isNotNull()).select(array.alias("x"), F.col(label).cast("double").alias("y"), F.col(left_out).alias("out"))
        p = width or len(features)
        self.mean, self.std = np.zeros(p), np.ones(p)
        if ddof is not None:
            stats = self.rows.agg(*[f(F.get("x", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(p)]).first()
            self.mean = np.array([float(v or 0) for v in stats[:p]])
            self.std = np.array([float(v) if v else 1.0 for v in stats[p:]])
        self.blocks = Blocks(self.mean, self.std, sets)

        def moments(a, y, inside):
            square = [a[:, 1:], a[:, 1:] ** 2] if ddof is not None else []
            return inside.T @ np.column_stack((a[:, 0], y > 0, *square))

        n = self.sums(moments, 2 + (2 * p if ddof is not None else 0), sets)
        self.count, self.positives, self.scale = n[:, 0], n[:, 1], np.ones((sets, p))
        if balanced and ((self.positives <= 0) | (self.positives >= self.count)).any():
            raise ValueError("every train set needs rows of both classes")
        if ddof is not None:
            square = (n[:, 2 + p :] - n[:, 2 : 2 + p] ** 2 / n[:, :1]) / np.maximum(n[:, :1] - ddof, 1)
            self.scale = np.sqrt(np.where(square > 1e-20, square, 1.0))  # per set, of features standardised over all rows

    def added(self, kernel, width: int, models: int, then=None, schema: str = "") -> DataFrame:
        """(model, n, values): what ``kernel(a, y, inside)`` gives per model, added up over all rows; or what ``then`` makes of these rows."""
        blocks = self.blocks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((models, width))
            for batch in batches:
                for block in blocks(batch, models):
                    total += kernel(*block)
            for low in range(0, models, max(1, CELLS // width)):
                part = total[low : low + max(1, CELLS // width)]
                values = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * width, part.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + len(part)), pa.int32()), pa.array(np.ones(len(part))), values],
                                                 ["model", "n", "values"])

        return add_sums(self.rows.mapInArrow(run, "model int, n double, values array<double>"), ["model"], then, schema)

    def sums(self, kernel, width: int, models: int) -> np.ndarray:
        rows = self.added(kernel, width, models).collect()
        return np.array([list(r["values"]) for r in sorted(rows, key=lambda r: r["model"])]).reshape(models, width)

    def weights(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows with label 1 and of all others, per model."""
        if not self.balanced:
            return np.ones(len(sets)), np.ones(len(sets))
        return self.count[sets] / (2 * self.positives[sets]), self.count[sets] / (2 * (self.count - self.positives)[sets])

    def _losses(self, loss, beta: np.ndarray, sets: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        up, down = self.weights(sets)

        def kernel(a, y, inside):
            value = loss.terms(y[:, None], a @ beta.T)[0]
            return (inside[:, sets] * np.where(y[:, None] > 0, up, down) * value).sum(axis=0)[:, None]

        return self.sums(kernel, 1, len(beta))[:, 0] + 0.5 * (penalty * beta**2).sum(axis=1)

    def fit(self, settings: list[tuple[int, float]], loss=Logistic(), start: np.ndarray | None = None, tol: float = 1e-9,
            rounds: int = ROUNDS) -> "Fits":
        """A model for each (train set, C).

        A smooth loss takes whole steps, and half of one that the next pass finds to be too far. One with straight parts has the lengths ``STEPS`` and ``SAFE`` of several steps tried in a
        pass of their own. A model is done when its coefficients, or with straight parts its objective, change by a share of ``tol`` at most.
        """
        p, m = len(self.mean) + 1, len(settings)
        sets = np.array([s for s, _ in settings], int)
        penalty = np.array([np.concatenate(([0.0], self.scale[s] ** 2 / c)) for s, c in settings]).reshape(m, p)
        low, high = np.triu_indices(p)
        up, down = self.weights(sets)
        best = np.zeros((m, p)) if start is None else start.copy()
        trial, reached, busy = best.copy(), np.full(m, np.inf), np.arange(m)
        for _ in range(rounds):
            if not len(busy):
                break
            own, beta, pen, w1, w0 = sets[busy], trial[busy], penalty[busy], up[busy], down[busy]

            def kernel(a, y, inside, own=own, beta=beta, w1=w1, w0=w0):
                value, slope, bend = loss.terms(y[:, None], a @ beta.T)
                weight = inside[:, own] * np.where(y[:, None] > 0, w1, w0)
                bends = [bend, loss.cover(y[:, None], a @ beta.T)] if loss.straight else [bend]
                return np.column_stack(((weight * value).sum(axis=0), (weight * slope).T @ a, *[curvatures(a, weight * b) for b in bends]))

            def step(batches, beta=beta, pen=pen):
                for pdf in batches:
                    rows = []
                    for i, values in zip(pdf["model"], pdf["values"]):
                        v, moves = np.asarray(values, float), []
                        slope = v[1 : 1 + p] + pen[i] * beta[i]
                        bends = v[1 + p :].reshape(-1, len(low))
                        if loss.straight:
                            bends = [*[(1 - s) * bends[0] + s * bends[1] for s in SHARES], bends[1]]
                        for bend in bends:
                            curve = np.diag(pen[i] + 1e-12)
                            curve[low, high] += bend
                            curve = np.triu(curve) + np.triu(curve, 1).T
                            moves += (-np.linalg.lstsq(curve, slope, rcond=None)[0]).tolist()
                        rows.append((i, v[0] + 0.5 * float(pen[i] @ beta[i] ** 2), moves))
                    yield pd.DataFrame(rows, columns=["model", "loss", "moves"])

            width = 1 + p + len(low) * (2 if loss.straight else 1)
            told = self.added(kernel, width, len(busy), step, "model int, loss double, moves array<double>")
            done, moves = set(), {}
            for r in told.collect():
                at, move = busy[r["model"]], np.array(r["moves"])
                if loss.straight:
                    *newton, safe = move.reshape(-1, p)
                    reached[at], moves[at] = r["loss"], np.concatenate([*[np.outer(STEPS, way) for way in newton], np.outer(SAFE, safe)])
                elif r["loss"] <= reached[at] + 1e-10 * abs(reached[at]) or not np.isfinite(reached[at]):
                    best[at], reached[at] = trial[at], r["loss"]
                    trial[at] = best[at] + move
                    if np.abs(move).max() <= tol * (1 + np.abs(best[at]).max()):
                        best[at] = trial[at]
                        done.add(at)
                else:  # too far: half the way
                    trial[at] = (best[at] + trial[at]) / 2
            if loss.straight:
                ways = len(SHARES) * len(STEPS) + len(SAFE)
                tried = np.concatenate([best[at] + moves[at] for at in busy])
                losses = self._losses(loss, tried, np.repeat(sets[busy], ways), np.repeat(pen, ways, axis=0)).reshape(len(busy), ways)
                for at, own, told in zip(busy, losses, tried.reshape(len(busy), ways, p)):
                    least = int(own.argmin())
                    if own[least] < reached[at]:
                        best[at] = trial[at] = told[least]
                    if own[least] >= reached[at] - tol * abs(reached[at]):
                        done.add(at)
            busy = np.array([i for i in busy if i not in done], int)
        return Fits(self, settings, best)


class Fits:
    """Coefficients per (train set, C), the intercept first, on features standardised over all rows."""

    def __init__(self, table: Table, settings: list[tuple[int, float]], beta: np.ndarray):
        self.table, self.settings, self.beta = table, settings, beta

    def rules(self) -> list[tuple[int, float, float, list[float]]]:
        """(set, C, intercept, slopes) in the features' own units."""
        out = []
        for (s, c), b in zip(self.settings, self.beta, strict=True):
            slopes = b[1:] / self.table.std
            out.append((int(s), float(c), float(b[0] - slopes @ self.table.mean), slopes.tolist()))
        return out

    def answer(self, df: DataFrame, key: str, sets: dict, out: str) -> DataFrame:
        """Adds the answer of the model of each row's ``key``, and that model's C as ``_penalty``; ``sets`` maps keys to train sets."""
        by_set = {s: (c, b0, b) for s, c, b0, b in self.rules()}
        kind = dict(df.dtypes)[key]
        rows = [(k, *by_set[s]) for k, s in sets.items() if s in by_set]
        rules = df.sparkSession.createDataFrame(rows, f"`{key}` {kind}, _penalty double, _b0 double, _b array<double>")
        terms = F.zip_with(self.table.array, "_b", lambda x, b: x * b)
        z = F.aggregate(terms, F.col("_b0"), lambda total, term: total + term)
        return attach(df, rules, [key]).withColumn(out, z).drop("_b0", "_b")

    def predict(self, df: DataFrame, key: str, sets: dict, out: str = "score") -> DataFrame:
        """The same as a probability."""
        return self.answer(df, key, sets, out).withColumn(out, logistic(F.col(out)))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))
