"""Linear models from cross-product sums.

Ridge, elastic net and partial least squares need only n, the sums and the cross products of
features and label. Spark sums them once per fold; a train set is the total minus its test
fold, and a test error follows from the test fold's own sums. So all folds, penalties and
component counts cost one scan together. The folds stay a distributed table (there may be one
per subject); each is solved where it lies, and only the totals are sent around. A fold's sums
are p^2 / 2 numbers: 30 MB for the widest view of 2,700 features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .products import add_rows, matrix_sums
from .scale import attach, materialise, settle

SOLVE_TASKS = 1_000
GROUP_BYTES = 16 << 20  # eigenvectors of folds that are scored together in ridge_path
BLOCK_ROWS = 2_048      # rows that are scored together


@dataclass(frozen=True)
class Gram:
    """Sums over rows of (1, x, y) cross products, x and y shifted by fixed centres."""

    n: float
    z: np.ndarray   # (p + 1) x (p + 1) cross products of [x, y]
    s: np.ndarray   # p + 1 sums
    centre: np.ndarray

    def __add__(self, other: "Gram") -> "Gram":
        return Gram(self.n + other.n, self.z + other.z, self.s + other.s, self.centre)

    def __sub__(self, other: "Gram") -> "Gram":
        return Gram(self.n - other.n, self.z - other.z, self.s - other.s, self.centre)

    def standardised(self):
        """Z'Z and Z'y of standardised x (ddof 0) and centred y, with means and scales."""
        mean = self.s / self.n
        cov = self.z - np.outer(self.s, mean)
        p = len(mean) - 1
        scale = np.sqrt(np.maximum(np.diag(cov)[:p], 0) / self.n)
        scale = np.where(scale > 1e-12, scale, 1.0)
        return cov[:p, :p] / np.outer(scale, scale), cov[:p, p] / scale, mean, scale

    def coefficients(self, beta: np.ndarray) -> tuple[float, np.ndarray]:
        """Intercept and slopes in the original units for slopes on standardised x."""
        mean = self.s / self.n + self.centre
        _, _, _, scale = self.standardised()
        slopes = beta / scale
        return float(mean[-1] - slopes @ mean[:-1]), slopes

    def squared_error(self, intercept: float, slopes: np.ndarray) -> float:
        """Sum of squared errors of a linear rule over the rows summed here."""
        a = np.append(-slopes, 1.0)
        c = a @ self.centre - intercept
        return float(a @ self.z @ a + 2 * c * (a @ self.s) + self.n * c * c)


def ridge_beta(g: Gram, alpha: float) -> np.ndarray:
    xx, xy, _, _ = g.standardised()
    return np.linalg.solve(xx + alpha * np.eye(len(xy)), xy)


def elastic_net_beta(g: Gram, alpha: float, l1_ratio: float, rounds: int = 20_000, tol: float = 1e-7) -> np.ndarray:
    """Accelerated proximal gradient on the cross products for 1/(2n)|y-Zb|^2 + penalty, until no
    slope moves by more than ``tol`` of the largest one."""
    xx, xy, _, _ = g.standardised()
    xx, xy = xx / g.n, xy / g.n
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    step = 1.0 / (float(np.linalg.eigvalsh(xx)[-1]) + l2)
    beta = ahead = np.zeros(len(xy))
    momentum = 1.0
    for _ in range(rounds):
        moved = ahead - step * (xx @ ahead - xy + l2 * ahead)
        new = np.sign(moved) * np.maximum(np.abs(moved) - l1 * step, 0.0)
        change = new - beta
        if np.abs(change).max(initial=0.0) <= tol * np.abs(new).max(initial=0.0):
            return new
        if (ahead - new) @ change > 0:  # overshot: start the momentum anew
            momentum = 1.0
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = new + (momentum - 1) / following * change
        beta, momentum = new, following
    return beta


def pls_beta(g: Gram, components: int) -> np.ndarray:
    """Slopes of partial least squares with one response, from the cross products alone."""
    xx, xy, _, _ = g.standardised()
    left = xy.copy()
    rotations, loadings, weights = [], [], []
    beta = np.zeros(len(xy))
    for _ in range(components):
        norm = np.linalg.norm(left)
        if norm < 1e-12:
            break
        r = left / norm
        for r0, p0 in zip(rotations, loadings):
            r = r - (p0 @ (left / norm)) * r0
        t = r @ xx @ r
        if t < 1e-12:
            break
        p, q = xx @ r / t, (xy @ r) / t
        left = left - p * q * t
        rotations.append(r)
        loadings.append(p)
        weights.append(q)
        beta = beta + q * r
    return beta


def cross_products(centre: np.ndarray):
    """Kernel for matrix_sums: p sums, then the upper triangle of the cross products."""
    upper = np.triu_indices(len(centre))

    def kernel(block: np.ndarray) -> np.ndarray:
        x = block - centre
        return np.concatenate([x.sum(axis=0), (x.T @ x)[upper]])

    return kernel


def unpack(n: float, values: np.ndarray, centre: np.ndarray) -> Gram:
    """The sums of one table row: p sums, then the upper triangle of the cross products."""
    p = len(centre)
    z = np.zeros((p, p))
    z[np.triu_indices(p)] = values[p:]
    return Gram(float(n), z + z.T - np.diag(np.diag(z)), np.asarray(values[:p], float), centre)


class Sums:
    """Cross-product sums of the rows per (fold, inner fold), written once."""

    def __init__(self, df: DataFrame, features: list[str], y: str, fold: str, inner: str | None = None):
        cols = [*features, y]
        means = df.agg(*[F.expr(f"avg(`{c}`)") for c in cols]).first()
        self.centre = np.array([float(m) for m in means])
        self.fold = fold
        rows = df.selectExpr(f"`{fold}` AS _fold", f"CAST({f'`{inner}`' if inner else '0'} AS INT) AS _inner",
                             *[f"CAST(`{c}` AS DOUBLE) AS x{i}" for i, c in enumerate(cols)])
        self.table = settle(matrix_sums(rows, ["_fold", "_inner"], [f"x{i}" for i in range(len(cols))],
                                             cross_products(self.centre)))

    def totals(self) -> dict[int, Gram]:
        """Sums over all folds per inner fold."""
        rows = settle(add_rows(self.table, ["_inner"])).collect()
        return {r["_inner"]: unpack(r["n"], np.array(r["values"], float), self.centre) for r in rows}

    def solve(self, solver) -> DataFrame:
        """(fold, _b0, _b, details): ``solver`` gets the train set's sums per inner fold."""
        totals, centre = self.totals(), self.centre
        cell = F.struct("_inner", "n", "values")
        folds = self.table.groupBy("_fold").agg(F.collect_list(cell).alias("cells"))
        kind = dict(self.table.dtypes)["_fold"]

        def run(batches):
            for pdf in batches:
                out = []
                for key, cells in zip(pdf.pop("_fold"), pdf.pop("cells")):
                    train = dict(totals)
                    for c in cells:
                        rest = train[c["_inner"]] - unpack(c["n"], np.asarray(c["values"], float), centre)
                        train[c["_inner"]] = rest
                    intercept, slopes, details = solver({i: g for i, g in train.items() if g.n > 0})
                    out.append((key, intercept, slopes.tolist(), details))
                yield pd.DataFrame(out, columns=["_fold", "_b0", "_b", "details"])

        # a stated number of partitions is not merged, however few bytes the folds hold: solving is the work
        spread = folds.repartition(max(1, min(self.table.select("_fold").distinct().count(), SOLVE_TASKS)), "_fold")
        return spread.mapInPandas(run, f"_fold {kind}, _b0 double, _b array<double>, details string") \
            .withColumnRenamed("_fold", self.fold)


def _total(parts: dict) -> Gram:
    grams = list(parts.values())
    return sum(grams[1:], grams[0])


def _predict(df: DataFrame, features: list[str], fold: str, rules: DataFrame, out: str) -> DataFrame:
    """Apply each fold's intercept and slopes to the rows of that fold."""
    # arrays, because a sum of some thousands of terms is more than the parser takes
    terms = F.zip_with(F.array(*[F.col(f"`{f}`").cast("double") for f in features]), "_b", lambda x, b: x * b)
    dot = F.aggregate(terms, F.col("_b0"), lambda total, term: total + term)
    return attach(df, rules, [fold]).withColumn(out, dot).drop("_b0", "_b")


def ridge(df: DataFrame, features: list[str], y: str, alpha: float, fold: str, out: str = "predicted") -> DataFrame:
    """Out-of-fold ridge predictions on standardised features."""
    def solver(train):
        g = _total(train)
        return (*g.coefficients(ridge_beta(g, alpha)), f"alpha={alpha:.6g}")

    return _predict(df, features, fold, Sums(df, features, y, fold).solve(solver), out).drop("details")


@dataclass(frozen=True)
class Basis:
    """Eigenvectors of a train set's standardised features, and what is needed to place a row on them."""

    values: np.ndarray
    vectors: np.ndarray
    c: np.ndarray        # label on the eigenvectors
    mean: np.ndarray
    scale: np.ndarray
    label_mean: float
    n: float

    @staticmethod
    def of(g: Gram) -> "Basis":
        xx, xy, mean, scale = g.standardised()
        values, vectors = np.linalg.eigh(xx)
        middle = mean + g.centre
        return Basis(np.maximum(values, 0), vectors, vectors.T @ xy, middle[:-1], scale, float(middle[-1]), float(g.n))

    def pack(self) -> bytes:
        return np.concatenate(([self.n, self.label_mean], self.values, self.c, self.mean, self.scale, self.vectors.ravel())).tobytes()

    @staticmethod
    def unpack(packed: bytes, p: int) -> "Basis":
        v = np.frombuffer(packed)
        values, c, mean, scale = v[2 : 2 + 4 * p].reshape(4, p)
        return Basis(values, v[2 + 4 * p :].reshape(p, p), c, mean, scale, v[1], v[0])

    def left_out_errors(self, x: np.ndarray, y: np.ndarray, alphas: np.ndarray) -> np.ndarray:
        """Per penalty the sum of squared leave-one-out errors of these train rows: residuals over one minus the leverage."""
        t = ((x - self.mean) / self.scale) @ self.vectors
        target, square = y - self.label_mean, t * t
        shrink = 1.0 / (self.values[:, None] + alphas[None, :])
        leverage = 1.0 / self.n + square @ shrink
        return ((target[:, None] - t @ (self.c[:, None] * shrink)) ** 2 / (1 - leverage) ** 2).sum(axis=0)


def _row_blocks(p: int, rows: int):
    """Rows packed into blocks: the folds of the rows, and their features and label as one matrix."""
    def run(batches):
        for pdf in batches:
            out = []
            for low in range(0, len(pdf), rows):
                part = pdf.iloc[low : low + rows]
                out.append((part["_fold"].tolist(), np.ascontiguousarray(part[[f"x{i}" for i in range(p + 1)]].to_numpy(float)).tobytes()))
            yield pd.DataFrame(out, columns=["own", "rows"])

    return run


def ridge_path(df: DataFrame, features: list[str], y: str, fold: str, alphas=None, out: str = "predicted",
               group_bytes: int = GROUP_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Ridge with the penalty of least leave-one-out error in each train set.

    The eigenvectors of a train set are computed in the task that holds its fold's sums. Folds are dealt into groups of about
    ``group_bytes`` of them, rows into blocks; every (group, block) pair is scored where it lies, and the errors are added up per fold. Only the
    totals go to the driver; each fold's penalty stays in a table.
    """
    alphas = np.logspace(-4, 4, 25) if alphas is None else np.asarray(alphas, float)
    sums, p = Sums(df, features, y, fold), len(features)
    total, centre = sums.totals()[0], sums.centre
    kind = dict(sums.table.dtypes)["_fold"]
    count = sums.table.count()
    groups = max(1, -(-count * 8 * (p * p + 4 * p + 2) // group_bytes))

    def decompose(batches):
        for pdf in batches:
            packed = [Basis.of(total - unpack(n, np.asarray(v, float), centre)).pack() for n, v in zip(pdf["n"], pdf["values"])]
            yield pd.DataFrame({"_fold": pdf["_fold"], "basis": packed})

    spread = sums.table.select("_fold", "n", "values").repartition(max(1, min(count, SOLVE_TASKS)), "_fold")
    bases = spread.mapInPandas(decompose, f"_fold {kind}, basis binary")
    bases = bases.groupBy(F.pmod(F.xxhash64("_fold"), F.lit(groups)).cast("int").alias("_group")).agg(
        F.collect_list("_fold").alias("folds"), F.collect_list("basis").alias("bases"))
    cols = [*features, y]
    rows = df.selectExpr(f"`{fold}` AS _fold", *[f"CAST(`{c}` AS DOUBLE) AS x{i}" for i, c in enumerate(cols)])
    blocks = rows.mapInPandas(_row_blocks(p, block_rows), f"own array<{kind}>, rows binary")
    dealt = attach(blocks.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), materialise(bases), ["_group"])

    def score(batches):
        errors: dict = {}
        for pdf in batches:
            for own, packed, folds, held in zip(pdf["own"], pdf["rows"], pdf["folds"], pdf["bases"]):
                block, own = np.frombuffer(packed).reshape(-1, p + 1), np.asarray(own)
                for f, basis in zip(folds, held):
                    train = block[own != f]
                    told = Basis.unpack(basis, p).left_out_errors(train[:, :p], train[:, p], alphas)
                    errors[f] = errors.get(f, 0.0) + told
        cells = [(f, float(a), float(v)) for f, e in errors.items() for a, v in zip(alphas, e)]
        yield pd.DataFrame(cells, columns=["_fold", "_alpha", "_e"])

    scored = dealt.select("own", "rows", "folds", "bases").mapInPandas(score, f"_fold {kind}, _alpha double, _e double")
    best = scored.groupBy("_fold", "_alpha").agg(F.sum("_e").alias("_e")).groupBy("_fold").agg(
        F.min_by("_alpha", F.struct("_e", "_alpha")).alias("_alpha"))

    def rule(batches):
        for pdf in batches:
            out = []
            for key, alpha, n, values in zip(pdf["_fold"], pdf["_alpha"], pdf["n"], pdf["values"]):
                g = total - unpack(n, np.asarray(values, float), centre)
                intercept, slopes = g.coefficients(ridge_beta(g, alpha))
                out.append((key, intercept, slopes.tolist(), f"alpha={alpha:.6g}"))
            yield pd.DataFrame(out, columns=["_fold", "_b0", "_b", "details"])

    chosen = sums.table.select("_fold", "n", "values").join(settle(best), "_fold")
    rules = chosen.mapInPandas(rule, f"_fold {kind}, _b0 double, _b array<double>, details string")
    return _predict(df, features, fold, rules.withColumnRenamed("_fold", fold), out)


def _search(df: DataFrame, features: list[str], y: str, fold: str, inner: str, grid: list[dict], fit, out: str) -> DataFrame:
    """Outer folds with the grid entry of least mean inner RMSE; ``inner`` splits every train set."""
    def solver(train):
        total = _total(train)

        def error(setting: dict) -> float:
            scores = []
            for g in train.values():
                rest = total - g
                scores.append(np.sqrt(max(g.squared_error(*rest.coefficients(fit(rest, **setting))), 0) / g.n))
            return float(np.mean(scores))

        chosen = min(grid, key=error)
        return (*total.coefficients(fit(total, **chosen)), ", ".join(f"{k}={v:g}" for k, v in chosen.items()))

    return _predict(df, features, fold, Sums(df, features, y, fold, inner).solve(solver), out)


def elastic_net_search(df: DataFrame, features: list[str], y: str, fold: str, inner: str,
                       alphas=(0.001, 0.01, 0.1, 1.0), l1_ratios=(0.1, 0.5, 0.9), out: str = "predicted") -> DataFrame:
    grid = [{"alpha": a, "l1_ratio": r} for a in alphas for r in l1_ratios]
    return _search(df, features, y, fold, inner, grid, elastic_net_beta, out)


def pls_regression(df: DataFrame, features: list[str], y: str, fold: str, inner: str, max_k: int = 10,
                   out: str = "predicted") -> DataFrame:
    grid = [{"components": k} for k in range(1, max(1, min(max_k, len(features))) + 1)]
    return _search(df, features, y, fold, inner, grid, pls_beta, out)
