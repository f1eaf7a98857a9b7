"""Kernel machines against a plain dual solver."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwave.operators import kernel, models, newton

X = ["a", "b"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] ** 2 + 0.1 * rng.normal(size=60)
    pdf = pd.DataFrame(x, columns=X).assign(y=y, t=(y > 0.4).astype(float), id=range(60), fold=np.arange(60) % 2 + 1)
    return pdf, spark.createDataFrame(pdf).repartition(3).cache()


def dual(k, linear, low, high, sign, rounds=4000):
    """Pairwise ascent on sum(linear a) - a'ka/2 with low <= a <= high and sum(a) = 0, the pair of largest violation first."""
    a = np.zeros(len(k))
    for _ in range(rounds):
        up_slope, down_slope = linear(a, 1) - k @ a, linear(a, -1) - k @ a
        i = int(np.argmax(np.where(a < high - 1e-12, up_slope, -np.inf)))
        j = int(np.argmin(np.where(a > low + 1e-12, down_slope, np.inf)))
        if up_slope[i] - down_slope[j] < 1e-7:
            break
        best, at = -np.inf, 0.0
        curve = k[i, i] + k[j, j] - 2 * k[i, j] + 1e-12
        limit = min(high[i] - a[i], a[j] - low[j])
        stops = {limit, *[s for s in (-a[i], a[j]) if 0 < s < limit]}
        steps = {s for s in stops} | {min(max((up_slope[i] - down_slope[j] + d) / curve, 0), limit) for d in (0, -2 * sign, -4 * sign)}
        for s in steps:
            b = a.copy()
            b[i], b[j] = b[i] + s, b[j] - s
            value = objective(b, k, linear)
            if value > best:
                best, at = value, s
        a[i], a[j] = a[i] + at, a[j] - at
    return a


def objective(a, k, linear):
    return linear.total(a) - 0.5 * a @ k @ a


class Regression:
    def __init__(self, y, free):
        self.y, self.free = y, free

    def __call__(self, a, way):
        return self.y - self.free * np.where(a > 0, 1, np.where(a < 0, -1, way))

    def total(self, a):
        return a @ self.y - self.free * np.abs(a).sum()


class Margin:
    def __init__(self, side):
        self.side = side

    def __call__(self, a, way):
        return self.side

    def total(self, a):
        return a @ self.side


@pytest.mark.parametrize("c", [0.3, 3.0])
def test_regression_agrees_with_the_dual(data, c):
    pdf, df = data
    rows, gaps = kernel.rbf_regressor_cv(df, X, "y", "fold", c, free=0.1, most=100)
    told = {r["fold"]: r for r in gaps.collect()}
    got = {r["id"]: r["prediction"] for r in rows.collect()}
    assert len(got) == 60
    for f in (1, 2):
        train, test = pdf[pdf.fold != f], pdf[pdf.fold == f]
        k = kernel.gaussian(train[X].to_numpy(), train[X].to_numpy(), 0.5)
        m = len(train)
        a = dual(k, Regression(train.y.to_numpy(), 0.1), np.full(m, -c), np.full(m, c), 0.1)
        best = objective(a, k, Regression(train.y.to_numpy(), 0.1))
        assert best - 1e-6 <= told[f]["objective"] <= best + told[f]["gap"] + 1e-6
        assert told[f]["gap"] <= 5e-3 * abs(best) + 1e-6 and abs(told[f]["balance"]) < 1e-5
        inside = (np.abs(a) > 1e-6) & (np.abs(a) < c - 1e-6)
        z = k @ a
        shift = np.mean((train.y - z - 0.1 * np.sign(a))[inside])
        want = kernel.gaussian(test[X].to_numpy(), train[X].to_numpy(), 0.5) @ a + shift
        assert np.abs(np.array([got[i] for i in test.id]) - want).max() < 0.05


def test_classifier_agrees_with_the_dual(data):
    pdf, df = data
    rows, gaps = kernel.rbf_classifier_cv(df, X, "t", "fold", 1.0, most=100)
    told = {r["fold"]: r for r in gaps.collect()}
    got = {r["id"]: r for r in rows.collect()}
    for f in (1, 2):
        train, test = pdf[pdf.fold != f], pdf[pdf.fold == f]
        k, side = kernel.gaussian(train[X].to_numpy(), train[X].to_numpy(), 0.5), 2 * train.t.to_numpy() - 1
        weight = np.where(side > 0, len(train) / (2 * (side > 0).sum()), len(train) / (2 * (side < 0).sum()))
        low, high = np.where(side > 0, 0, -weight), np.where(side > 0, weight, 0)
        a = dual(k, Margin(side), low, high, 0.0)
        best = objective(a, k, Margin(side))
        assert best - 1e-6 <= told[f]["objective"] <= best + told[f]["gap"] + 1e-6
        assert told[f]["gap"] <= 5e-3 * abs(best) and abs(told[f]["balance"]) < 1e-5
        inside = (np.abs(a) > 1e-6) & (np.abs(a) < weight - 1e-6)
        shift = np.mean((side - k @ a)[inside])
        want = kernel.gaussian(test[X].to_numpy(), train[X].to_numpy(), 0.5) @ a + shift
        own = np.array([got[i]["margin"] for i in test.id])
        assert np.abs(own - want).max() < 0.05
    assert all(r["prediction"] == float(r["margin"] > 0) for r in got.values())
    assert np.mean([got[i]["prediction"] == t for i, t in zip(pdf.id, pdf.t)]) > 0.75


def test_features_give_the_kernel(data, spark):
    pdf, df = data
    x = pdf[X].to_numpy()
    exact = kernel.nystroem(df, X, 100)
    phi = exact.of(x)
    assert np.allclose(phi @ phi.T, kernel.gaussian(x, x, 0.5), atol=1e-6)
    few = kernel.nystroem(df, X, 25)
    assert len(few.landmarks) == 25 and (kernel.nystroem(df.repartition(7), X, 25).landmarks == few.landmarks).all()
    phi = few.of(x)
    gap = 1 - (phi**2).sum(1)
    error = kernel.kernel_error(few, df, X).first()
    assert error["rows"] == 60 and error["mean_gap"] == pytest.approx(gap.clip(0).mean()) and error["max_gap"] == pytest.approx(gap.max())
    off = np.abs(phi @ phi.T - kernel.gaussian(x, x, 0.5))
    assert (off <= np.sqrt(np.outer(gap.clip(0), gap.clip(0))) + 1e-9).all()
    fourier, cols = models.fourier_features(df, X, 25, 0.5)
    z = np.array([list(r) for r in fourier.orderBy("id").select(*cols).collect()])
    assert off.mean() < np.abs(z @ z.T - kernel.gaussian(x, x, 0.5)).mean() / 3
    again = [list(r["phi"]) for r in few.add(df, X).orderBy("id").collect()]
    assert np.allclose(again, phi)


def test_machines_settle_in_few_passes_where_classes_hardly_differ(spark, monkeypatch):
    """Rows crowd at the corner of the loss, where a whole Newton step is far too long and a safe one far too short."""
    plain, passes = newton.Table._losses, []
    monkeypatch.setattr(newton.Table, "_losses", lambda *a: passes.append(1) or plain(*a))
    rng = np.random.default_rng(3)
    size = np.floor(np.exp(rng.normal(7, 1.2, 8000)))
    pdf = pd.DataFrame({"a": size, "b": np.floor(size / 6 * (1 + 0.05 * rng.normal(size=len(size)))), "c": (rng.random(len(size)) < 0.7).astype(float)})
    pdf = (pdf - pdf.mean()) / pdf.std()
    pdf = pdf.assign(t=(rng.random(len(size)) < 0.1).astype(float), fold=np.arange(len(size)) % 3)
    _, gaps = kernel.rbf_classifier_cv(spark.createDataFrame(pdf), ["a", "b", "c"], "t", "fold")
    for r in gaps.collect():
        assert abs(r["gap"]) <= 1e-3 * r["objective"] and abs(r["balance"]) <= 1e-3 * r["objective"]
    assert len(passes) <= 40


def test_a_pass_starts_one_python_worker_per_task_of_a_stage(spark, data):
    rows = data[1].withColumn("out", F.array(F.col("fold").cast("int") - 1))
    table = newton.Table(rows, X, "t", "out", 2)
    added = table.added(lambda a, y, inside: inside.T @ a, 3, 2)
    stages = added._jdf.queryExecution().optimizedPlan().toString().split("Repartition")
    assert len(stages) > 1 and max(s.count("MapIn") for s in stages) == 1
    told = table.sums(lambda a, y, inside: inside.T @ a, 3, 2)
    assert told[:, 0].tolist() == [30, 30]
