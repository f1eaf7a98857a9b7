"""Shared-scan logistic fits against single fits and Newton steps in NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwave.operators import logistic, models
from cohortwave.operators.evaluate import tune_threshold
from cohortwave.operators.folds import nested_folds, stratified_kfold
from cohortwave.plans.tuning import nested_tuning

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(160, 3)) * [1, 50, 0.2] + [0, 1000, 3]
    y = (x[:, 0] + 0.02 * (x[:, 1] - 1000) + rng.normal(size=160) > 0.8).astype(float)
    pdf = pd.DataFrame(x, columns=X).assign(y=y, id=range(160), fold=np.arange(160) % 4 + 1)
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def newton(x, y, c, ddof=0):
    z = (x - x.mean(0)) / x.std(0, ddof=ddof)
    a = np.column_stack((np.ones(len(z)), z))
    w = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta, pen = np.zeros(4), np.array([0, *[1 / c] * 3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ beta))
        beta = beta - np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag(pen), a.T @ (w * (p - y)) + pen * beta)
    return lambda t: 1 / (1 + np.exp(-np.column_stack((np.ones(len(t)), (t - x.mean(0)) / x.std(0, ddof=ddof))) @ beta))


def scores(df):
    return np.array([r["score"] for r in df.orderBy("id").collect()])


@pytest.mark.parametrize("c", [0.01, 1.0, 100.0])
def test_folds_in_shared_scans(data, c):
    pdf, df = data
    got = scores(logistic.logistic_cv(df, X, "y", "fold", c))
    for f in range(1, 5):
        train, test = pdf[pdf.fold != f], (pdf.fold == f).to_numpy()
        want = newton(train[X].to_numpy(), train.y.to_numpy(), c)(pdf[test][X].to_numpy())
        assert got[test] == pytest.approx(want, abs=1e-8)


def test_agrees_with_single_fits(data):
    _, df = data
    est = lambda train: models.logistic_balanced(train, X, "y", 1.0)
    p = models.cross_val_predict(est, df, "fold", prepare=models.weigh_train("y"))
    want = scores(models.positive_probability(p))
    assert scores(logistic.logistic_cv(df, X, "y", "fold", 1.0, ddof=1)) == pytest.approx(want, abs=1e-6)


def test_one_row_out(data):
    pdf, df = data
    got = scores(logistic.logistic_cv(df.withColumn("fold", F.col("id")), X, "y", "fold"))
    for i in (0, 77, 159):
        rest = pdf[pdf.id != i]
        assert got[i] == pytest.approx(newton(rest[X].to_numpy(), rest.y.to_numpy(), 1.0)(pdf[X].to_numpy()[i : i + 1])[0], abs=1e-8)


def test_constant_features_and_missing_classes(data):
    _, df = data
    out = logistic.logistic_cv(df.withColumn("c", F.lit(2.0)), X, "y", "fold")
    assert out.where("score is null or isnan(score)").isEmpty()
    with pytest.raises(ValueError, match="both classes"):
        logistic.logistic_cv(df.withColumn("y", F.lit(1.0)), X, "y", "fold")
    with pytest.raises(ValueError, match="two folds"):
        logistic.logistic_cv(df.withColumn("fold", F.lit(1)), X, "y", "fold")


def test_nested_tuning_against_single_fits(data):
    pdf, df = data
    grid, cuts = (0.1, 3.0), (0.2, 0.35, 0.5)
    got = nested_tuning(df.drop("fold"), X, "y", ["id"], 3, 2, grid, cuts, seed=5)
    own = {r["id"]: r["outer_fold"] for r in stratified_kfold(df.drop("fold"), "y", 3, 5, ["id"], "outer_fold").collect()}
    inner = nested_folds(df.select("id", "y"), "y", 3, 2, 5, ["id"]).collect()
    x, y = pdf[X].to_numpy(), pdf.y.to_numpy()
    rows = []
    for o in (1, 2, 3):
        side = {r["id"]: r["inner_fold"] for r in inner if r["outer_fold"] == o}
        assert set(side) == {k for k, v in own.items() if v != o}
        for i in (1, 2):
            train, test = ([k for k, v in side.items() if (v == i) == t] for t in (False, True))
            for c in grid:
                rows += [(o, c, float(s), bool(y[k])) for k, s in zip(test, newton(x[train], y[train], c)(x[test]))]
    scored = df.sparkSession.createDataFrame(rows, "outer_fold int, c double, score double, is_positive boolean")
    want = {r["outer_fold"]: (r["c"], r["threshold"], round(r["f1"], 9)) for r in tune_threshold(scored, list(cuts), ["outer_fold", "c"], ["outer_fold"]).collect()}
    assert {r["outer_fold"]: (r["c"], r["threshold"], round(r["f1"], 9)) for r in got.chosen.collect()} == want
    final = {r["id"]: r for r in got.predictions.collect()}
    assert len(final) == 160
    for o in (1, 2, 3):
        train, test = ([k for k, v in own.items() if (v == o) == t] for t in (False, True))
        for k, s in zip(test, newton(x[train], y[train], want[o][0])(x[test])):
            assert final[k]["score"] == pytest.approx(s, abs=1e-8) and final[k]["c"] == want[o][0]
            assert final[k]["predicted"] == int(final[k]["score"] >= want[o][1])
