"""Models of very many folds equal those found by scans of all rows."""

import numpy as np
import pytest

from cohortwave.operators import logistic


def drawn(spark, n, group, seed=4):
    rng = np.random.default_rng(seed)
    x = np.column_stack((rng.lognormal(6, 0.7, n), rng.normal(0, 1, n)))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.002 * x[:, 0] - 2 + x[:, 1])))).astype(float)
    rows = [(i, i // group, float(a), float(b), None if i % 97 == 5 else float(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, fold long, a double, b double, y double").repartition(4)


@pytest.mark.parametrize("n, group", [(900, 1), (1500, 3)])
def test_many_small_folds_equal_scans(spark, monkeypatch, n, group):
    df = drawn(spark, n, group)
    scans = {r.id: r.score for r in logistic._by_scans(df, ["a", "b"], "y", "fold", 1.0, 0, "score").collect()}
    monkeypatch.setattr(logistic, "fold_sets", None)  # the plain way is not taken
    got = {r.id: r.score for r in logistic.logistic_cv(df, ["a", "b"], "y", "fold").collect()}
    assert got.keys() == scans.keys() and len(got) == n
    assert max(abs(got[k] - scans[k]) for k in got) < 1e-8
    sure = logistic.near_models(df, ["a", "b"], "y", "fold", 1.0, 0).where("sure").count()
    assert sure > 0.9 * n / group


def test_the_only_rows_of_a_class_in_one_fold_are_an_error(spark):
    df = spark.createDataFrame([(i, float(i), float(i == 7)) for i in range(300)], "fold long, a double, y double")
    with pytest.raises(ValueError, match="both classes"):
        logistic.logistic_cv(df, ["a"], "y", "fold")
