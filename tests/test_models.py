"""Linear models against NumPy, and invariants of folds and learned models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwave.operators import folds, linear, models, sampling
from cohortwave.plans.signal import signal_verdict
from cohortwave.plans.views import build_views, compare_views
from cohortwave.plans.voting import subject_folds, vote_cv

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 3)) * [1, 5, 0.2] + [0, 100, 3]
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=90)
    pdf = pd.DataFrame(x, columns=X).assign(y=y, id=range(90), fold=np.arange(90) % 3 + 1, inner=(np.arange(90) // 3) % 4 + 1)
    return pdf, spark.createDataFrame(pdf).cache()


def standard(train, test):
    mean, sd = train[X].mean(), train[X].std(ddof=0)
    return ((train[X] - mean) / sd).to_numpy(), ((test[X] - mean) / sd).to_numpy(), train.y.mean()


def out_of_fold(pdf, fit):
    out = pd.Series(index=pdf.index, dtype=float)
    for f in sorted(pdf.fold.unique()):
        train, test = pdf[pdf.fold != f], pdf[pdf.fold == f]
        z, zt, my = standard(train, test)
        out[pdf.fold == f] = zt @ fit(z, (train.y - my).to_numpy(), train) + my
    return out.to_numpy()


def predicted(df):
    return np.array([r["predicted"] for r in df.orderBy("id").collect()])


def ridge_fit(alpha):
    return lambda z, y, _=None: np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ y)


def test_ridge(data):
    pdf, df = data
    assert predicted(linear.ridge(df, X, "y", 5.0, "fold")) == pytest.approx(out_of_fold(pdf, ridge_fit(5.0)))


def test_ridge_path_picks_the_least_leave_one_out_error(data):
    pdf, df = data
    alphas = [0.01, 1.0, 10.0, 100.0]

    def fit(z, y, _):
        def loo(alpha):
            total = 0.0
            for i in range(len(y)):
                keep = np.arange(len(y)) != i
                zi, yi = z[keep], y[keep]
                zc, yc = zi - zi.mean(0), yi - yi.mean()
                beta = np.linalg.solve(zc.T @ zc + alpha * np.eye(3), zc.T @ yc)
                total += (y[i] - (yi.mean() + (z[i] - zi.mean(0)) @ beta)) ** 2
            return total

        return ridge_fit(min(alphas, key=loo))(z, y)

    out = linear.ridge_path(df, X, "y", "fold", alphas)
    assert predicted(out) == pytest.approx(out_of_fold(pdf, fit))
    assert out.where(~F.col("details").startswith("alpha=")).isEmpty()
    for options in ({"group_bytes": 1}, {"block_rows": 7}, {"group_bytes": 300, "block_rows": 11}):
        assert predicted(linear.ridge_path(df.repartition(4), X, "y", "fold", alphas, **options)) == pytest.approx(predicted(out))
    alone = linear.ridge_path(df.withColumn("fold", F.col("id")), X, "y", "fold", alphas)
    assert predicted(alone) == pytest.approx(out_of_fold(pdf.assign(fold=pdf.id), fit))


def test_one_fold_per_row(data):
    """As many folds as rows: each is solved in its own place."""
    pdf, df = data
    out = linear.ridge(df.withColumn("fold", F.col("id")), X, "y", 5.0, "fold")
    assert predicted(out) == pytest.approx(out_of_fold(pdf.assign(fold=pdf.id), ridge_fit(5.0)))


def test_elastic_net_agrees_with_spark(data):
    _, df = data
    ours = linear.elastic_net_search(df, X, "y", "fold", "inner", alphas=(0.3,), l1_ratios=(0.5,))
    est = lambda train: models.elastic_net(train, X, "y", 0.3, 0.5)
    theirs = models.cross_val_predict(est, df, "fold").withColumnRenamed("prediction", "predicted")
    assert predicted(ours) == pytest.approx(predicted(theirs), abs=2e-2)


def test_pls_against_deflation(data):
    pdf, df = data

    def nipals(k):
        def fit(z, y, _):
            e, w_all, p_all, q_all = z.copy(), [], [], []
            for _ in range(k):
                w = e.T @ y
                w = w / np.linalg.norm(w)
                t = e @ w
                p, q = e.T @ t / (t @ t), y @ t / (t @ t)
                e = e - np.outer(t, p)
                w_all, p_all, q_all = w_all + [w], p_all + [p], q_all + [q]
            w, p = np.array(w_all).T, np.array(p_all).T
            return w @ np.linalg.solve(p.T @ w, np.array(q_all))
        return fit

    parts = linear.Sums(df, X, "y", "fold")
    for k in (1, 2, 3):
        rules = parts.solve(lambda train, k=k: (*linear._total(train).coefficients(linear.pls_beta(linear._total(train), k)), ""))
        got = linear._predict(df, X, "fold", rules, "predicted")
        assert predicted(got) == pytest.approx(out_of_fold(pdf, nipals(k)))
    chosen = linear.pls_regression(df, X, "y", "fold", "inner")
    assert predicted(chosen).shape == (90,)


def test_error_from_sums(data):
    pdf, df = data
    parts = linear.Sums(df, X, "y", "fold")
    total = parts.totals()[0]
    slopes = np.array([1.0, -0.2, 3.0])
    want = ((pdf.y - (4.0 + pdf[X].to_numpy() @ slopes)) ** 2).sum()
    assert total.squared_error(4.0, slopes) == pytest.approx(want)


def test_cross_val_predict_covers_each_row_once(data):
    _, df = data
    p = models.cross_val_predict(models.rf_regressor(X, "y", 5, depth=4), df, "fold")
    assert p.count() == 90 and p.select("id").distinct().count() == 90
    line = models.Pipeline(stages=[models.assemble(X), models.LinearRegression(labelCol="y", solver="normal")])
    whole = {r["id"]: r["prediction"] for r in models.cross_val_predict(line, df, "fold").collect()}
    parts = models.cross_val_predict(line, df, "fold", most=1)
    assert {r["id"]: r["prediction"] for r in parts.collect()} == pytest.approx(whole)
    assert parts.select("features").first()[0].size == 3


def test_nested_folds_stay_inside_the_train_set(data):
    _, df = data
    labelled = df.withColumn("label", (F.col("a") > 0.5).cast("int"))
    nested = folds.nested_folds(labelled.select("id", "label"), "label", 5, 4, 1, ["id"])
    assert nested.count() == 90 * 4
    own = folds.stratified_kfold(labelled.select("id", "label"), "label", 5, 1, ["id"], "own")
    assert nested.join(own, "id").where("own = outer_fold").isEmpty()


def test_fold_sizes(data):
    _, df = data
    sizes = [r["count"] for r in folds.kfold(df, 4, 3, ["id"]).groupBy("fold").count().collect()]
    assert sorted(sizes) == [22, 22, 23, 23]
    with pytest.raises(ValueError):
        models.cross_val_predict(models.rf_regressor(X, "y", 2), df.withColumn("fold", F.lit(1)), "fold")
    one = df.withColumn("label", (F.col("id") == 3).cast("int"))
    assert folds.safe_k(one, "label", 5).first()["k"] == 0


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(24):
        hours = float(rng.choice([5.0, 7.0, 8.5]))
        for task in ("baseline_talk", "image_a", "valdo b", "gyrus"):
            if rng.random() < 0.9:
                rows.append((f"s{s:02d}", task, float(hours + rng.normal()), float(rng.gamma(2)), hours))
    return spark.createDataFrame(rows, "subject string, task string, p double, q double, hours double").cache()


def test_vote_cv(cohort):
    from cohortwave.functions.scalars import HOUR_LABELS, bin_label
    rows = subject_folds(cohort.withColumn("actual_label", bin_label(F.col("hours"))), scheme="groups", k=3)
    votes = vote_cv(rows, ["p", "q"], HOUR_LABELS, trees=5, depth=4)
    assert votes.rows.count() == cohort.count() and votes.subjects.count() == cohort.select("subject").distinct().count()
    total = sum((F.col(f"p_{x}") for x in HOUR_LABELS), F.lit(0.0))
    assert votes.rows.where(F.abs(total - 1) > 1e-9).isEmpty()
    assert folds.leakage_check(votes.rows, "fold", "subject").isEmpty()
    counted = votes.subjects.select((sum((F.col(f"votes_{x}") for x in HOUR_LABELS), F.lit(0)) - F.col("num_stimuli")).alias("d"))
    assert counted.where("d <> 0").isEmpty()
    two = vote_cv(rows, ["p", "q"], HOUR_LABELS, segment=["subject", "task"], trees=3, depth=3)
    assert two.segments.count() == cohort.select("subject", "task").distinct().count()


def test_leave_one_subject_out_numbers_subjects(cohort):
    folded = subject_folds(cohort)
    got = [(r["subject"], r["fold"]) for r in folded.select("subject", "fold").distinct().orderBy("subject").collect()]
    assert [f for _, f in got] == list(range(1, len(got) + 1))


def test_views(cohort):
    views = build_views(cohort, ["p", "q"], ["baseline_talk", "image_a", "valdo b"],
                        [("baseline_talk", "baseline"), ("image", "image")], "baseline_talk")
    assert set(views) == {"raw_summary", "baseline_relative_summary", "task_family_relative", "task_wide_relative", "combined_relative"}
    targets = folds.kfold(cohort.select("subject", "hours").distinct(), 3, 1, ["subject"]) \
        .withColumn("inner", (F.pmod(F.xxhash64("subject"), F.lit(3)) + 1).cast("int"))
    metrics, predictions = compare_views({k: views[k] for k in ("raw_summary", "combined_relative")}, targets, trees=3, depth=3)
    assert metrics.count() == 10 and predictions.count() == 10 * targets.count()
    assert predictions.where("predicted is null").isEmpty()


def test_final_model_round_trip(spark, cohort, tmp_path):
    from cohortwave.functions.scalars import bin_label
    from cohortwave.sources.writers import load_model, save_model
    model = models.train_final(cohort.withColumn("category", bin_label(F.col("hours"))), ["p", "q"], "hours", "category", 5, 4)
    save_model(model, f"{tmp_path}/m")
    a = models.predict_batch(model, cohort).orderBy("subject", "task").collect()
    b = models.predict_batch(load_model(f"{tmp_path}/m"), cohort).orderBy("subject", "task").collect()
    assert [r["predicted_category"] for r in a] == [r["predicted_category"] for r in b]
    assert {r["predicted_label"] for r in a} <= set(models.FRIENDLY_LABELS.values())
    with pytest.raises(ValueError, match="missing 1 features"):
        models.predict_batch(model, cohort.drop("q"))


def test_signal_verdict(cohort):
    out = signal_verdict(cohort.groupBy("subject").agg(F.avg("p").alias("p"), F.avg("q").alias("q"), F.min("hours").alias("hours")),
                         ["p", "q"], k=3, trees=5, depth=4).collect()
    assert {(r["rule"], r["model"]) for r in out} == {(a, b) for a in ("left_closed", "inclusive") for b in ("RandomForest", "DummyMajority")}


def test_augmentation_conserves_counts(cohort):
    minority = F.col("hours") < 7
    n = sampling.rows_to_generate(cohort, minority)
    made = sampling.augment_uniform(cohort, minority, ["p", "q"], n, 1, ["subject", "task"], categories=["task"])
    both = cohort.select(*made.columns).unionByName(made)
    after = sampling.balance_counts(both, minority).first()
    assert after["to_generate"] == 0 and after["rows"] == cohort.count() + n
    low = cohort.where(minority).agg(F.min("p"), F.max("p")).first()
    assert made.where(~F.col("p").between(*low)).isEmpty() and made.where(~F.col("hours").between(5.0, 6.9)).isEmpty()
    with pytest.raises(ValueError):
        sampling.rows_to_generate(both, minority)


def test_clusters(cohort):
    assert models.kmeans(cohort, ["p", "q"], 3, restarts=2).select("cluster").distinct().count() == 3
    found = models.hierarchical_clusters(cohort, ["p", "q"], 3)
    assert found.count() == cohort.count() and found.select("cluster").distinct().count() == 3
    assert models.pca(cohort, ["p", "q"]).agg(F.abs(F.avg("pc1"))).first()[0] < 1e-9


def test_linear_models_with_more_features_than_rows(spark):
    """The widest views have some thousands of features for some tens of subjects."""
    rng = np.random.default_rng(3)
    n, p = 36, 1100
    x = rng.normal(size=(n, p))
    y = x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=n) + 6
    fold, inner = np.arange(n) % 3 + 1, np.arange(n) // 3 % 2 + 1
    names_ = [f"f{i}" for i in range(p)]
    frame = spark.createDataFrame(pd.DataFrame(x, columns=names_).assign(id=np.arange(n), y=y, fold=fold, inner=inner))
    got = {r["id"]: r["predicted"] for r in linear.ridge(frame, names_, "y", 10.0, "fold").select("id", "predicted").collect()}
    for f in (1, 2, 3):
        train, test = fold != f, fold == f
        mean, std = x[train].mean(0), x[train].std(0)
        z, zt = (x[train] - mean) / std, (x[test] - mean) / std
        dual = np.linalg.solve(z @ z.T + 10 * np.eye(train.sum()), y[train] - y[train].mean())
        want = zt @ (z.T @ dual) + y[train].mean()
        assert [got[i] for i in np.flatnonzero(test)] == pytest.approx(want.tolist(), abs=1e-6)
    assert linear.pls_regression(frame, names_, "y", "fold", "inner", max_k=2).select("predicted").dropna().count() == n
