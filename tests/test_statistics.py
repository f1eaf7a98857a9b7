"""Statistics against NumPy and pandas on small data."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwave.functions.scalars import bin_label, bin_label_inclusive, clip, task_family, two_way_label
from cohortwave.functions.tails import _exact_u_tail, incomplete_beta
from cohortwave.operators import baselines, correlation, evaluate, groups, quality, relative, subjects


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({
        "subject": np.repeat([f"s{i:02d}" for i in range(30)], 4), "task": ["t1", "t2", "t3", "t4"] * 30,
        "a": rng.normal(5, 2, 120), "b": rng.integers(0, 5, 120).astype(float), "flat": 3.0,
        "hours": np.repeat(rng.choice([5.0, 6.0, 6.5, 7.0, 8.0, 9.0], 30), 4)})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.nanvl("a", F.lit(None).cast("double")))
    return pdf, df.cache()


def test_labels_on_the_edges(spark):
    df = spark.createDataFrame([(5.9,), (6.0,), (7.0,), (8.0,), (99.0,), (None,)], "x double")
    x = F.col("x")
    rows = df.select(bin_label(x), bin_label_inclusive(x), two_way_label(x, 7, "<", "LowSleep", "HigherSleep"),
                     clip(x, 6.0, 8.0)).collect()
    assert [r[0] for r in rows] == ["Short", "Normal", "Normal", "Long", None, None]
    assert [r[1] for r in rows] == ["Short", "Normal", "Normal", "Normal", "Long", "Normal"]
    assert [r[2] for r in rows] == ["LowSleep", "LowSleep", "HigherSleep", "HigherSleep", "HigherSleep", "HigherSleep"]
    assert [r[3] for r in rows] == [6.0, 6.0, 7.0, 8.0, 8.0, None]
    tasks = spark.createDataFrame([("baseline_talk",), ("baseline_talk2",), ("imagine1",), ("image_sad",), ("saying_words3",)], "t string")
    assert [r[0] for r in tasks.select(task_family(F.col("t"))).collect()] == ["baseline", "other", "imagine", "image", "verbal"]


def test_correlations_are_pairwise_complete(frame):
    pdf, df = frame
    want = pdf[["a", "b", "flat", "hours"]].corr()
    for r in correlation.corr_matrix(df, ["a", "b", "flat", "hours"]).collect():
        w = want.loc[r["a"], r["b"]]
        assert (r["r"] is None) if math.isnan(w) else r["r"] == pytest.approx(w)
    per_task = {(r["task"], r["feature"]): r for r in correlation.task_corr(df, ["a", "b"]).collect()}
    means = pdf.groupby(["task", "subject"])[["a", "b", "hours"]].mean().dropna()
    for task in ("t1", "t4"):
        part = means.loc[task]
        got = per_task[task, "a"]
        assert got["n"] == len(part) and got["r"] == pytest.approx(part["a"].corr(part["hours"]))


def test_t_tail_matches_integration():
    for t, df in ((0.5, 3), (2.1, 10), (4.0, 79), (1.2, 100_000)):
        x = np.linspace(t, t + 400, 2_000_001)
        dens = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        tail = 2 * np.trapezoid(dens, x)
        got = incomplete_beta(np.array([df / 2.0]), 0.5, np.array([df / (df + t * t)]))[0]
        assert got == pytest.approx(tail, rel=2e-3)


def test_mann_whitney_against_enumeration(spark):
    a, b = [1.1, 2.2, 9.0], [3.3, 4.4, 5.5, 0.5]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, x double")
    got = groups.mann_whitney(df, "g", ["a", "b"], ["x"]).first()
    u = sum(x > y for x in a for y in b)
    assert got["u"] == u
    pool = a + b
    dist = [sum(x > y for x in c for y in pool if y not in c) for c in itertools.combinations(pool, 3)]
    big = max(u, 12 - u)
    assert got["p"] == pytest.approx(min(1.0, 2 * np.mean([d >= big for d in dist])))
    assert _exact_u_tail(0, 3, 4) == pytest.approx(1.0)


def test_mann_whitney_normal_tail_and_small_groups(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, 40).astype(float), rng.integers(1, 7, 30).astype(float)
    rows = [("a", float(v)) for v in x] + [("b", float(v)) for v in y] + [("c", 1.0), ("c", 2.0)]
    got = {(r["group1"], r["group2"]): r for r in
           groups.mann_whitney(spark.createDataFrame(rows, "g string, x double"), "g", ["a", "b", "c"], ["x"]).collect()}
    u = sum((p > q) + 0.5 * (p == q) for p in x for q in y)
    both = np.concatenate([x, y])
    ties = sum(c ** 3 - c for c in np.unique(both, return_counts=True)[1])
    n = 70
    sd = math.sqrt(40 * 30 / 12 * (n + 1 - ties / (n * (n - 1))))
    p = math.erfc(abs(max(u, 1200 - u) - 600 - 0.5) / sd / math.sqrt(2))
    assert got["a", "b"]["u"] == u and got["a", "b"]["p"] == pytest.approx(p)
    assert got["a", "c"]["p"] == 1.0 and got["b", "c"]["p"] == 1.0


def test_cosine_without_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(25, 3))
    x[3] = 0
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = groups.mean_pairwise_cosine(df, ["a", "b", "c"]).first()["mean_cosine"]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    assert got == pytest.approx((u @ u.T)[np.triu_indices(25, 1)].mean())


def test_effect_sizes_and_cv(frame):
    pdf, df = frame
    low, high = pdf[pdf.hours <= 6], pdf[pdf.hours > 6]
    out = {r["feature"]: r["d"] for r in
           groups.cohens_d(df.withColumn("g", two_way_label(F.col("hours"), 6, ">", 1, 0)), ["a", "b", "flat"], "g").collect()}
    sd = math.sqrt(((len(low) - 1) * low.a.var() + (len(high) - 1) * high.a.var()) / (len(pdf) - 2))
    assert out["a"] == pytest.approx(abs(low.a.mean() - high.a.mean()) / sd) and out["flat"] is None
    cv = groups.mean_cv(df, ["a", "b", "flat"]).first()["mean_cv"]
    assert cv == pytest.approx((pdf[["a", "b", "flat"]].std() / pdf[["a", "b", "flat"]].mean()).abs().mean())


def test_dense_grid_counts_absent_cells_as_zero(spark):
    df = spark.createDataFrame([("s1", "t1", 4.0), ("s2", "t1", 6.0), ("s3", "t2", 10.0), ("s1", "t2", 2.0), ("s2", "t2", None)],
                               "subject string, task string, g double")
    filled = {r["task"]: r["g"] for r in subjects.dense_grid_median(df, ["g"]).collect()}
    assert filled == {"t1": 4.0, "t2": 2.0}
    plain = {r["task"]: r["g"] for r in subjects.dense_grid_median(df, ["g"], fill=None).collect()}
    assert plain == {"t1": 5.0, "t2": 6.0}


def test_drop_sparse(spark):
    rows = [("a", "t1", 1.0, None, 1.0), ("a", "t2", 2.0, None, 2.0), ("a", "t3", None, None, 3.0),  # one metric empty, one gap
            ("b", "t1", 1.0, 1.0, 1.0), ("c", "t1", 1.0, None, None), ("c", "t2", 1.0, None, None)]
    df = spark.createDataFrame(rows, "subject string, task string, x double, y double, z double")
    got = {(r["subject"], r["task"], r["metric"]) for r in quality.drop_sparse(df, "subject", ["x", "y", "z"]).collect()}
    assert got == {("a", t, k) for t in ("t1", "t2") for k in ("x", "z")}


def test_relative_views(spark):
    base = "baseline_talk"
    rows = [("a", base, 1.0), ("a", "image_x", 4.0), ("a", "image_y", 9.0), ("b", base, 2.0), ("c", "image_x", 2.0), ("c", "valdo", 6.0)]
    df = spark.createDataFrame(rows, "subject string, task string, f double")
    got = {r["subject"]: r for r in relative.baseline_relative(df, ["f"]).collect()}
    assert got["a"]["delta_median__f"] == 5.5 and got["a"]["delta_std__f"] == 2.5 and got["a"]["delta_iqr__f"] == 2.5
    assert got["b"]["delta_median__f"] == 0.0                     # only the baseline
    assert got["c"]["delta_mean__f"] == 0.0                       # own median as baseline
    assert got["a"]["baseline_log__f"] == pytest.approx(math.log(2))
    family = {r["subject"]: r for r in relative.family_relative(df, ["f"]).collect()}
    assert family["a"]["family_image_delta_median__f"] == 5.5 and family["b"]["family_image_delta_median__f"] is None
    wide = {r["subject"]: r for r in relative.taskwide_relative(df, ["f"], [base, "image_x", "valdo"]).collect()}
    assert wide["c"]["task_valdo_log_delta__f"] == pytest.approx(math.log(7) - math.log(5))


def test_votes_ties_and_missing_classes(spark):
    rows = [("a", "Short", .9, .1), ("a", "Short", .6, .4), ("a", "Long", .1, .9), ("a", "Long", .0, 1.0),   # 2 v 2: mass
            ("b", "Short", .5, .5), ("b", "Long", .5, .5)]                                                  # full tie: label
    df = spark.createDataFrame(rows, "k string, predicted_label string, s double, l double")
    got = {r["k"]: r for r in evaluate.majority_vote(df, ["k"], ["Short", "Long"], scores={"Short": "s", "Long": "l"}).collect()}
    assert got["a"]["predicted_label"] == "Long" and got["b"]["predicted_label"] == "Long"
    assert (got["a"]["votes_Short"], got["a"]["votes_Long"]) == (2, 2)
    pred = spark.createDataFrame([("Short", "Normal"), ("Long", "Normal"), ("Normal", "Normal")], "actual_label string, predicted_label string")
    report = {r["label"]: r for r in evaluate.classification_report(pred, ["Short", "Normal", "Long"]).collect()}
    assert report["Long"]["precision"] == 0.0 and report["Long"]["support"] == 1
    assert report["macro avg"]["f1"] == pytest.approx(0.5 / 3)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(6.0,), (8.0,), (8.75,), (4.75,), (5.25,), (9.0,)], "x double")
    counts = [r["count"] for r in groups.histogram(df, "x", [4.75, 5.25, 5.75, 6.25, 6.75, 7.25, 7.75, 8.25, 8.75]).collect()]
    assert counts == [1, 1, 1, 0, 0, 0, 1, 1]


def test_zscore_of_constant_and_single_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", 2.0), ("c", 2.0), ("d", None)], "k string, x double")
    got = sorted((r["k"], round(r["x"], 4)) for r in groups.zscore_by(df, "k", ["x"]).collect())
    assert got == [("a", -0.7071), ("a", 0.7071), ("b", 0.0), ("c", 0.0), ("c", 0.0), ("d", 0.0)]


def test_impute_is_interpolating(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,), (None,)], "x double")
    assert sorted(r["x"] for r in baselines.impute_median(df, ["x"]).collect()) == [1.0, 2.0, 3.0, 4.0, 9.0]


def test_require_groups(frame):
    with pytest.raises(ValueError):
        quality.require_groups(frame[1], "subject", 31)
    assert quality.require_groups(frame[1], "subject", 30, "task", 2) is frame[1]
