"""The ways taken for large groups give the same rows as the plain ones."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwave.operators import quantiles, sampling, scale, segments
from cohortwave.operators.folds import group_kfold
from cohortwave.operators.groups import average_rank, mann_whitney


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, a third of those at one value, and some missing values."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{rng.randrange(40)}"
        x = None if rng.random() < 0.03 else (7.0 if rng.random() < 0.33 else round(rng.expovariate(0.01), 3))
        rows.append((i, g, x, rng.gauss(0, 1)))
    return spark.createDataFrame(rows, "id long, g string, x double, y double").repartition(8).cache()


def test_row_numbers_split_hot_groups(skewed):
    plain = scale.row_numbers(skewed, ["g"], ["x", "id"], "n")
    for limit in (50, 200):
        assert rows_of(scale.row_numbers(skewed, ["g"], ["x", "id"], "n", limit=limit), "id", "n") == rows_of(plain, "id", "n")


def test_running_counts_split_hot_groups(skewed):
    counts = skewed.where("x is not null").groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    plain = scale.running_counts(counts, ["g"], "x", ["n"])
    split = scale.running_counts(counts, ["g"], "x", ["n"], limit=20)
    assert rows_of(plain, "g", "x", "n_before") == rows_of(split, "g", "x", "n_before")


@pytest.mark.parametrize("limit", [10, 100])
def test_quantiles_of_hot_groups_are_exact(skewed, limit):
    wanted = {"q1": ("x", 0.25), "q2": ("x", 0.5), "q3": ("x", 0.75), "my": ("y", 0.5)}
    plain = quantiles.quantile_agg(skewed, ["g"], wanted, [F.count("x").alias("n")])
    split = quantiles.quantile_agg(skewed, ["g"], wanted, [F.count("x").alias("n")], limit=limit)
    a, b = (rows_of(d, "g", "n", *wanted) for d in (plain, split))
    assert len(a) == len(b) == skewed.select("g").distinct().count()
    for r, s in zip(a, b):
        assert r[:2] == s[:2] and r[2:] == pytest.approx(s[2:], abs=1e-12)


def test_quantile_of_the_whole_table_and_of_missing_groups(spark, skewed):
    whole = quantiles.quantile_agg(skewed, [], {"m": ("x", 0.5)}, limit=100).first()["m"]
    assert whole == skewed.agg(F.median("x")).first()[0]
    empty = skewed.withColumn("x", F.when(F.col("g") != "hot", F.col("x")))
    got = {r["g"]: r["m"] for r in quantiles.quantile_agg(empty, ["g"], {"m": ("x", 0.5)}, limit=100).collect()}
    assert got["hot"] is None and len(got) == 41


def test_attach_beyond_the_broadcast_bound(skewed):
    means = skewed.groupBy("g").agg(F.avg("y").alias("m"))
    plain = scale.attach(skewed, means, ["g"])
    salted = scale.attach(skewed, means, ["g"], rows=3)
    assert "Broadcast" in plain._jdf.queryExecution().toString()
    assert rows_of(plain, "id", "m") == rows_of(salted, "id", "m")
    kept = scale.attach(skewed, means.where("g <> 'hot'"), ["g"], "left", rows=3)
    assert kept.count() == skewed.count()
    assert scale.attach(skewed, means.where("g = 'hot'"), ["g"], "left_semi", rows=0).count() == 1000


def test_segment_join_by_time_slot(spark):
    rng = random.Random(5)
    rec = spark.createDataFrame([(rng.choice("aab"), i, rng.randrange(-500, 5000)) for i in range(2000)],
                                "subject string, id long, ts long")
    segs = []
    for m in range(40):
        start = rng.randrange(-500, 4900)
        segs.append((rng.choice("aabc"), m, start, start + rng.choice([1, 5, 50, 3000])))
    seg = spark.createDataFrame(segs, "subject string, marker_id long, t_start long, t_end long")
    plain = segments.segment_join(rec, seg)
    slots = segments.segment_join(rec, seg, rows=2)
    assert plain.count() > 1000
    assert rows_of(plain, "id", "marker_id") == rows_of(slots, "id", "marker_id")


def test_ranks_of_hot_groups(skewed):
    assert rows_of(average_rank(skewed, ["g"], "x").where("x is not null"), "id", "rank") == \
        rows_of(average_rank(skewed, ["g"], "x", limit=20).where("x is not null"), "id", "rank")
    two = skewed.withColumn("grp", F.when(F.col("g") == "hot", "a").otherwise("b"))
    plain = mann_whitney(two, "grp", ["a", "b"], ["x", "y"])
    split = mann_whitney(two, "grp", ["a", "b"], ["x", "y"], limit=50)
    assert rows_of(plain, "feature", "u", "n1", "n2") == rows_of(split, "feature", "u", "n1", "n2")


def test_matrix_sums_hand_on_early(spark, skewed, monkeypatch):
    from cohortwave.operators import products
    rows = skewed.where("x is not null").select("g", "x", "y")
    kernel = lambda block: block.sum(axis=0)
    want = {r["g"]: r for r in rows.groupBy("g").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("x").alias("n")).collect()}
    for keep in (products.KEEP_BYTES, 1):
        monkeypatch.setattr(products, "KEEP_BYTES", keep)
        got = products.matrix_sums(rows, ["g"], ["x", "y"], kernel).collect()
        assert len(got) == len(want)
        for r in got:
            w = want[r["g"]]
            assert r["n"] == w["n"] and r["values"] == pytest.approx([w["x"], w["y"]])


def test_medians_of_train_sets(spark, skewed):
    from cohortwave.operators import baselines
    rows = skewed.withColumn("fold", F.pmod(F.col("id"), F.lit(7)).cast("int"))
    plain = baselines.impute_median(rows, ["x"], "fold")
    first = rows.where("fold <> 0").agg(F.median("x")).first()[0]
    filled = plain.join(rows.where("x is null").select("id"), "id").where("fold = 0").first()["x"]
    assert filled == pytest.approx(first)


@pytest.mark.parametrize("k", [2, 5, 60])
def test_medians_of_many_train_sets(spark, k):
    """Ties, missing values, folds without any value, and as many folds as rows."""
    from cohortwave.operators import baselines
    rng = np.random.default_rng(k)
    pdf = pd.DataFrame({"id": range(60), "fold": [f"f{i % k}" for i in range(60)], "a b": rng.integers(0, 6, 60).astype(float),
                        "c": rng.normal(size=60), "none": np.nan})
    pdf.loc[rng.random(60) < 0.3, "a b"] = np.nan
    pdf.loc[pdf.fold == "f1", "c"] = np.nan
    frame = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id int, fold string, `a b` double, c double, none double")
    medians = {r["fold"]: list(r["medians"]) for r in baselines.fold_medians(frame, ["a b", "c", "none"], "fold").collect()}
    assert len(medians) == k
    for f, got in medians.items():
        rest = pdf[pdf.fold != f]
        want = [rest[c].dropna().median() if rest[c].notna().any() else None for c in ("a b", "c", "none")]
        assert [x is None for x in got] == [x is None for x in want] and [x for x in got if x is not None] == pytest.approx([x for x in want if x is not None])
    out = {r["id"]: r for r in baselines.impute_median(frame, ["a b", "c", "none"], "fold").collect()}
    assert len(out) == 60 and all(r["none"] is None for r in out.values())
    assert all(out[i]["c"] == (pdf.c[i] if pdf.c[i] == pdf.c[i] else medians[pdf.fold[i]][1]) for i in range(60))



def test_draws_do_not_depend_on_partitions(skewed):
    one = sampling.random_rank(skewed.repartition(1), ["g"], 42, ["id"])
    many = sampling.random_rank(skewed.repartition(13), ["g"], 42, ["id"], slots=3)
    assert rows_of(one, "id", "rank") == rows_of(many, "id", "rank")


def test_group_folds_with_a_hot_group(skewed):
    folded = group_kfold(skewed, "g", 5)
    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    assert folded.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert sizes[1] == 1000 and sum(sizes.values()) == 3000
    rest = [sizes[f] for f in (2, 3, 4, 5)]
    assert max(rest) - min(rest) < 60


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(_key, default=None):
                return default

    with pytest.raises(RuntimeError):
        scale.shared_dir(Session)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("salts", [1, 32])
def test_a_side_measured_as_large_is_not_broadcast(spark, tmp_path, how, salts):
    """A file of few bytes and many rows looks small to the planner; copies of its rows look no larger."""
    spark.range(20_000).selectExpr("id AS g", "1.5D AS v").write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    big = spark.range(50_000).selectExpr("id", "id % 30000 AS g")
    got = scale.attach(big, small, ["g"], how, rows=10, salts=salts)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(small, "g", how).select(got.columns).collect()))


def test_many_segments_are_not_broadcast(spark, tmp_path):
    spark.range(5_000).selectExpr("id % 50 AS subject", "id AS marker_id", "id * 10 AS t_start", "id * 10 + 25 AS t_end").write.parquet(str(tmp_path / "seg"))
    seg, rec = spark.read.parquet(str(tmp_path / "seg")), spark.range(50_000).selectExpr("id % 50 AS subject", "id AS ts")
    got = segments.segment_join(rec, seg, rows=10)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows_of(got, "subject", "ts", "marker_id") == rows_of(segments.segment_join(rec, seg), "subject", "ts", "marker_id")
