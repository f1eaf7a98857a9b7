"""Silhouettes, correlations, bootstrap and map order against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwave.operators import correlation, groups, products, subjects, tiles
from cohortwave.operators.agglomerate import ward


def test_silhouette_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 1, (n, 3)) for c, n in ((0, 40), (3, 25), (6, 1))])
    x[5] = x[4]
    g = np.repeat(["a", "b", "c"], [40, 25, 1])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(66):
        own = g == g[i]
        if own.sum() == 1:
            want.append(0.0)
            continue
        a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, g == h].mean() for h in set(g) - {g[i]})
        want.append((b - a) / max(a, b))
    rows = [(str(h), p.tolist()) for h, p in zip(g, x)] + [(None, [0.0, 0.0, 0.0]), ("a", None)]
    frame = spark.createDataFrame(rows, "g string, x array<double>").repartition(3)
    for options in ({}, {"block_rows": 7, "run": 2}):
        got = tiles.silhouettes(frame, "g", "x", **options).collect()
        assert sorted(r["silhouette"] for r in got) == pytest.approx(sorted(want)) and len(got) == 66
    assert tiles.euclidean_silhouette(frame, "g").first()["silhouette"] == pytest.approx(np.mean(want))
    with pytest.raises(ValueError, match="two clusters"):
        tiles.silhouettes(frame.where("g = 'a'"), "g", "x")


def test_silhouette_copies_a_block_once_per_group(spark, monkeypatch):
    """Many blocks in few groups give the same, from single-precision vectors too; a group's size is bounded."""
    rng = np.random.default_rng(2)
    x, g = rng.normal(0, 1, (90, 4)).astype(np.float32), np.arange(90) % 3
    frame = spark.createDataFrame([(int(h), p.tolist()) for h, p in zip(g, x)], "g int, x array<float>").repartition(3)
    want = tiles.euclidean_silhouette(frame.select("g", F.col("x").cast("array<double>").alias("x")), "g").first()[0]
    for most in (128, 5):
        monkeypatch.setattr(tiles, "GROUP_BLOCKS", most)
        got = tiles.euclidean_silhouette(frame, "g", block_rows=2, run=9, groups=3).first()[0]
        assert got == pytest.approx(want, abs=1e-12)


def test_correlation_of_a_thousand_columns(spark):
    """Tiles of 128 columns: a task holds KEEP_BYTES of them and one more, 67 MB, where a whole array would be 48 MB per thousand columns squared."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 1000))
    x[:, 500:] += x[:, :500]
    names = [f"c{i}" for i in range(1000)]
    got = correlation.corr_matrix(spark.createDataFrame(pd.DataFrame(x, columns=names)), names).toPandas()
    assert len(got) == 1_000_000
    r = got.assign(a=got.a.str[1:].astype(int), b=got.b.str[1:].astype(int)).sort_values(["a", "b"]).r.to_numpy(float).reshape(1000, 1000)
    assert np.allclose(r, np.corrcoef(x.T))


def test_tiles_with_gaps_and_constant_columns(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(50, 7)), columns=list("abcdefg")).assign(f=5.0)
    pdf = pdf.where(rng.random(pdf.shape) > 0.2)
    pdf["g"] = np.nan
    frame = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf)).repartition(3)
    monkeypatch.setattr(products, "KEEP_BYTES", 1)
    got = {(r["a"], r["b"]): r["r"] for r in correlation._pairwise(frame, list(pdf), 3).collect()}
    want = pdf.corr(min_periods=2)
    assert len(got) == 49
    for (a, b), r in got.items():
        if "f" in (a, b) or "g" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b])


def test_bootstrap_intervals(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], 400), "x": rng.normal(2, 3, 800), "y": np.nan, "id": range(800)})
    pdf.loc[:9, "x"] = np.nan
    frame = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, x double, y double, id int")
    got = {(r["g"], r["feature"]): r for r in groups.bootstrap_mean(frame, ["g"], ["x", "y"], ["id"]).collect()}
    again = {(r["g"], r["feature"]): r for r in groups.bootstrap_mean(frame.repartition(5), ["g"], ["x", "y"], ["id"]).collect()}
    for g in "ab":
        own = pdf[pdf.g == g].x.dropna()
        r = got[g, "x"]
        sem = own.std() / np.sqrt(len(own))
        assert r["n"] == len(own) and r["mean"] == pytest.approx(own.mean())
        assert (r["high"] - r["low"]) / 2 == pytest.approx(0.994 * sem, rel=0.1) and abs((r["high"] + r["low"]) / 2 - r["mean"]) < 0.15 * sem
        assert again[g, "x"]["low"] == pytest.approx(r["low"]) and got[g, "y"]["low"] is None and got[g, "y"]["n"] == 0
    w = groups.bootstrap_weights(rng.integers(0, 2**28, 4000), 50, 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w.T) - np.eye(50)).max() < 0.09


def test_map_order_against_plain_trees(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i}", f"t{j}", *[None if rng.random() < 0.05 else float(v) for v in rng.normal(size=4)], None if i == 1 else 1.0)
            for i in range(4) for j in range(9) for _ in range(2)] + [("few", "t1", 1.0, 2.0, 3.0, 4.0, 5.0), (None, "t1", 1.0, 2.0, 3.0, 4.0, 5.0)]
    metrics = ["p", "q", "r", "s", "flat"]
    frame = spark.createDataFrame(rows, "subject string, task string, p double, q double, r double, s double, flat double")
    got = {}
    for r in subjects.map_order(frame, metrics).collect():
        got.setdefault((r["subject"], r["axis"]), {})[r["position"]] = r["name"]
    assert {k[0] for k in got} == {"s0", "s1", "s2", "s3"}
    pdf = frame.toPandas()
    for sid in ("s0", "s1", "s2", "s3"):
        table = pdf[pdf.subject == sid].groupby("task")[metrics].mean().dropna(axis=1, how="all").dropna(axis=0, how="any")
        scaled = (table - table.min()) / (table.max() - table.min()).replace(0, 1)

        def order(frame):
            merges, inside = ward(np.ones(len(frame)), frame.to_numpy(float)), {i: [i] for i in range(len(frame))}
            for i, (a, b, _, _) in enumerate(merges):
                inside[len(frame) + i] = inside[int(a)] + inside[int(b)]
            return [frame.index[i] for i in inside[max(inside)]]

        assert list(dict(sorted(got[sid, "task"].items())).values()) == order(scaled)
        assert list(dict(sorted(got[sid, "metric"].items())).values()) == order(scaled.T.sort_index())
        assert ("flat" in got[sid, "metric"].values()) == (sid != "s1")
