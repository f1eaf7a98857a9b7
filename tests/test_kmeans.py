"""k-means from many starts in shared scans."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from cohortwave.operators import kmeans


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.7, (120, 2)) for c in ((0, 0), (3, 0), (0, 3), (4, 4), (8, 1))])
    rows = [(i, p.tolist()) for i, p in enumerate(x)] + [(1000, None)]
    return x, spark.createDataFrame(rows, "id int, x array<double>").cache()


def cost(x, centres):
    return ((x[:, None, :] - centres[None]) ** 2).sum(2).min(1).sum()


def test_no_worse_than_single_fits(blobs):
    x, frame = blobs
    centres, least = kmeans.best_of_starts(frame, 5, 20, tol=0.0)
    assert least == pytest.approx(cost(x, centres))
    vectors = frame.where("x is not null").select(array_to_vector("x").alias("features"))
    single = min(KMeans(k=5, seed=s, maxIter=100, tol=1e-9).fit(vectors).summary.trainingCost for s in range(4))
    assert least <= single + 1e-6
    got = {r.id: r.cluster for r in kmeans.assign(frame, centres).collect()}
    assert got.pop(1000) is None
    sizes = np.bincount(list(got.values()))
    assert len(sizes) == 5 and (np.diff(sizes) <= 0).all()


def test_same_on_any_number_of_partitions(blobs):
    _, frame = blobs
    (a, x), (b, y) = (kmeans.best_of_starts(frame.repartition(n), 3, 4) for n in (1, 7))
    assert np.allclose(a, b) and x == pytest.approx(y)


def test_few_distinct_rows(spark):
    frame = spark.createDataFrame([([1.0],), ([1.0],), ([5.0],)], "x array<double>")
    centres, least = kmeans.best_of_starts(frame, 3, 3)
    assert least == 0 and set(centres.ravel().tolist()) == {1.0, 5.0} and len(centres) == 3
    assert len(kmeans.best_of_starts(frame.limit(0), 3, 2)[0]) == 0
    assert {r.cluster for r in kmeans.assign(frame, np.zeros((0, 0))).collect()} == {None}


def test_draws_are_uniform_and_fixed():
    x = np.random.default_rng(2).normal(size=(5000, 3))
    u = kmeans.draws(x, np.arange(4))
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u.T) - np.eye(4)).max() < 0.05
    assert (kmeans.draws(x[::-1], np.arange(4))[::-1] == u).all() and (kmeans.draws(np.array([[-0.0]]), np.arange(1)) == kmeans.draws(np.array([[0.0]]), np.arange(1))).all()
