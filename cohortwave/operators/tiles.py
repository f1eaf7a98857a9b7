"""Work on all pairs of rows, or of columns, tile by tile.

No pair is a row: rows are packed into blocks, a block meets a run of others in one task, and only sums leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import attach, materialise, settle

BLOCK_ROWS = 1024
RUN = 128          # blocks that a group of blocks meets in one task
GROUPS = 24        # groups that blocks are dealt to, each of at most GROUP_BLOCKS: the copies of a block that are shuffled
GROUP_BLOCKS = 128


def _pack(rows: int, number: str):
    """Rows (x, g) to blocks: points as one matrix, the numbers of their clusters, and how many they are."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for low in range(0, len(pdf), rows):
                part = pdf.iloc[low : low + rows]
                out.append((np.stack(part["x"].to_numpy()).astype(number).tobytes(), part["g"].to_numpy(np.int64).tobytes(), len(part)))
            yield pd.DataFrame(out, columns=["x", "g", "n"])

    return run


def _distance_sums(clusters: int, number: str):
    """Blocks sorted by (task, kind): a group's blocks, then those they meet. Gives the sums of the distances of the group's rows to each cluster's."""
    def told(held, sums) -> Iterator[pd.DataFrame]:
        for (place, _, g), s in zip(held, sums, strict=True):
            yield pd.DataFrame({"own": place, "at": np.arange(len(g)), "g": g, "sums": list(s)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, sums = None, [], []
        for pdf in batches:
            for name, kind, place, x, g, n in zip(pdf["task"], pdf["kind"], pdf["place"], pdf["x"], pdf["g"], pdf["n"]):
                if name != key:
                    yield from told(held, sums)
                    key, held, sums = name, [], []
                points, groups = np.frombuffer(x, number).reshape(n, -1), np.frombuffer(g, np.int64)
                if kind == 0:
                    held.append((place, points, groups))
                    sums.append(np.zeros((n, clusters)))
                    continue
                b = points.astype(float)
                inside = [(c, groups == c) for c in np.unique(groups)]
                for (_, own, _), total in zip(held, sums, strict=True):
                    a = own.astype(float)
                    d = np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0.0))
                    # a product of sums has little left of small distances: those are taken from the differences
                    i, j = np.nonzero(d * d < 1e-6 * ((a * a).sum(1)[:, None] + (b * b).sum(1)))
                    d[i, j] = np.sqrt(((a[i] - b[j]) ** 2).sum(axis=1))
                    for c, at in inside:
                        total[:, c] += d[:, at].sum(axis=1)
        yield from told(held, sums)

    return run


def silhouettes(df: DataFrame, cluster: str, x: str, block_rows: int = BLOCK_ROWS, run: int = RUN, groups: int = GROUPS) -> DataFrame:
    """(cluster, silhouette) per row, by Euclidean distance: the nearest other cluster's mean distance less the own one's, over the larger.

    ``x`` is an array column. A cluster of one row has 0. The work is the square of the number of rows, spread over (group of blocks, run of blocks)
    tasks. What is shuffled is every block once per group and once per run of ``run`` blocks, and a number per row, run and cluster: groups are as many for a
    larger table, and only above ``groups`` times GROUP_BLOCKS blocks become more, so that what a task holds stays bounded.
    """
    spark = df.sparkSession
    known = df.where(F.col(cluster).isNotNull() & F.col(x).isNotNull())
    sizes = known.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).orderBy(cluster).collect()
    if len(sizes) < 2:
        raise ValueError("at least two clusters are needed")
    kind = df.schema[cluster].dataType.simpleString()
    single = df.schema[x].dataType.elementType.simpleString() == "float"
    wide, number = ("float", "<f4") if single else ("double", "<f8")  # blocks hold the numbers as they are; distances are of doubles
    numbers = spark.createDataFrame([(r[0], i) for i, r in enumerate(sizes)], f"_c {kind}, g int")
    rows = attach(known.select(F.col(cluster).alias("_c"), F.col(x).cast(f"array<{wide}>").alias("x")), numbers, ["_c"])
    blocks = rows.select("x", "g").mapInPandas(_pack(block_rows, number), "x binary, g binary, n int")
    blocks = materialise(blocks.withColumn("block", F.monotonically_increasing_id()))
    order = {r["block"]: i for i, r in enumerate(blocks.select("block").orderBy("block").collect())}
    place = spark.createDataFrame(list(order.items()), "block long, place int")
    blocks = blocks.join(F.broadcast(place), "block").drop("block")
    runs = max(1, -(-len(order) // run))
    groups = max(1, min(len(order), max(groups, -(-len(order) // GROUP_BLOCKS))))
    task = lambda group, part: (group * F.lit(runs) + part).cast("int").alias("task")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    heads = blocks.withColumn("part", each(runs)).select(
        task(F.col("place") % groups, F.col("part")), F.lit(0).alias("kind"), "place", "x", "g", "n")
    mates = blocks.withColumn("group", each(groups)).select(
        task(F.col("group"), F.floor(F.col("place") / run)), F.lit(1).alias("kind"), "place", "x", "g", "n")
    met = heads.unionByName(mates).repartitionById(groups * runs, F.col("task")).sortWithinPartitions("task", "kind")
    told = met.mapInPandas(_distance_sums(len(sizes), number), "own int, at int, g int, sums array<double>")
    added = told.groupBy("own", "at", "g").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"_s{i}") for i in range(len(sizes))])
    n = [r["n"] for r in sizes]
    inside = F.get(F.array(*[F.try_divide(F.col(f"_s{i}"), F.lit(float(n[i] - 1))) for i in range(len(n))]), F.col("g"))
    outside = F.array_min(F.array(*[F.when(F.col("g") != i, F.col(f"_s{i}") / n[i]) for i in range(len(n))]))
    score = F.when(inside.isNull(), 0.0).otherwise(F.coalesce(F.try_divide(outside - inside, F.greatest(outside, inside)), F.lit(0.0)))
    return added.join(F.broadcast(numbers), "g").select(F.col("_c").alias(cluster), score.alias("silhouette"))


def euclidean_silhouette(df: DataFrame, cluster: str, x: str = "x", **options) -> DataFrame:
    """One row: the mean silhouette of all rows."""
    return settle(silhouettes(df, cluster, x, **options)).agg(F.avg("silhouette").alias("silhouette"))
