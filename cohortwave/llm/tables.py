"""Spark steps that several operators share: positions, thresholds by cumulative weight, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import attach, fits_broadcast, gather, materialise, per_partition, picked, rows_of, settle, together  # noqa: F401

BUCKET_BITS = 16
KEY_BITS = 60
LINK_ROWS = 100_000  # links that a task of ``components`` keeps


def draw(seed: int, *columns: Column) -> Column:
    """A seeded draw of 60 bits per row, the same in any order and on any number of partitions.

    It is taken from an MD5 so that other SQL engines can repeat it.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def key_of(column: Column) -> Column:
    """A non-null string key, different for null and for every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def positions(values: DataFrame, column: str, out: str) -> DataFrame:
    """0-based place of each row of a one-row-per-value table, by code point, null last.

    Rows are dealt by range and numbered within their partition; only partition sizes are summed up.
    """
    part = settle(values.repartitionByRange(F.col(column).asc_nulls_last())
                  .withColumn("_part", F.spark_partition_id()))
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(column).asc_nulls_last()))
    return (part.withColumn(out, inside).join(F.broadcast(before), "_part")
            .withColumn(out, (F.col(out) - 1 + F.col("_before")).cast("long")).drop("_part", "_before"))


def threshold(rows: DataFrame, goals: DataFrame, group: str, key: str, weight: str, goal: str, out: str) -> DataFrame:
    """Per group the key up to which the weights, in order of key, come nearest to ``goal``; -1 for none.

    ``rows`` is a written table of (group, key of KEY_BITS bits, weight). Weights are summed per leading bits of the
    key first, which combines on the map side however large a group is; only rows of the one bucket in which the
    goal falls, a 65,536th of the group, are put in order. Rows of equal key stay together.
    """
    bucket = F.shiftrightunsigned(key, KEY_BITS - BUCKET_BITS)
    sums = rows.groupBy(group, bucket.alias("_b")).agg(F.sum(weight).alias("_w"))
    upto = sums.withColumn("_upto", F.sum("_w").over(Window.partitionBy(group).orderBy("_b")))
    cut = (upto.join(goals.select(group, goal), group).where((F.col(goal) > 0) & (F.col("_upto") >= F.col(goal)))
           .groupBy(group, goal).agg(F.min(F.struct("_b", (F.col("_upto") - F.col("_w")).alias("_before"))).alias("_c"))
           .select(group, goal, F.col("_c._b").alias("_b"), F.col("_c._before").alias("_before")))
    cut = settle(cut)
    near = rows.withColumn("_b", bucket)
    near = near.join(F.broadcast(cut) if fits_broadcast(cut) else cut, [group, "_b"])
    keys = near.groupBy(group, "_b", goal, "_before", key).agg(F.sum(weight).alias("_w"))
    run = F.col("_before") + F.sum("_w").over(Window.partitionBy(group, "_b").orderBy(key))
    taken = (keys.withColumn("_run", run).where(2 * F.col("_run") - F.col("_w") <= 2 * F.col(goal))
             .groupBy(group).agg(F.max(key).alias("_last")))
    edge = cut.join(taken, group, "left").select(group, F.coalesce(
        "_last", F.shiftleft(F.col("_b").cast("long"), KEY_BITS - BUCKET_BITS) - 1).alias(out))
    # a goal above the whole weight takes all rows; no goal takes none
    rest = goals.join(edge, group, "left").select(
        group, F.when(F.col(goal) <= 0, F.lit(-1)).otherwise(F.coalesce(out, F.lit(1 << KEY_BITS))).cast("long").alias(out))
    return settle(rest)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) that connect what the given links connect."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links in one task: (node, root) of their nodes."""
    held = [(np.zeros(0, np.int64),) * 2, *([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)] for batch in batches)]
    u, v = (np.concatenate(c) for c in zip(*held, strict=True))
    if len(u):
        node, root = spanning(u, v)
        tops = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((node, tops))), pa.array(np.concatenate((root, tops)))], ["node", "root"])


def components(links: DataFrame, a: str, b: str, most: int = LINK_ROWS) -> DataFrame:
    """(node, root) for each node of the links, which are longs, root being the smallest node that can be reached.

    Up to ``most`` links are joined in one task, which takes less than dealing them out once. Of more, two steps alternate until nothing changes: each node hooks its larger neighbours on its smallest one, then
    its smaller neighbours. Both keep connectivity, never add a link, and end in stars after about log2 n rounds.
    Hot nodes are safe: minima combine on the map side, and links are joined to them, not gathered.
    """
    def turned(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    links = gather(links)
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    if rows_of(links) <= most:
        return pairs.coalesce(1).mapInArrow(_stars, "node long, root long")
    few = per_partition(rows_of(links), LINK_ROWS)  # links never grow, so as many pieces do for all rounds
    edges = settle(turned(pairs).coalesce(few)).coalesce(few)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").where("v > u").select("v", "m")
        large = settle(turned(large.select(F.col("v").alias("u"), F.col("m").alias("v"))).coalesce(few)).coalesce(few)
        low = large.join(smallest(large), "u")
        small = turned(low.select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .unionByName(low.select("u", F.col("m").alias("v"))))
        small = settle(small.coalesce(few)).coalesce(few)
        same = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if same == small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first():
            break
        edges = small
    members = small.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def join_skewed(rows: DataFrame, values: DataFrame, key: str | list[str], count: str, most: int = 2000) -> DataFrame:
    """Inner join of written rows with one row per key, which holds the key's number of rows in ``count``.

    Gathered values that fit are broadcast. Else keys that hold more than a ``most``-th of all rows are fewer than ``most``: they are broadcast
    and their rows stay where they are. All others are joined by a shuffle, in which none is hot.
    """
    keys = [key] if isinstance(key, str) else key
    names = [c for c in values.columns if c not in (*keys, count)]
    if rows_of(values) is not None and fits_broadcast(values):
        return rows.join(F.broadcast(values.select(*keys, *names)), keys)
    total = values.agg(F.sum(count)).first()[0] or 0
    large = values.where(F.col(count) * most > total)
    near = rows.join(F.broadcast(large.select(*keys, *names)), keys)
    far = (rows.join(F.broadcast(large.select(*keys)), keys, "left_anti")
           .join(values.where(F.col(count) * most <= total).select(*keys, *names), keys))
    return near.unionByName(far)


def one_row_each(docs: DataFrame, each: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of ``docs`` per root of ``each``, which has (doc_id, text_key as the MD5 of the text, root) per row.

    It is the row of smallest id, no id last, then of smallest text digest; of rows equal in both, any one.
    """
    rows = each.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")).alias("s")
    kept = settle(rows.groupBy("root").agg(first).select(F.col("s.doc_id").alias("__id"), F.col("s.text_key").alias("__key"),
                                                        F.col("s.n").alias("__n")))
    own, key = F.col(doc_id).cast("long"), F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    same = own.eqNullSafe(F.col("__id")) & (key == F.col("__key"))
    once = docs.join(kept.where("__n = 1"), same, "left_semi")
    repeated = kept.where("__n > 1")
    if repeated.isEmpty():
        return once
    many = docs.join(repeated, same, "left_semi").withColumns({"__id": own, "__key": key})
    return once.unionByName(many.dropDuplicates(["__id", "__key"]).drop("__id", "__key"))
