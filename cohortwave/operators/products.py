"""Cross-product sums over many columns, one scan for all of them.

A few thousand sums in one aggregate are more than generated code takes, so each task turns
its Arrow batches into small matrices with NumPy. The matrices of a key are then added up in
two steps, so a key that appears in every partition is not added up by one task alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP_BYTES = 64 << 20  # matrices a task holds before it hands them on
SPREAD = 32


def _add_up(keys: list[str]):
    """Adds packed rows (keys, n, values) of a partition; hands on what grows too large."""
    def run(batches):
        held: dict = {}
        size = 0

        def out():
            return pd.DataFrame([(*k, n, v.tolist()) for k, (n, v) in held.items()], columns=[*keys, "n", "values"])

        for pdf in batches:
            for row in zip(*[pdf[k] for k in keys], pdf["n"], pdf["values"]):
                key, n, values = row[:-2], row[-2], np.asarray(row[-1], float)
                if key in held:
                    held[key] = (held[key][0] + n, held[key][1] + values)
                else:
                    held[key] = (n, values.copy())
                    size += values.nbytes
            if size > KEEP_BYTES:
                yield out()
                held.clear()
                size = 0
        if held:
            yield out()

    return run


def _add_up_sorted(keys: list[str]):
    """The same for rows sorted by key: holds one key at a time and gives it once."""
    def run(batches):
        key = total = None
        count = 0.0
        for pdf in batches:
            done = []
            for row in zip(*[pdf[k] for k in keys], pdf["n"], pdf["values"]):
                values = np.asarray(row[-1], float)
                if row[:-2] == key:
                    count, total = count + row[-2], total + values
                    continue
                if key is not None:
                    done.append((*key, count, total.tolist()))
                key, count, total = row[:-2], row[-2], values.copy()
            if done:
                yield pd.DataFrame(done, columns=[*keys, "n", "values"])
        if key is not None:
            yield pd.DataFrame([(*key, count, total.tolist())], columns=[*keys, "n", "values"])

    return run


def matrix_sums(df: DataFrame, keys: list[str], cols: list[str], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(keys, n, values): the sum over a key's rows of ``kernel(block)`` for blocks of its rows.

    ``kernel`` takes a block of rows (missing values are NaN) and gives a flat array that adds up.
    """
    types = dict(df.dtypes)
    spec = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema = f"{spec}, n double, values array<double>"

    def partial(batches):
        for pdf in batches:
            parts = []
            block = pdf[cols].to_numpy(float)
            for key, rows in pdf.groupby(keys, sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                parts.append((*key, float(len(rows)), kernel(block[rows]).tolist()))
            yield pd.DataFrame(parts, columns=[*keys, "n", "values"])

    add = _add_up(keys)
    return add_rows(df.select(*keys, *cols).mapInPandas(lambda b: add(partial(b)), schema), keys)


def add_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row (keys, n, values) per key from any number of them."""
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n double, values array<double>"
    add = _add_up(keys)
    return add_sums(rows.select(*keys, "n", "values").mapInPandas(add, schema), keys)


def add_sums(per_task: DataFrame, keys: list[str], then: Callable | None = None, then_schema: str = "") -> DataFrame:
    """The same where a task gives few rows per key, such as its own sums. ``then`` takes the frames of the result where they are added up.

    A task of each stage runs one Python worker, and a key's rows are held one at a time.
    """
    types = dict(per_task.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n double, values array<double>"
    add = _add_up_sorted(keys)
    slot = F.pmod(F.spark_partition_id(), F.lit(SPREAD))
    spread = per_task.withColumn("_slot", slot).repartition(*keys, "_slot").sortWithinPartitions(*keys).drop("_slot").mapInPandas(add, schema)
    last = (lambda batches: then(add(batches))) if then else add
    return spread.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(last, then_schema if then else schema)


TILE = 128  # columns of a block; a tile of two blocks is a few matrices of that size


def tile_sums(df: DataFrame, cols: list[str], kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], tile: int = TILE) -> DataFrame:
    """(i, j, n, values): the sum over all rows of ``kernel`` of column blocks i <= j, one scan for all of them.

    A task holds ``KEEP_BYTES`` of tiles and one more, whatever the number of columns, and hands on what grows beyond that.
    """
    blocks = [slice(low, min(low + tile, len(cols))) for low in range(0, len(cols), tile)]

    def partial(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        size = 0

        def out():
            for (i, j), v in held.items():
                yield pd.DataFrame({"i": [i], "j": [j], "n": [0.0], "values": [v]})

        for pdf in batches:
            rows = pdf[cols].to_numpy(float)
            for i, a in enumerate(blocks):
                for j in range(i, len(blocks)):
                    v = kernel(rows[:, a], rows[:, blocks[j]])
                    if (i, j) in held:
                        held[i, j] += v
                        continue
                    held[i, j] = v
                    size += v.nbytes
                    if size > KEEP_BYTES:
                        yield from out()
                        held.clear()
                        size = 0
        yield from out()

    return add_rows(df.select(*cols).mapInPandas(partial, "i int, j int, n double, values array<double>"), ["i", "j"])
