"""Nearest neighbours by cosine from randomly rotated one-bit codes.

Index. Unit vectors are dealt to lists by nearest centroid. A vector's offset from its centroid is rotated at random into a
space of ``BITS_PER_DIM`` times as many dimensions, and the signs are its code, packed. Beside the code stand three
correction scalars: the offset's length, its product with the centroid, and how well the code stands for the direction.
Lists are cut into chunks of about ``CHUNK`` vectors.

Search. In each chunk the inner products are estimated from the codes of all its vectors; with the error bound of ``SIGMAS`` standard
deviations, a vector whose upper bound lies below the k-th best exact score so far is skipped, all others are reranked on
their original components in double precision. A query first searches the list of its nearest centroid; with the score reached
there it goes to those lists only whose radius allows a better one. Data stay in their chunks and queries are streamed past.

The centroids are fitted on at most ``SAMPLE`` vectors; every vector is indexed.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another length than the most common one (of two as common, the longer). Equal vectors stand in the index once, with their
k + 1 smallest ids, which is all that a result can show of them. Rows of equal id are one row to their own query and
never its neighbours. An empty table or one without queries gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise, settle

NEAREST = 5
BITS_PER_DIM = 4
SIGMAS = 3.0
SAMPLE = 16_384
LIST_ROWS = 2048
MOST_LISTS = 1024
CHUNK = 4096
ROUNDS = 8
SEED = 5
FOUND = "query_id long, vec_id long, score double"


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part, as bytes of their components."""
    for batch in batches:
        column = batch.column(1)
        dtype = np.dtype("<f4") if pa.types.is_float32(column.type.value_type) else np.dtype("<f8")
        ids, size, packed = [], [], []
        for i, own in enumerate(column):
            if not own.is_valid or own.values.null_count or len(own.values) == 0:
                continue
            x = own.values.to_numpy(zero_copy_only=False).astype(dtype)
            wide = x.astype(np.float64)
            if np.isfinite(wide).all() and np.dot(wide, wide) > 0:
                ids.append(batch.column(0)[i].as_py())
                size.append(len(x))
                packed.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int32()), pa.array(packed, pa.binary())],
                                         ["vec_id", "size", "vec"])


def unpack(column: pa.Array, dtype: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dims).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """(dims, bits) with orthonormal rows: a random rotation into a space of more dimensions."""
    bits = -(-dims * BITS_PER_DIM // 64) * 64
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dims)))
    return np.ascontiguousarray(q.T)


def centroids(sample: np.ndarray, count: int, seed: int = SEED) -> np.ndarray:
    """Spherical k-means of unit vectors; an empty list keeps its centroid."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        nearest = np.argmax(sample @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, nearest, sample)
        length = np.linalg.norm(total, axis=1)
        centres = np.where(length[:, None] > 1e-9, total / np.maximum(length, 1e-9)[:, None], centres)
    return centres


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and the scalars (offset length, its product with the centroid, code quality) of unit vectors.

    ``centre`` is one row, or one per vector.
    """
    offset = x - centre
    length = np.sqrt(np.einsum("ij,ij->i", offset, offset))
    direction = (offset / np.maximum(length, 1e-12)[:, None]) @ turn
    signs = direction >= 0
    quality = np.abs(direction).sum(axis=1) / np.sqrt(turn.shape[1])
    against = np.einsum("ij,ij->i", offset, np.broadcast_to(centre, x.shape))
    return np.packbits(signs, axis=1), np.stack((length, against, np.maximum(quality, 1e-6)), 1)


def estimate(codes: np.ndarray, scalars: np.ndarray, centre: np.ndarray, query: np.ndarray, turn: np.ndarray,
             sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray]:
    """(queries, vectors) estimates of the inner products, and their error bounds."""
    bits = turn.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(bits))
    away = query - centre
    distance = np.sqrt(np.einsum("ij,ij->i", away, away))
    product = ((away @ turn).astype(np.float32) @ signs.T).astype(np.float64)
    length, against, quality = scalars.T
    value = (query @ centre)[:, None] + against + length / quality * product
    spread = length * np.sqrt(np.maximum(1 - quality**2, 0)) / quality / np.sqrt(bits - 1)
    # single precision in the product adds a little
    return value, sigmas * distance[:, None] * spread + 1e-5


def _assign(dtype: str, dims: int, centres: np.ndarray, turn: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(unpack(batch.column("vec"), dtype, dims))
            near = x @ centres.T
            nearest = np.argmax(near, axis=1)
            codes, scalars = encode(x, centres[nearest], turn)
            yield pa.RecordBatch.from_arrays([
                pa.array(nearest, pa.int32()), pa.array(near[np.arange(len(x)), nearest]), batch.column("ids"),
                batch.column("vec"), pa.array([c.tobytes() for c in codes], pa.binary()),
                pa.array([s.tobytes() for s in scalars], pa.binary())], ["list", "near", "ids", "vec", "code", "scalars"])

    return run


INDEX = "list int, near double, ids array<long>, vec binary, code binary, scalars binary"


def _route(dtype: str, dims: int, centres: np.ndarray, radius: np.ndarray, chunks: np.ndarray, first: bool):
    """Which chunks a query goes to: all of its own list, or all of the others that may hold a better score."""
    begin = np.concatenate(([0], np.cumsum(chunks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = unit(unpack(batch.column("vec"), dtype, dims))
            near = q @ centres.T
            own = np.argmax(near, axis=1)
            if first:
                least = np.full(len(q), -np.inf)
                pairs = np.stack((np.arange(len(q)), own), 1)
            else:
                least = batch.column("least").to_numpy(zero_copy_only=False)
                apart = np.maximum(np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(radius, -1, 1)), 0)
                may = np.cos(apart) >= least[:, None] - 1e-9
                may[np.arange(len(q)), own] = False
                pairs = np.argwhere(may & (chunks > 0))
            times = chunks[pairs[:, 1]]
            row = np.repeat(pairs[:, 0], times)
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            chunk = np.repeat(begin[pairs[:, 1]], times) + step
            for low in range(0, len(row), 20_000):
                r, c = row[low : low + 20_000], chunk[low : low + 20_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(c, pa.int32()), pa.array(batch.column("vec_id").to_numpy()[r]),
                    batch.column("vec").take(pa.array(r)), pa.array(least[r])], ["chunk", "query_id", "vec", "least"])

    return run


def _scan(dtype: str, dims: int, centres: np.ndarray, list_of: np.ndarray, turn: np.ndarray, k: int, sigmas: float):
    """Rows sorted by (chunk, vectors before queries): a chunk is held, its queries are streamed past."""
    def look(held: dict, query: np.ndarray, ids: np.ndarray, least: np.ndarray):
        q, data, names = unit(query), held["x"], held["ids"]
        value, error = estimate(held["codes"], held["scalars"], held["centre"], q, turn, sigmas)
        # the k + 1 best guesses give a first exact score to beat; one of them may be the query itself
        some = min(k + 1, len(data))
        guess = np.argpartition(-value, some - 1, axis=1)[:, :some]
        row = np.repeat(np.arange(len(q)), some)
        exact = np.einsum("ij,ij->i", held["unit"][guess.ravel()], q[row]).reshape(-1, some)
        own = np.isin(held["flat"], ids)
        alone = np.zeros(guess.shape, bool)
        if own.any():
            for i in range(len(q)):
                alone[i] = [len(names[j]) == 1 and names[j][0] == ids[i] for j in guess[i]]
        exact[alone] = -np.inf
        if some > k:
            kth = -np.sort(-exact, axis=1)[:, k - 1]
            least = np.maximum(least, np.where(np.isfinite(kth), kth - 1e-9, -np.inf))
        pick_q, pick_x = np.nonzero(value + error >= least[:, None])
        found = []
        for low in range(0, len(pick_q), 100_000):
            a, b = pick_q[low : low + 100_000], pick_x[low : low + 100_000]
            score = np.einsum("ij,ij->i", query[a], data[b]) / (held["query_norm"][a] * held["norm"][b])
            good = score >= least[a] - 1e-9
            found.append((a[good], b[good], score[good]))
        a, b, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
        order = np.lexsort((held["first"][b], -score, a))
        a, b, score = a[order], b[order], score[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        for i, j, s in zip(*[x[place < k + 1].tolist() for x in (a, b, score)], strict=True):
            for name in names[j]:
                if name != ids[i]:
                    yield int(ids[i]), name, s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"chunk": None}
        parts: list[pa.RecordBatch] = []

        def load():
            table = pa.Table.from_batches(parts)
            x = unpack(table.column("vec").combine_chunks(), dtype, dims)
            names = table.column("ids").to_pylist()
            held.update(
                x=x, unit=unit(x), norm=np.sqrt(np.einsum("ij,ij->i", x, x)), ids=names, first=np.array([n[0] for n in names]),
                flat=np.concatenate([np.array(n) for n in names]), centre=centres[list_of[held["chunk"]]],
                codes=np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(x), -1),
                scalars=np.frombuffer(b"".join(table.column("scalars").to_pylist()), np.float64).reshape(-1, 3))
            parts.clear()

        for batch in batches:
            chunk, is_query = batch.column("chunk").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate(([True], (chunk[1:] != chunk[:-1]) | (is_query[1:] != is_query[:-1]), [True])))
            for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if chunk[low] != held["chunk"]:
                    held.clear()
                    held["chunk"] = int(chunk[low])
                    parts.clear()
                part = batch.slice(low, high - low)
                if not is_query[low]:
                    parts.append(part.select(["ids", "vec", "code", "scalars"]))
                    continue
                if parts:
                    load()
                if "x" not in held:
                    continue
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    query = unpack(some.column("vec"), dtype, dims)
                    held["query_norm"] = np.sqrt(np.einsum("ij,ij->i", query, query))
                    rows = list(look(held, query, some.column("query_id").to_numpy(), some.column("least").to_numpy(zero_copy_only=False)))
                    if rows:
                        a, b, c = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())],
                                                         ["query_id", "vec_id", "score"])

    return run


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEAREST,
           sigmas: float = SIGMAS, sample: int = SAMPLE, list_rows: int = LIST_ROWS, chunk_rows: int = CHUNK,
           seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each row for which ``is_query``, a condition on the id, holds."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dtype = "<f4" if "float" in dict(vectors.dtypes)[embedding] else "<f8"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec")).where("vec_id is not null")
    rows = materialise(rows.mapInArrow(_valid, "vec_id long, size int, vec binary"))
    common = rows.groupBy("size").count().orderBy(F.col("count").desc(), F.col("size").desc()).first()
    if common is None:
        return empty
    dims = common[0]
    rows = rows.where(F.col("size") == dims)

    # equal vectors once, with their smallest ids; the limit holds on the map side already
    copies = Window.partitionBy("vec").orderBy("vec_id")
    distinct = materialise(rows.select("vec", "vec_id").withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
                           .groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    count = distinct.count()
    share = F.pmod(F.xxhash64(F.lit(seed), "vec"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / count)))
    fit = [r[0] for r in distinct.where(share).select("vec").limit(2 * sample).collect()] or [distinct.first()["vec"]]
    fit = unit(np.frombuffer(b"".join(sorted(map(bytes, fit))), dtype).reshape(-1, dims).astype(np.float64))
    centres = centroids(fit, int(np.clip(count // list_rows, 1, MOST_LISTS)), seed)
    turn = rotation(dims, seed)

    index = materialise(distinct.mapInArrow(_assign(dtype, dims, centres, turn), INDEX))
    lists = {r[0]: (r[1], r[2]) for r in index.groupBy("list").agg(F.count("*"), F.min("near")).collect()}
    chunks = np.array([-(-lists.get(i, (0, 0))[0] // chunk_rows) for i in range(len(centres))])
    radius = np.array([lists.get(i, (0, 1.0))[1] for i in range(len(centres))])
    begin = np.concatenate(([0], np.cumsum(chunks)))
    list_of = np.repeat(np.arange(len(chunks)), chunks)
    of_list = F.array(*[F.lit(int(c)) for c in chunks])
    from_list = F.array(*[F.lit(int(c)) for c in begin])
    data = index.select(
        (F.get(from_list, F.col("list")) + F.pmod(F.xxhash64("vec"), F.get(of_list, F.col("list")))).cast("int").alias("chunk"),
        F.lit(False).alias("is_query"), F.lit(None).cast("long").alias("query_id"), "ids", "vec", "code", "scalars",
        F.lit(None).cast("double").alias("least"))
    queries = rows.where(is_query).select("vec_id", "vec").distinct()

    def round_of(asked: DataFrame, first: bool) -> DataFrame:
        routed = asked.mapInArrow(_route(dtype, dims, centres, radius, chunks, first), "chunk int, query_id long, vec binary, least double")
        stream = data.unionByName(routed.withColumn("is_query", F.lit(True)), allowMissingColumns=True)
        parts = max(1, int(begin[-1]))
        ordered = stream.repartition(parts, "chunk").sortWithinPartitions("chunk", "is_query")
        return settle(best(ordered.mapInArrow(_scan(dtype, dims, centres, list_of, turn, k, sigmas), FOUND), k))

    near = round_of(queries, True)
    least = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    asked = queries.join(least, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    far = round_of(asked, False)
    both = near.drop("rank").unionByName(far.drop("rank"))
    return best(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
