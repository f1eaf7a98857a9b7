"""Target-distribution importance resampling with an exact cutoff by weighted median of medians.

A text's features are its runs of one to three terms, hashed to ``BUCKETS`` counts. The log ratio of a bucket's share in the target texts
and in the raw texts, both smoothed by one, is its gain; a document's weight is the sum of its features' gains, looked up in one array. A
seeded Gumbel draw is added and the documents of highest score are drawn, so they are a weighted sample without replacement.

The score that parts drawn from undrawn documents is found without a sort of all rows: blocks of rows report the
median of what is left of them, the median of these weighted by what is left is a key below and above which at least a quarter of all remaining rows
lies, and one side goes. One job a round counts both sides and takes the medians of both, so the next round needs no job of its own. Only the winners are sorted.

Defined cases: a null or empty text has no features, weight 0, and is too short to be drawn; a null id draws as the
empty text and comes last among equal scores. Rows that agree in score and id are ordered arbitrarily and each has a rank. Texts of any length are read
whole. No documents give no rows; without target texts every bucket has the target count 0. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise, settle
from .terms import rows_of, terms
from .words import Words, slices

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
BLOCK = 1_000_000   # keys of which a task takes one median at a time
FINISH = 4_096      # keys left that are sorted at once
REWRITE = 8         # what is left is written anew when it is such a part of the table it is read from
NO_ID = (1 << 63) - 1

# --- CRC-32 of runs of terms, from the CRC-32 of single terms


def _byte_steps() -> np.ndarray:
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    return step


def _zero_tables(most: int) -> np.ndarray:
    """[n, k, b]: what byte b in place k of a checksum becomes when n zero bytes follow."""
    table = np.empty((most, 4, 256), np.uint32)
    table[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, most):
        table[n] = _STEP[table[n - 1] & 255] ^ (table[n - 1] >> 8)
    return table


def _apply(flat: np.ndarray, base: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    out = flat[base + (crc & 255)]
    for k in (1, 2, 3):
        out = out ^ flat[base + 256 * k + ((crc >> np.uint32(8 * k)) & 255)]
    return out


_STEP = _byte_steps()
_SHORT = 64
_ZEROS = _zero_tables(_SHORT + 1)


def followed_by(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The checksum's part in that of the whole when ``length`` further bytes follow; checksums of linear parts add by xor."""
    out = _apply(_ZEROS.reshape(-1), (length % _SHORT).astype(np.int64) * 1024, crc)
    rest = length // _SHORT
    table = _ZEROS[_SHORT]
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _apply(table.reshape(-1), 0, out[odd])
        table = np.stack([_apply(table.reshape(-1), 0, table[k]) for k in range(4)])
        rest = rest >> 1
    return out


def term_checksums(data: np.ndarray, words: Words, long: int = 256) -> np.ndarray:
    length = words.end - words.start
    state = np.full(len(length), 0xFFFFFFFF, np.uint32)
    live, place = np.flatnonzero(length <= long), 0
    while len(live):
        own = state[live]
        state[live] = _STEP[(own ^ data[words.start[live] + place]) & 255] ^ (own >> np.uint32(8))
        place += 1
        live = live[length[live] > place]
    state = ~state
    for i in np.flatnonzero(length > long):
        state[i] = zlib.crc32(data[words.start[i] : words.end[i]])
    return state


def run_checksums(data: np.ndarray, words: Words, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of every run of one to ``longest`` terms joined by one space, and the row of each."""
    single, length, row = term_checksums(data, words), words.end - words.start, rows_of(words)
    sums, rows, last = [single], [row], single
    for n in range(1, longest):
        same = np.flatnonzero(row[n:] == row[: len(row) - n]) if len(row) > n else np.zeros(0, int)
        if not len(same):
            break
        # `same` lists the starts of this length; those of the length before are a superset, in the same order
        before = last[same] if n == 1 else last[np.searchsorted(starts, same)]
        spaced = ~before
        spaced = ~(_STEP[(spaced ^ np.uint32(32)) & 255] ^ (spaced >> np.uint32(8)))
        last, starts = followed_by(spaced, length[same + n]) ^ single[same + n], same
        sums.append(last)
        rows.append(row[same])
    return np.concatenate(sums), np.concatenate(rows)


# --- counts, gains and scores

def _counter(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            sums, _ = run_checksums(*terms(batch.column("text")), longest)
            total += np.bincount(sums % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall in each bucket; each task adds up its own texts first."""
    parts = texts.select(F.col(text).alias("text")).mapInArrow(_counter(buckets, longest), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, per bucket."""
    size, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + size) / (float(a + 1) * float(t + size))))
                     for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _weigher(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, words = terms(batch.column("text"))
            sums, row = run_checksums(data, words, longest)
            rows = batch.num_rows
            weight = np.bincount(row, gain[sums % np.uint32(len(gain))], rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.bincount(row, minlength=rows), pa.int64()),
                 pa.array(np.diff(words.first), pa.int64()), pa.array(weight)], ["doc_id", "n_features", "words", "weight"])

    return run


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a standard Gumbel draw, rounded down, the same for a document in any order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


# --- the cutoff

def _before(score: np.ndarray, ids: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """Keys that come before ``key``: higher scores first, then smaller ids."""
    return (score > key[0]) | ((score == key[0]) & (ids < key[1]))


def _middle(score: np.ndarray, ids: np.ndarray) -> tuple[int, int, int]:
    """The median key, the earlier of two, and the number of keys."""
    at = np.lexsort((ids, -score))[(len(score) - 1) // 2]
    return int(score[at]), int(ids[at]), len(score)


def _medians(pivot: tuple[int, int] | None, block: int):
    """Per block of keys: how many come before and at the pivot, and the medians of both sides."""
    def told(score: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        if pivot is None:
            yield (1, *_middle(score, ids))
            return
        early, same = _before(score, ids, pivot), (score == pivot[0]) & (ids == pivot[1])
        if same.any():
            yield 0, *pivot, int(same.sum())
        for side, part in ((-1, early), (1, ~early & ~same)):
            if part.any():
                yield (side, *_middle(score[part], ids[part]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        out: list[tuple[int, int, int, int]] = []

        def close() -> None:
            if held:
                out.extend(told(*(np.concatenate(x) for x in zip(*held, strict=True))))
                held.clear()

        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            if size >= block:
                close()
                size = 0
        close()
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                                         ["side", "score", "id", "n"])

    return run


def _weighted_median(rows: list) -> tuple[int, int]:
    """The key up to which half of the weight lies."""
    rows = sorted(rows, key=lambda r: (-r.score, r.id))
    total, upto = sum(r.n for r in rows), 0
    for r in rows:
        upto += r.n
        if 2 * upto >= total:
            return r.score, r.id
    raise ValueError("no keys")


def cutoff(keys: DataFrame, k: int, block: int = BLOCK, finish: int = FINISH, rewrite: int = REWRITE) -> tuple[int, int]:
    """The k-th key (score, id) of a written table of keys, by falling score and rising id; k is at least 1 and at most their number.

    The driver sees one median per block and side. ``finish`` keys or fewer are sorted at once.
    """
    def tell(pivot: tuple[int, int] | None) -> list:
        return keys.mapInArrow(_medians(pivot, block), "side int, score long, id long, n long").collect()

    rows = tell(None)
    left = written = sum(r.n for r in rows)
    if not 1 <= k <= left:
        raise ValueError(f"there are {left} keys, the {k}-th is asked for")
    while left > finish:
        pivot = _weighted_median(rows)
        told = tell(pivot)
        early, same = (sum(r.n for r in told if r.side == s) for s in (-1, 0))
        if early < k <= early + same:
            return pivot
        here = F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))
        there = F.struct(F.lit(-pivot[0]).cast("long").alias("s"), F.lit(pivot[1]).cast("long").alias("i"))
        if k <= early:
            keys, rows, left = keys.where(here < there), [r for r in told if r.side < 0], early
        else:
            keys, rows, left = keys.where(here > there), [r for r in told if r.side > 0], left - early - same
            k -= early + same
        if left * rewrite <= written and left > finish:
            keys, written = materialise(keys), left
    last = keys.orderBy(F.col("score").desc(), "id").limit(k).collect()[-1]
    return last.score, last.id


def ranked(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """1-based place of each row in the order: sorted by range, numbered within partitions, shifted by the rows before."""
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(out, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(out), 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.col(out).bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.withColumn("_part", part).join(F.broadcast(before), "_part")
            .withColumn(out, (inside + F.col("_before") + 1).cast("long")).drop("_part", "_before"))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST,
             seed: int = SEED, **options) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it is not drawn.

    Of the N documents with at least ``least_words`` terms, floor(percent N / 100) are drawn.
    """
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    weighed = texts.mapInArrow(_weigher(gain, longest), "doc_id long, n_features long, words long, weight long")
    rows = materialise(weighed.withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long")))
    large = F.col("words") >= least_words
    k = percent * rows.where(large).count() // 100
    plain = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    if k == 0:
        return rows.select(*plain, undrawn)
    key = F.coalesce("doc_id", F.lit(NO_ID))
    score, last = cutoff(rows.where(large).select("score", key.alias("id")), k, **options)
    drawn = large & ((F.col("score") > score) | ((F.col("score") == score) & (key <= last)))
    winners = ranked(rows.where(drawn).select(*plain), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    # rows that agree with the cutoff in score and id may be more than are wanted
    winners = winners.select(*plain, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return winners.unionByName(rows.where(~drawn).select(*plain, undrawn))
