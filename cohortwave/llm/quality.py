"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are counted: one over labelled good texts (the target), one over all texts (raw). The log
importance weight of a text is the log ratio of the models, taken as the mean over its n-grams times ``LENGTH``, so that texts of
different lengths compare. Adding Gumbel noise to the log weights and taking the k largest is sampling k texts without replacement in
proportion to their weights; all others are rejected. Where no k is given, it is the number of texts above the cut that
separates labelled good and poor texts best.

The n-grams are words and pairs of words, and the same of word shapes: letters, digits and marks with runs shortened, and
whether a word repeats the one before.

At most ``FIT_ROWS`` labelled rows are learned from, drawn by a hash of their id; raw counts cover every text.

Defined cases: a null text is the empty text; a text without words has log weight 0; without labelled good texts all log weights are 0;
where labels are of one kind only, or none, nothing is rejected; rows of equal id share their noise; labels that are null or belong to no
document are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import draw, materialise, settle, threshold
from .words import buffers, hash_spans, mix64, slices, split_words

BUCKETS = 1 << 14
STREAMS = 4
LENGTH = 100.0
FIT_ROWS = 20_000
SEED = 6

# Classes of bytes: lower-case letters and all of UTF-8's other bytes, upper-case letters, digits; marks and spaces stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("9")


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each text, in STREAMS ranges of BUCKETS, and the row of each."""
    data, offsets = buffers(column)
    words = split_words(data, offsets)
    word = hash_spans(data, words.start, words.end)
    kind = _CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[words.start] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    shape = hash_spans(kind[keep], place[words.start], place[words.end])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    joined = np.flatnonzero(row[1:] == row[:-1])
    again = np.zeros(len(word), np.uint64)
    again[joined + 1] = word[joined + 1] == word[joined]
    shape = mix64(shape + again)
    pair = lambda x: mix64(x[joined] * np.uint64(3) + x[joined + 1])
    streams = [word, pair(word), shape, pair(shape)]
    rows = [row, row[joined], row, row[joined]]
    mask = np.uint64(BUCKETS - 1)
    found = [(s & mask).astype(np.int64) + i * BUCKETS for i, s in enumerate(streams)]
    return np.concatenate(found), np.concatenate(rows)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, STREAMS * BUCKETS), np.int64)
    for batch in slices(batches, "text"):
        bucket, row = ngrams(batch.column("text"))
        good = batch.column("good").to_numpy(zero_copy_only=False)[row]
        total[0] += np.bincount(bucket, minlength=total.shape[1])
        total[1] += np.bincount(bucket[good], minlength=total.shape[1])
    some = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[0][some]), pa.array(total[1][some])],
                                     ["bucket", "raw", "target"])


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed models, per bucket, each stream being a distribution of its own."""
    if not target.sum():
        return np.zeros(len(raw))
    out = []
    for r, t in zip(raw.reshape(STREAMS, -1).astype(float), target.reshape(STREAMS, -1).astype(float), strict=True):
        # raw counts, scaled to the size of the target, smooth it: an n-gram that the target saw too rarely says nothing
        share = (r + 1) / (r.sum() + len(r))
        out.append(np.log((t + 50 * share + 1e-3) / (t.sum() + 50 + 1e-3 * len(t))) - np.log(share))
    return np.concatenate(out)


def weigh(ratio: np.ndarray):
    """A Column function from a text to its log importance weight."""
    @F.arrow_udf("double")
    def log_weight(text: pa.Array) -> pa.Array:
        out = []
        for part in slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]), "text"):
            bucket, row = ngrams(part.column(0))
            n = np.bincount(row, minlength=part.num_rows)
            out.append(LENGTH * STREAMS * np.bincount(row, ratio[bucket], part.num_rows) / np.maximum(n, 1))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return log_weight


def sampled_labels(labels: DataFrame, doc_id: str, label: str, rows: int, seed: int) -> DataFrame:
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    share = min(1.0, rows / max(1, known.count()))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1 << 30)) < F.lit(int((1 << 30) * share))
    return settle(known.where(drawn).groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__good")))


def learn(docs: DataFrame, sample: DataFrame, doc_id: str, text: str) -> np.ndarray:
    """The log ratio per bucket: one pass over all texts; only sums per bucket leave it."""
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(sample), "__id", "left")
    rows = rows.select(F.coalesce(F.col("__good") == 1, F.lit(False)).alias("good"), "text")
    sums = rows.mapInArrow(_counts, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(STREAMS * BUCKETS, np.int64), np.zeros(STREAMS * BUCKETS, np.int64)
    for b, r, t in sums.collect():
        raw[b], target[b] = r, t
    return log_ratio(raw, target)


def gumbel(doc_id: str, seed: int) -> Column:
    u = (draw(seed, F.col(doc_id)) + F.lit(0.5)) / F.lit(float(1 << 60))
    return -F.log(-F.log(u))


def best_cut(keys: np.ndarray, good: np.ndarray) -> float:
    """The cut with the fewest wrong rows on either side, in the middle of its gap; none between rows of one kind."""
    if not len(keys) or good.min() == good.max():
        return float("-inf")
    order = np.argsort(keys, kind="stable")
    keys, good = keys[order], good[order].astype(int)
    wrong = np.concatenate(([0], np.cumsum(good))) + np.concatenate((np.cumsum((1 - good)[::-1])[::-1], [0]))
    at = int(np.argmin(wrong))
    if at == 0:
        return float("-inf")
    return float((keys[at - 1] + keys[at]) / 2) if at < len(keys) else float(keys[-1]) + 1


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
           rows: int = FIT_ROWS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents with ``__log_weight`` and ``__key`` (with noise), and the sampled labels."""
    sample = sampled_labels(labels, doc_id, label, rows, seed)
    ratio = learn(docs, sample, doc_id, text)
    weight = weigh(ratio)(F.coalesce(F.col(text), F.lit("")))
    return docs.withColumn("__log_weight", weight).withColumn("__key", F.col("__log_weight") + gumbel(doc_id, seed)), sample


def sampled(keys: DataFrame, sample: DataFrame, k: int | None) -> Column:
    """The condition on ``__key`` under which a text is sampled. ``keys`` is a written table of (__id, __key)."""
    if k is None:
        pairs = keys.join(F.broadcast(sample), "__id").select("__key", "__good").collect()
        return F.col("__key") > F.lit(best_cut(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])))
    # the k largest keys as the k smallest places on a fine grid
    place = F.least(F.greatest(((F.lit(1e4) - F.col("__key")) * F.lit(float(1 << 40))).cast("long"), F.lit(0)), F.lit((1 << 60) - 1))
    rows = keys.select(F.lit("all").alias("g"), place.alias("place"), F.lit(1).cast("long").alias("w"))
    goals = keys.sparkSession.createDataFrame([("all", float(k))], "g string, goal double")
    return place <= F.lit(threshold(rows, settle(goals), "g", "place", "w", "goal", "last").first()["last"])


def report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
           k: int | None = None, rows: int = FIT_ROWS, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, key, kept) of every document."""
    texts, sample = scored(docs, labels, doc_id, text, label, rows, seed)
    keys = materialise(texts.select(F.col(doc_id).alias("__id"), "__log_weight", "__key"))
    return keys.select(F.col("__id").alias("doc_id"), F.col("__log_weight").alias("log_weight"), F.col("__key").alias("key"),
                       sampled(keys, sample, k).alias("kept"))


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
             k: int | None = None, rows: int = FIT_ROWS, seed: int = SEED) -> DataFrame:
    """The sampled documents, all columns kept."""
    texts, sample = scored(docs, labels, doc_id, text, label, rows, seed)
    if k is None:  # the cut needs the keys of labelled rows only
        keys = texts.join(F.broadcast(sample.select("__id")), F.col(doc_id) == F.col("__id"), "left_semi")
    else:
        keys = texts
    keys = materialise(keys.select(F.col(doc_id).alias("__id"), "__key"))
    return texts.where(sampled(keys, sample, k)).select(*docs.columns)
