"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

Documents are searched in blocks of a few MB. A block's postings of the items' terms are listed per term, in order of
document, with each document's share of the score and the largest share of the list. For an item, the short lists are
added up term at a time into one list of accumulators, which from then on is one more list with a bound of its own. That list and the
long ones are then met document at a time: lists whose bounds together cannot reach the item's twentieth score so far give no
candidates, and are only looked up, by binary search, for candidates that can still get there. The twenty best go from block to block
and end as twenty rows per item and task, of which a window per item takes the best.

Scores are whole numbers, so sums agree in any order. Terms are told apart by 64-bit hashes.

Defined cases: a null text has no terms, and such a document is not counted; a null or empty item finds nothing. Rows of equal item id
are one item of all their terms; a null item id is an item too. Repeated rows of ``docs`` are documents of their own. Equal scores go by id, null last. Texts
of any length are read whole, a text longer than a block is a block. Items are searched ``ITEM_BYTES`` at a time, each part against all documents.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise
from .terms import rows_of, terms
from .words import hash_words, slices

TOP = 20
BLOCK_BYTES = 4_000_000
ITEM_BYTES = 16_000_000
SHORT = 16      # lists of at most a block's documents over this are added up term at a time
STRIDE = 1024   # documents met between two looks at the threshold
LIKELY = 1 << 20


@dataclass
class Items:
    """Items of one part: the known terms' hashes in order, and per item the places of its terms and their repeats."""

    hashes: np.ndarray
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    likely: np.ndarray = field(init=False)

    def __post_init__(self):
        self.likely = np.zeros(LIKELY, bool)
        self.likely[self.hashes & np.uint64(LIKELY - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and their places."""
        some = np.flatnonzero(self.likely[hashes & np.uint64(LIKELY - 1)])
        if not len(self.hashes) or not len(some):
            return np.zeros(0, int), np.zeros(0, int)
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        ok = self.hashes[at] == hashes[some]
        return some[ok], at[ok]


@dataclass
class Postings:
    """A block's documents per term: those of term t are ``docs[first[t] : first[t + 1]]``, in order."""

    first: np.ndarray
    docs: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray
    """Terms of each document, known or not."""


def postings(column: pa.Array, items: Items) -> Postings:
    data, words = terms(column)
    found, term = items.find(hash_words(data, words))
    row, rows = rows_of(words)[found], len(column)
    pairs, counts = np.unique(term * rows + row, return_counts=True)
    first = np.searchsorted(pairs, np.arange(len(items.hashes) + 1) * max(rows, 1))
    return Postings(first, pairs % max(rows, 1), counts, np.diff(words.first))


@dataclass
class Statistics:
    documents: int
    length: int
    holding: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * d + 1))) for d in self.holding.tolist()], np.int64)

    def norms(self, sizes: np.ndarray) -> np.ndarray:
        return np.array([75 + 25 * n * self.documents // self.length if n else 75 for n in sizes.tolist()], np.int64)


def shares(block: Postings, statistics: Statistics, weights: np.ndarray) -> np.ndarray:
    """What each posting adds to the score of its document, per repeat of the term in an item."""
    m = statistics.norms(block.sizes)[block.docs]
    term = np.repeat(np.arange(len(block.first) - 1), np.diff(block.first))
    return weights[term] * (1_000_000_000 * block.counts // (1000 * block.counts + 12 * m))


# --- one item in one block

def accumulate(docs: list[np.ndarray], scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lists added up term at a time: documents in order, and their sums."""
    if len(docs) == 1:
        return docs[0], scores[0]
    every = np.concatenate(docs)
    order = np.argsort(every, kind="stable")
    every, added = every[order], np.concatenate(scores)[order]
    start = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[start], np.add.reduceat(added, start)


class Best:
    """The best documents so far of one item: highest score first, then smaller id, no id last."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids, self.none = top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """Scores below this cannot enter; equal ones can, by their id."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        keep = scores >= self.least()
        if not keep.any():
            return
        scores, ids, none = (np.concatenate((a, b[keep])) for a, b in
                             ((self.scores, scores), (self.ids, ids), (self.none, none)))
        order = np.lexsort((ids, none, -scores))[: self.top]
        self.scores, self.ids, self.none = scores[order], ids[order], none[order]


def meet(lists: list[tuple[np.ndarray, np.ndarray]], rows: int, best: Best, ids: np.ndarray, none: np.ndarray,
         stride: int = STRIDE) -> int:
    """Document at a time over lists of (documents, shares), the accumulators among them. Returns how many documents were scored.

    Lists are in order of their bound. Those whose bounds add up to less than the threshold are optional: no document
    that stands in them alone can enter.
    """
    lists = sorted(lists, key=lambda x: int(x[1].max()))
    bounds = np.cumsum([int(s.max()) for _, s in lists])
    met = 0
    for low in range(0, rows, stride):
        optional = int(np.searchsorted(bounds, best.least(), side="left"))
        if optional == len(lists):
            return met
        docs, scores = [], []
        for d, s in lists[optional:]:
            a, b = np.searchsorted(d, (low, low + stride))
            if a < b:
                docs.append(d[a:b])
                scores.append(s[a:b])
        if not docs:
            continue
        seen, total = accumulate(docs, scores)
        met += len(seen)
        for at in range(optional - 1, -1, -1):
            alive = total + bounds[at] >= best.least()
            seen, total = seen[alive], total[alive]
            if not len(seen):
                break
            d, s = lists[at]
            place = np.minimum(np.searchsorted(d, seen), len(d) - 1)
            total = total + np.where(d[place] == seen, s[place], 0)
        if len(seen):
            best.add(total, ids[seen], none[seen])
    return met


def search_block(block: Postings, share: np.ndarray, items: Items, best: list[Best], ids: np.ndarray, none: np.ndarray,
                 short: int = SHORT, stride: int = STRIDE) -> int:
    met, rows = 0, len(ids)
    length = np.diff(block.first)
    for own, repeats, top in zip(items.terms, items.repeats, best, strict=True):
        held = length[own] > 0
        few, many = ([], []), []
        for t, r in zip(own[held].tolist(), repeats[held].tolist(), strict=True):
            a, b = block.first[t], block.first[t + 1]
            docs, scores = block.docs[a:b], share[a:b] * r
            if (b - a) * short <= rows:
                few[0].append(docs)
                few[1].append(scores)
            else:
                many.append((docs, scores))
        if few[0]:
            many.append(accumulate(*few))
        if many:
            met += meet(many, rows, top, ids, none, stride)
    return met


# --- over all documents

def _counter(items: Items, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = length = 0
        holding = np.zeros(len(items.hashes), np.int64)
        for batch in slices(batches, "text", block):
            p = postings(batch.column("text"), items)
            documents += int((p.sizes > 0).sum())
            length += int(p.sizes.sum())
            holding += np.diff(p.first)
        held = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], held)), pa.int64()),
                                          pa.array(np.concatenate(([documents, length], holding[held])), pa.int64())], ["term", "n"])

    return run


def _searcher(items: Items, statistics: Statistics, names: list[int], top: int, block: int, short: int, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, best = statistics.weights(), [Best(top) for _ in names]
        for batch in slices(batches, "text", block):
            ids = batch.column("doc_id")
            none = ids.is_null().to_numpy(zero_copy_only=False)
            p = postings(batch.column("text"), items)
            search_block(p, shares(p, statistics, weights), items, best, ids.fill_null(0).to_numpy(), none, short, stride)
        counts = [len(b.scores) for b in best]
        joined = [np.concatenate([getattr(b, name) for b in best]) if best else np.zeros(0) for name in ("ids", "none", "scores")]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), counts), pa.int64()),
                                          pa.array(joined[0], pa.int64(), mask=joined[1].astype(bool)), pa.array(joined[2], pa.int64())],
                                         ["item", "doc_id", "score"])

    return run


def _item_terms():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, words = terms(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(rows_of(words))),
                                              pa.array(hash_words(data, words).view(np.int64))], ["item_id", "term"])

    return run


def _part(rows: DataFrame, part: int, parts: int) -> tuple[list, Items]:
    """The items of one part and their terms, on the driver: at most about ``ITEM_BYTES`` of text."""
    own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
    names = sorted({r.item_id for r in own}, key=lambda x: (x is None, x))
    place = {x: i for i, x in enumerate(names)}
    hashes = np.unique(np.array([r.term for r in own], np.int64).view(np.uint64))
    at = np.searchsorted(hashes, np.array([r.term for r in own], np.int64).view(np.uint64))
    item = np.array([place[r.item_id] for r in own], int)
    repeats = np.array([r.n for r in own], np.int64)
    order = np.lexsort((at, item))
    ends = np.searchsorted(item[order], np.arange(1, len(names)))
    return names, Items(hashes, np.split(at[order], ends), np.split(repeats[order], ends))


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", top: int = TOP, item_bytes: int = ITEM_BYTES, block: int = BLOCK_BYTES,
           short: int = SHORT, stride: int = STRIDE) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents of highest score above 0."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    rows = materialise(asked.mapInArrow(_item_terms(), f"item_id {kind}, term long").groupBy("item_id", "term")
                       .agg(F.count(F.lit(1)).alias("n")))
    parts = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for part in range(parts):
        names, own = _part(rows, part, parts)
        if not names:
            continue
        told = texts.select("text").mapInArrow(_counter(own, block), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        told = dict(told.collect())
        holding = np.array([told.get(i, 0) for i in range(len(own.hashes))], np.int64)
        statistics = Statistics(told.get(-2, 0), told.get(-1, 0), holding)
        near = texts.mapInArrow(_searcher(own, statistics, list(range(len(names))), top, block, short, stride),
                                "item long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        named = spark.createDataFrame(list(enumerate(names)), f"item long, item_id {kind}")
        found = found.unionByName(near.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
    return found
