"""SimHash near duplicates: 64-bit fingerprints joined with themselves through binary tries.

Equal fingerprints are one class from the start. Two fingerprints that differ in at most ``MOST`` bits agree in at least two of
``MOST + 2`` blocks, so each class is dealt once per pair of blocks, keyed by those blocks' bits. All classes of a key form
a binary trie over the sorted fingerprints. The join walks pairs of trie nodes from the root: a pair of subtrees that part at
a bit costs one unit of the error budget, and a pair beyond the budget is pruned with all below it. Nodes are ranges of the
sorted array, and all pairs of a level are expanded at once in NumPy.

A key that holds very many classes is split: its trie is cut ``SPLIT_BITS`` below the root, and each pair of these subtrees within
the budget becomes a task. What one task holds is then bounded by the free bits that are left.

Defined cases: null and empty texts have no words and fingerprint zero, linked like any other; a text of fewer than
three words has one shingle, all its words; an empty table gives no rows; rows without an id take part, and a group's name is
its smallest id (null if it has none); rows of equal id are each fingerprinted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import attach, components, gather, join_skewed, materialise, picked, rows_of, settle, spanning
from .words import slices

WIDTH = 3
MOST = 2
SEED = 42
SPLIT_BITS = 8
HOT_CLASSES = 200_000
FRONTIER = 1 << 20


# --- fingerprints

def shingle_digests(text: bytes, width: int = WIDTH) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, and exactly the six kinds of ASCII white space
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.array([xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(digests: np.ndarray, block: int = 1 << 16) -> int:
    """Bit i is set if it is set in over half the digests."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), block):
        bits = np.unpackbits(digests[at : at + block].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [fingerprint(shingle_digests(x)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))],
                                         ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as a signed long)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fingerprint long")


# --- the trie join

def trie_pairs(values: np.ndarray, pairs: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values within ``most`` bits of each other.

    ``values`` holds 64-bit numbers, sorted within each node. ``pairs`` has a row (a_low, a_high, b_low, b_high, bits differing,
    next bit) per pair of nodes to begin with; a node joined with itself stands twice.
    """
    zeros: dict[int, np.ndarray] = {}

    def middle(low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
        if bit not in zeros:
            zeros[bit] = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1) == 0)))
        return low + zeros[bit][high] - zeros[bit][low]

    stack = [(int(bit), pairs[pairs[:, 5] == bit][:, :5]) for bit in np.unique(pairs[:, 5])]
    while stack:
        bit, work = stack.pop()
        if len(work) > FRONTIER:
            stack += [(bit, part) for part in np.array_split(work, -(-len(work) // FRONTIER))]
            continue
        al, ah, bl, bh, err = work.T
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            a, b = al[single], bl[single]
            near = (a != b) & (np.bitwise_count(values[a] ^ values[b]) <= most)
            yield a[near], b[near]
            al, ah, bl, bh, err = work[~single].T
        if bit < 0 or not len(al):
            continue
        am, bm = middle(al, ah, bit), middle(bl, bh, bit)
        self_pair = (al == bl) & (ah == bh)
        grown = np.concatenate([
            np.stack((al, am, bl, bm, err), 1), np.stack((am, ah, bm, bh, err), 1), np.stack((al, am, bm, bh, err + 1), 1),
            np.stack((am, ah, bl, bm, err + 1), 1)[~self_pair]])
        grown = grown[(grown[:, 0] < grown[:, 1]) & (grown[:, 2] < grown[:, 3]) & (grown[:, 4] <= most)]
        if len(grown):
            stack.append((bit - 1, grown))


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _join(most: int, forest: bool):
    """Batches sorted by (key, side): whole keys are joined as soon as they are complete."""
    def found(key_a, side, values) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate(([True], (key_a[1:] != key_a[:-1]) | (side[1:] != side[:-1]), [True])))
        low, high = edge[:-1], edge[1:]
        side_of, key_of = side[low], key_a[low]
        whole = side_of == 0
        roots = [np.stack((low[whole], high[whole], low[whole], high[whole], np.zeros(whole.sum(), int),
                           np.full(whole.sum(), 63)), 1)]
        # a split key has its two subtrees as sides 1 and 2, one after the other
        two = np.flatnonzero((side_of[:-1] == 1) & (side_of[1:] == 2) & (key_of[:-1] == key_of[1:])) if len(low) > 1 else []
        if len(two):
            roots.append(np.stack((low[two], high[two], low[two + 1], high[two + 1], np.zeros(len(two), int), np.full(len(two), 63)), 1))
        roots = np.concatenate(roots)
        roots = roots[(roots[:, 0] != roots[:, 2]) | (roots[:, 1] - roots[:, 0] > 1)]
        if not len(roots):
            return
        for a, b in trie_pairs(values, roots, most):
            if len(a):
                x, y = values[a].view(np.int64), values[b].view(np.int64)
                x, y = spanning(x, y) if forest else (np.minimum(x, y), np.maximum(x, y))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], schema=LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)]
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            new[2] = new[2].view(np.uint64)
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) and held[0][0] != held[0][-1]:
                done = int(np.searchsorted(held[0], held[0][-1]))
                yield from found(*[x[:done] for x in held])
                held = [x[done:] for x in held]
        if len(held[0]):
            yield from found(*held)

    return run


def blocks(most: int = MOST) -> list[int]:
    """Masks of the pairs of blocks: numbers that differ in at most ``most`` bits agree under one of them."""
    count = most + 2
    edges = [round(64 * i / count) for i in range(count + 1)]
    parts = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:], strict=False)]
    return [x | y for x, y in combinations(parts, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(classes: DataFrame, most: int = MOST, forest: bool = False, hot: int = HOT_CLASSES) -> DataFrame:
    """(a, b) of distinct fingerprints within ``most`` bits. ``classes`` is a written table of distinct fingerprints.

    With ``forest`` the links of a key are thinned to as few as connect the same fingerprints; several keys may hold the same link.
    """
    classes = gather(classes)
    masks = blocks(most)
    by_key = F.explode(F.array(*[
        F.struct(F.lit(i).alias("m"), F.col("fingerprint").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(masks)]))
    dealt = classes.select("fingerprint", by_key.alias("k")).select("fingerprint", "k.m", "k.bits")
    large = None  # no key holds more than all classes
    if rows_of(classes) > hot:
        large = settle(dealt.groupBy("m", "bits").count().where(F.col("count") > hot).drop("count"))
        large = None if large.isEmpty() else large
    plain = dealt if large is None else dealt.join(F.broadcast(large), ["m", "bits"], "left_anti")
    rows = plain.select(F.xxhash64("m", "bits").alias("key"), F.lit(0).alias("side"), "fingerprint")
    if large is not None:
        rows = rows.unionByName(_split(dealt.join(F.broadcast(large), ["m", "bits"], "left_semi"), masks, most))
    # equal hashes of different keys only put more nodes under one root; the walk prunes them
    ordered = rows.repartition("key").sortWithinPartitions("key", "side", F.expr("fingerprint < 0"), "fingerprint")
    found = ordered.mapInArrow(_join(most, forest), "a long, b long")
    return gather(found if forest else found.distinct())


def _split(rows: DataFrame, masks: list[int], most: int) -> DataFrame:
    """Rows of hot keys, once per pair of subtrees ``SPLIT_BITS`` below the root that are within the budget."""
    free = [[b for b in range(63, -1, -1) if not m >> b & 1][:SPLIT_BITS] for m in masks]
    top = F.lit(0)
    for i, bits in enumerate(free):
        own = sum((F.shiftrightunsigned("fingerprint", b).bitwiseAND(F.lit(1)) * (1 << (SPLIT_BITS - 1 - j)) for j, b in enumerate(bits)), F.lit(0))
        top = F.when(F.col("m") == i, own).otherwise(top)
    flips = [sum(1 << b for b in c) for n in range(1, most + 1) for c in combinations(range(SPLIT_BITS), n)]
    other = F.explode(F.array(*[F.lit(f) for f in [0, *flips]]))
    near = rows.withColumn("top", top.cast("int")).withColumn("flip", other)
    mate = F.col("top").bitwiseXOR(F.col("flip"))
    side = F.when(F.col("flip") == 0, 0).when(F.col("top") < mate, 1).otherwise(2)
    return near.select(F.xxhash64("m", "bits", F.least("top", mate), F.greatest("top", mate)).alias("key"), side.alias("side"), "fingerprint")


def linked(rows: DataFrame, name: str = "doc_id", most: int = MOST) -> DataFrame:
    """The written rows (name, fingerprint) with ``component_id``, the smallest name that links of fingerprints reach."""
    classes = gather(rows.groupBy("fingerprint").agg(F.min(name).alias("first"), F.count(F.lit(1)).alias("n")))
    roots = gather(components(links(picked(classes, "fingerprint"), most, forest=True), "a", "b"))
    named = attach(classes, picked(roots, F.col("node").alias("fingerprint"), "root"), ["fingerprint"], "left", salts=1)
    named = gather(named.withColumn("root", F.coalesce("root", "fingerprint")))
    smallest = gather(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("classes")))
    named = gather(join_skewed(named, smallest, "root", "classes").select("fingerprint", "n", "component_id"))
    return join_skewed(rows, named, "fingerprint", "n")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for each document."""
    each = linked(materialise(fingerprints(docs, doc_id, text)), "doc_id", most)
    return each.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """The document of smallest id of each group; rows without an id stay, and of repeated ids one row."""
    kept = (groups(docs, doc_id, text, most).where("doc_id = component_id").groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed("doc_id", "__id"))
    kept = settle(kept)
    key = F.col(doc_id).cast("long") == F.col("__id")
    once = docs.join(kept.where("__n = 1"), key, "left_semi")
    repeated = kept.where("__n > 1")
    if not repeated.isEmpty():
        once = once.unionByName(docs.join(repeated, key, "left_semi").dropDuplicates([doc_id]))
    return once.unionByName(docs.where(F.col(doc_id).isNull()))
