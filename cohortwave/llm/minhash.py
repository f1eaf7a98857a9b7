"""MinHash fingerprints, and near duplicates by SimHash and by signature bands with the Jaccard likeness verified.

A document's shingles are its runs of five words. Each is hashed to 32 bits, and ``PERMUTATIONS`` universal hash
functions ``(a x + b) mod 2^64 >> 32`` are applied to all shingles of a batch in NumPy; a signature is the minimum of
each. The share of equal minima estimates the Jaccard likeness of two shingle sets.

Defined cases: a null text is the empty text; a text of fewer than five words has one shingle, all its words; a text without
words has the signature of all ones, so two of them are alike (1.0) and one of them is like hardly any other (about 0). Fingerprints hold
no place or id: equal texts have equal fingerprints. Rows of equal id are each fingerprinted; their order is by text.

Near duplicates: texts of equal shingle sets are a class, named by 64 bits of the set's digest. SimHash fingerprints of the shingles that differ in at
most two bits link classes first (``simhash``). Two bits miss most pairs of Jaccard 0.8, so classes that share a band are candidates as well: such a
pair shares none of 64 bands of four minima once in 4e14 times. A group of SimHash links counts as one more band, so its pairs are
candidates whether or not they share another. All candidates are verified on their whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .tables import attach, components, gather, join_skewed, materialise, one_row_each, picked, rows_of, settle, together
from .words import buffers, hash_words, mix64, shingle_hashes, slices, split_words

WIDTH = 5
PERMUTATIONS = 256
BANDS = 64
LEAST = 0.8
SKETCH, AGREE = 128, 64   # bytes of a sketch, and how many must be equal in a pair that is compared
TRIES = 3                 # rounds of comparing with other components' smallest classes
SKETCH_BLOCK = 8192
BLOCK, BLOCK_BYTES = 512, 32_000_000
SEED = 9
NONE = np.uint32(0xFFFFFFFF)


def functions(count: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    a, b = mix64(np.arange(1, 2 * count + 1, dtype=np.uint64) + np.uint64(seed << 32)).reshape(2, count)
    return a | np.uint64(1), b


def signatures(column: pa.Array, count: int = PERMUTATIONS, width: int = WIDTH, seed: int = SEED,
               block: int = 16384) -> np.ndarray:
    """One row of ``count`` 32-bit minima per text."""
    data, offsets = buffers(column)
    words = split_words(data, offsets)
    shingles, begin = shingle_hashes(hash_words(data, words), words.first, width)
    return minima(shingles, begin, count, seed, block)


def minima(shingles: np.ndarray, begin: np.ndarray, count: int = PERMUTATIONS, seed: int = SEED,
           block: int = 16384) -> np.ndarray:
    a, b = functions(count, seed)
    out = np.full((len(begin) - 1, count), NONE, np.uint32)
    x = shingles >> np.uint64(32)
    held = np.empty(block, np.uint64)
    # blocks stay in the processor's cache while all functions pass over them
    for low in range(0, len(x), block):
        high = min(len(x), low + block)
        rows = np.arange(np.searchsorted(begin, low, side="right") - 1, np.searchsorted(begin, high, side="left"))
        rows = rows[begin[rows + 1] > begin[rows]]
        cuts = np.maximum(begin[rows], low) - low
        part, value = x[low:high], held[: high - low]
        for k in range(count):
            np.multiply(part, a[k], out=value)
            np.add(value, b[k], out=value)
            least = (np.minimum.reduceat(value, cuts) >> np.uint64(32)).astype(np.uint32)
            out[rows, k] = np.minimum(out[rows, k], least)
    return out


def short(signature: np.ndarray) -> np.ndarray:
    """The low 16 bits of each minimum: what a fingerprint keeps. Different minima agree once in 65,536 times."""
    return signature.astype(np.uint16)


def texts(fingerprint: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in fingerprint]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima of fingerprints."""
    return (a == b).mean(axis=-1)


# --- fingerprints with edited neighbours

FINGERPRINTS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                "near_edited double, near_next double")
NO_ID = -(1 << 63)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealer(firsts: np.ndarray):
    """Compress the texts and deal them to parts of descending id. ``firsts``: the largest id of each part.

    The first document of a part also goes to the part before, as the one that follows its last.
    """
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            packed = [press.compress(x) for x in batch.column(1).to_pylist()]
            part = len(firsts) - 1 - np.searchsorted(firsts[::-1], ids)
            again = np.flatnonzero(firsts[part] == ids)
            rows = np.concatenate((np.arange(len(ids)), again))
            part = np.concatenate((part, (part[again] - 1) % len(firsts)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(np.arange(len(rows)) >= len(ids)), pa.array(ids[rows], pa.int64()),
                 pa.array(packed, pa.binary()).take(pa.array(rows))], ["part", "follows", "id", "pressed"])

    return deal


def _neighbours(count: int, width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain = zstandard.ZstdDecompressor()
        held = None
        for batch in slices(batches, "pressed", 4_000_000):
            part, follows, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            raw = [plain.decompress(x) for x in batch.column("pressed").to_pylist()]
            sign = short(signatures(pa.array(raw, pa.binary()), count, width, seed))
            if held is not None:
                part, follows, ids = (np.concatenate((h, x)) for h, x in zip(held[:3], (part, follows, ids), strict=True))
                raw, sign = held[3] + raw, np.concatenate((held[4], sign))
            held = part[-1:], follows[-1:], ids[-1:], raw[-1:], sign[-1:]
            text = [x.decode("utf-8", "replace") for x in raw]
            own = np.flatnonzero(~follows[:-1] & (part[:-1] == part[1:]))
            change = [edited(text[i], text[i + 1]).encode("utf-8", "surrogatepass") for i in own]
            new = short(signatures(pa.array(change, pa.binary()), count, width, seed))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[own], pa.int64(), mask=ids[own] == NO_ID), pa.array([len(text[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in change], pa.string()),
                pa.array(texts(sign[own]), pa.string()), pa.array(texts(new), pa.string()),
                pa.array(likeness(sign[own], new), pa.float64()), pa.array(likeness(sign[own], sign[own + 1]), pa.float64()),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", count: int = PERMUTATIONS,
                 width: int = WIDTH, seed: int = SEED, rows_per_part: int = 2000) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how near both and the next document are.

    The next document is that of the next smaller id; after the last one comes the first. Ids are dealt by range, and
    only the largest of each part goes to the driver; texts move once, compressed, and are streamed in order.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    parts = max(1, -(-rows.count() // rows_per_part))
    firsts = (rows.select("id").repartitionByRange(parts, F.col("id").desc()).groupBy(F.spark_partition_id())
              .agg(F.max("id").alias("first")).select("first"))
    firsts = np.array(sorted((r[0] for r in firsts.collect()), reverse=True), np.int64)
    if not len(firsts):
        return docs.sparkSession.createDataFrame([], FINGERPRINTS)
    dealt = rows.mapInArrow(_dealer(firsts), "part int, follows boolean, id long, pressed binary")
    # the follower is the next part's first document, or the table's first: it stands last in its part
    ordered = (dealt.repartition(len(firsts), "part")
               .sortWithinPartitions("part", "follows", F.col("id").desc(), "pressed"))
    return ordered.mapInArrow(_neighbours(count, width, seed), FINGERPRINTS)


# --- near duplicates

ROWS = "doc_id long, text_key string, node long, size int, fingerprint long, bands array<long>, sketch binary"


def _sets(column: pa.Array, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's shingle set, and the hashes with repeats and where each text's begin."""
    data, offsets = buffers(column)
    words = split_words(data, offsets)
    hashes, begin = shingle_hashes(hash_words(data, words), words.first, width)
    return [np.unique(hashes[begin[i] : begin[i + 1]]).view(np.int64) for i in range(len(column))], hashes, begin


def _shingle_rows(count: int, width: int, bands: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, hashes, begin = _sets(batch.column("text"), width)
            minimum = minima(hashes, begin, count, seed)
            sign = minimum.reshape(batch.num_rows, bands, -1)
            place = np.arange(1, sign.shape[2] + 1, dtype=np.uint64) << np.uint64(32)
            keys = mix64(np.sum(mix64(sign.astype(np.uint64) + place), axis=2, dtype=np.uint64)
                         + np.arange(bands, dtype=np.uint64)[None, :]).view(np.int64)
            nodes = [int.from_bytes(hashlib.sha256(x.tobytes()).digest()[:8], "big", signed=True) for x in sets]
            sketch = [x.tobytes() for x in minimum[:, :SKETCH].astype(np.uint8)]
            prints = [simhash.fingerprint(simhash.shingle_digests(x, width)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_key"), pa.array(nodes, pa.int64()),
                pa.array([len(x) for x in sets], pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)),
                pa.array(list(keys), pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "text_key", "node", "size", "fingerprint", "bands", "sketch"])

    return run


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(_sets(batch.column("text"), width)[0], pa.list_(pa.int64()))],
                                             ["node", "shingles"])

    return run


def _items(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list<long> column as views of its buffer, in the order they were sorted in, as unsigned numbers."""
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [values[at[i] : at[i + 1]] for i in range(len(column))]


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted shingle sets have a Jaccard likeness of ``least`` or more."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < least * len(y):
        return False
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
    return common >= least * (len(x) + len(y) - common)


def _compare(least: float):
    """Rows sorted by (hub, part, kind): a hub's set, then the sets of the classes to compare it with. One hub's set is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = own = None
        for batch in batches:
            names, kinds, nodes = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("hub", "kind", "node"))
            found: list[tuple[int, int]] = []
            for i, x in enumerate(_items(batch.column("shingles"))):
                if kinds[i] == 0:
                    hub, own = names[i], x.copy()
                elif names[i] == hub and alike(own, x, least):
                    found.append((int(nodes[i]), int(hub)))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, least: float, part_rows: int = 256) -> DataFrame:
    """The written pairs (a, b) whose whole shingle sets are alike. Written.

    b is the hub. A class's set travels once per pair to its hub, and a hub's set once per ``part_rows`` of its pairs, so no row holds two sets and
    no task more than one besides its batch.
    """
    pairs = gather(pairs)
    if not rows_of(pairs):
        return pairs
    hubs = gather(pairs.groupBy(F.col("b").alias("node")).agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts")))
    many = gather(hubs.where("parts > 1").select(F.col("node").alias("b"), "parts"))
    dealt = attach(pairs, many, ["b"], "left")
    part = F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = gather(dealt.select(F.col("a").alias("node"), F.col("b").alias("hub"), part.alias("part")))
    members = attach(sets, dealt, ["node"], salts=1).select("hub", "part", F.lit(1).alias("kind"), "node", "shingles")
    heads = attach(sets, hubs, ["node"], salts=1).select(
        F.col("node").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "node", "shingles")
    rows = members.unionByName(heads).repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")
    return gather(rows.mapInArrow(_compare(least), "a long, b long"))


def _sketch_forest(least: float, agree: int):
    """Batches sorted by key, whole keys held: a spanning forest of the pairs of different roots that sizes and sketches do not rule out.

    What leaves a key is fewer rows than came in, however many pairs are left.
    """
    def told(node, root, side, size, sketch) -> tuple[list[int], list[int]]:
        part = np.arange(len(node))
        a, b = [], []
        for i in range(len(node)):
            at = np.flatnonzero((root != root[i]) & (part != part[i]))
            at = at[np.minimum(size[at], size[i]) >= least * np.maximum(size[at], size[i])]
            if side[i]:
                at = at[side[at] != side[i]]
            at = at[(sketch[at] == sketch[i]).sum(axis=1) >= agree]
            parts, first = np.unique(part[at], return_index=True)
            if len(parts):
                a += [int(node[i])] * len(parts)
                b += node[at[first]].tolist()
                part[np.isin(part, parts)] = part[i]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> tuple[list[int], list[int]]:
            found = told(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held.clear()
            return found

        def rows(found: list[tuple[list[int], list[int]]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f[k]], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            names, done = np.array(batch.column("key").to_pylist(), object), []
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else [0]
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("node", "root", "side", "size")]
            columns.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(names), -1))
            for low, high in zip(cuts, cuts[1:]):
                if held and key != names[low]:
                    done.append(close())
                key = names[low]
                held.append([c[low:high] for c in columns])
            yield rows(done)
        if held:
            yield rows([close()])

    return run


def _block_links(least: float, agree: int):
    """Batches sorted by key, whole keys held: links that join members of different roots, compared by whole sets where sizes and sketches allow it."""
    def found(node, root, side, sketch, sets) -> tuple[list[int], list[int]]:
        size = np.array([len(x) for x in sets])
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        a, b = [], []
        for i in range(len(sets)):
            near = (root != root[i]) & (np.minimum(size, size[i]) >= least * np.maximum(size, size[i]))
            near[: i + 1] = False
            if side.any():
                near &= side != side[i]
            at = np.flatnonzero(near)
            at = at[(sketch[at] == sketch[i]).sum(axis=1) >= agree]
            for j in at.tolist():
                x, y = top(int(root[i])), top(int(root[j]))
                if x != y and alike(sets[i], sets[j], least):
                    up[max(x, y)] = min(x, y)
                    a.append(int(node[i]))
                    b.append(int(node[j]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            parts = [np.concatenate(c) for c in list(zip(*held, strict=True))[:4]]
            a, b = found(*parts, [x for h in held for x in h[4]])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            names = np.array(batch.column("key").to_pylist(), object)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else [0]
            for low, high in zip(cuts, cuts[1:]):
                if held and key != names[low]:
                    yield close()
                key, rows = names[low], batch.slice(low, high - low)
                sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(high - low, -1)
                held.append((*(rows.column(n).to_numpy(zero_copy_only=False) for n in ("node", "root", "side")), sketch,
                             [x.copy() for x in _items(rows.column("shingles"))]))
        if held:
            yield close()

    return run


def shingle_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", count: int = PERMUTATIONS, width: int = WIDTH,
                 bands: int = BANDS, seed: int = SEED) -> DataFrame:
    """Per row its id, the digest of its text, its class, the size of its shingle set, its SimHash fingerprint, its band keys and its sketch. Written."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.md5(body).alias("text_key"), body.alias("text"))
    return materialise(rows.mapInArrow(_shingle_rows(count, width, bands, seed), ROWS))


def _best(tries: DataFrame) -> DataFrame:
    """Of the pairs (a, b), once per band that they share, each a's b of most shared bands."""
    shared = tries.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return shared.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))


def simhash_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): each class of ``shingle_rows`` with the smallest one that links of SimHash fingerprints reach. Written."""
    prints = materialise(rows.where("size > 0").select("node", "fingerprint").distinct())
    each = simhash.linked(prints, "node").select(F.col("node").alias("a"), F.col("component_id").alias("b"))
    return gather(each.where("a <> b").distinct())


def roots_of(docs: DataFrame, rows: DataFrame, text: str = "text", least: float = LEAST, width: int = WIDTH, agree: int = AGREE,
             tries: int = TRIES, sketch_block: int = SKETCH_BLOCK, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(node, n, root) per class of ``shingle_rows``: its rows, and the class that names its component.

    A band is a key of minima, or the smallest class that SimHash links reach. Each class is compared by whole shingle sets with one other: that smallest class, or where it is not alike, the one
    which is the smallest class of most of its bands. Components are taken, and for some rounds each class that shares a band with another component is compared with that component's smallest class in the
    band. That links nearly all; what makes the result exact is the last step, for every pair of classes that
    share a band and still lie in different components. Bands are taken in pairs of blocks of sketches; of the pairs that sizes and sketches do not rule out a
    spanning forest is kept, and inside each of its trees all are compared with all by whole sets, in blocks, in which
    a link made spares all others between the two components. A sketch rules out a pair of Jaccard 0.8 once in 1e14 times, about as often as the bands miss one.
    """
    classes = materialise(rows.groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("bands").alias("bands"),
                                                   F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("n")))
    tried = simhash_pairs(rows)
    linked = picked(tried, F.col("b").alias("band"), F.col("a").alias("node")).unionByName(tried.select(F.col("b").alias("band"), F.col("b").alias("node")).distinct())
    keyed = classes.where("size > 0").select(F.explode("bands").alias("band"), "node").unionByName(linked)
    tops = gather(keyed.groupBy("band").agg(F.min("node").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = materialise(join_skewed(keyed, tops, "band", "n"))
    wanted = gather(met.select("node").distinct())
    wanted = gather(attach(classes.select("text_key", "node"), wanted, ["node"], salts=1))
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    texts = attach(docs.select(F.md5(body).alias("text_key"), body.alias("text")), wanted, ["text_key"])
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    sets = materialise(texts.mapInArrow(_shingles(width), "node long, shingles array<long>"))

    links = verified(tried, sets, least)
    found = gather(links.select(F.col("a").alias("node")).distinct())
    others = attach(met.where("node <> top"), found, ["node"], "left_anti", salts=1).select(F.col("node").alias("a"), F.col("top").alias("b"))
    fresh = gather(_best(_untried(others, tried)))
    tried, links = together(tried, fresh), together(links, verified(fresh, sets, least))
    for _ in range(tries):
        placed, lows, roots = _split_bands(met, links)
        cross = join_skewed(placed, lows, "band", "n").where("root <> low").select(F.col("node").alias("a"), F.col("first").alias("b"))
        fresh = gather(_best(_untried(cross, tried)))
        more = verified(fresh, sets, least)
        if not rows_of(more):
            break
        tried, links = together(tried, fresh), together(links, more)
    else:
        placed, lows, roots = _split_bands(met, links)

    if rows_of(lows):
        crowd = materialise(join_skewed(placed, picked(lows, "band", "n"), "band", "n"))
        drawn = classes.select("node", "size", "sketch")
        blocks = _in_blocks(crowd.join(drawn, "node"), sketch_block, 1 << 60).repartition("key").sortWithinPartitions("key")
        left = gather(components(blocks.mapInArrow(_sketch_forest(least, agree), "a long, b long"), "a", "b").withColumnRenamed("root", "band"))
        if rows_of(left):
            left = gather(attach(left, roots, ["node"], "left", salts=1).select("band", "node", F.coalesce("root", "node").alias("root")))
            left = settle(attach(drawn, left, ["node"], salts=1))
            rows = settle(_in_blocks(left, block, block_bytes)).join(sets, "node").repartition("key").sortWithinPartitions("key")
            links = together(links, gather(rows.mapInArrow(_block_links(least, agree), "a long, b long").distinct()))
            roots = gather(components(links, "a", "b"))
    return gather(attach(classes.select("node", "n"), roots, ["node"], "left", salts=1).select("node", "n", F.coalesce("root", "node").alias("root")))


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    either = together(tried, picked(tried, F.col("b").alias("a"), F.col("a").alias("b")))
    return attach(pairs, either, ["a", "b"], "left_anti", salts=1)


def _split_bands(met: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of bands (band, node, root), of bands whose members lie in different components the lowest root and its smallest class, and (node, root)."""
    roots = gather(components(links, "a", "b"))
    placed = attach(met.select("band", "node"), roots, ["node"], "left", salts=1).select("band", "node", F.coalesce("root", "node").alias("root"))
    placed = materialise(placed)
    lows = placed.groupBy("band").agg(F.min(F.struct("root", "node")).alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
    lows = lows.where("low.root < high").select("band", F.col("low.root").alias("low"), F.col("low.node").alias("first"), "n")
    return placed, gather(lows), roots


def _in_blocks(crowd: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Members of bands, once per pair of blocks that theirs is in; blocks have about ``block`` members and sets of ``block_bytes`` at most."""
    sizes = crowd.groupBy("band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(8 * F.sum("size") / block_bytes)).cast("int").alias("blocks"))
    dealt = attach(crowd, sizes, ["band"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(
        F.concat_ws(" ", "band", F.least("own", "mate"), F.greatest("own", "mate")).alias("key"), "band", "node", "root", "size", "sketch",
        F.when(F.col("own") == F.col("mate"), 0).when(F.col("own") < F.col("mate"), 1).otherwise(2).alias("side"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, component_id): documents linked through near duplicates share the smallest id."""
    rows = shingle_rows(docs, doc_id, text)
    each = materialise(join_skewed(rows.select("doc_id", "node"), roots_of(docs, rows, text, **options), "node", "n"))
    names = gather(each.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    return join_skewed(each, names, "root", "n").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of near duplicates: that of smallest id, no id last, and of equal ids that of smallest text digest."""
    rows = shingle_rows(docs, doc_id, text)
    each = join_skewed(rows.select("doc_id", "text_key", "node"), roots_of(docs, rows, text, **options), "node", "n")
    return one_row_each(docs, each, doc_id, text)
