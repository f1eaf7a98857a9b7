"""Removal of long repeated strings by run-length indexes.

A byte is removed if a string of ``LENGTH`` bytes that covers it starts anywhere else in the corpus as well. Texts are
the UTF-8 bytes; matches never cross documents.

1. Every window of LENGTH bytes is named by the smallest hash of its GRAM-byte strings. Consecutive windows of one name are a
   context: a stretch of text, its name and a digest. Equal windows have equal names, so only contexts whose name
   occurs twice (or twice within the context) can hold a repeat; only those go on, equal ones once, with their number.
2. Contexts are dealt to buckets by name, each of bounded size. For a bucket a run-compressed Burrows-Wheeler transform is built:
   suffixes are sorted by prefix doubling, and only at the first and last row of each run of equal letters the
   position and the length of the match with the row before and after are sampled.
3. Matching statistics are streamed in text order: from a sample on, the longest match with another suffix shrinks by one per position
   until the next sample. Windows whose match reaches LENGTH are marked.
4. Marks go back to all documents that hold the context, and the bytes they cover are cut out.

A name whose contexts exceed ``MOST_BYTES`` does not fit an index; its windows are counted by their 128-bit hashes instead.

Defined cases: a null text is empty; texts shorter than LENGTH keep all; identical rows (id and text) are documents of their own, and so
repeat each other; a null id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import attach, join_skewed, materialise, settle
from .words import mix64, slices

LENGTH = 400
GRAM = 32
BLOCK = 1 << 20
BUCKET_BYTES = 1_000_000
MOST_BYTES = 6_000_000


# --- contexts

def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position on."""
    count = len(data) - gram + 1
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    value = np.zeros(count, np.uint64)
    for at in range(0, gram - 7, 8):
        value = mix64(value * np.uint64(3) + eight[at : at + count])
    rest = gram % 8
    if rest:
        value = mix64(value * np.uint64(3) + (eight[gram - rest : gram - rest + count] & np.uint64((1 << (8 * rest)) - 1)))
    return value


def sliding_minimum(value: np.ndarray, width: int) -> np.ndarray:
    step, low = 1, value
    while 2 * step <= width:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    rest = width - step
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def contexts(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, windows, name, digest, again) of the contexts of one text, block by block; ``again``: the name may occur twice inside."""
    from xxhash import xxh3_64_intdigest

    gram = min(gram, length)
    width = length - gram + 1
    for at in range(0, len(data) - length + 1, block):
        part = data[at : at + block + length - 1]
        value = gram_hashes(part, gram)
        least = sliding_minimum(value, width)
        start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        windows = np.diff(np.concatenate((start, [len(least)])))
        name = least[start]
        # positions that carry one of the names: a small table first, the names themselves then
        table = np.zeros(1 << 16, bool)
        table[name & np.uint64(0xFFFF)] = True
        some = value[table[value & np.uint64(0xFFFF)]]
        names = np.unique(name)
        place = np.minimum(np.searchsorted(names, some), len(names) - 1)
        times = np.bincount(place[names[place] == some], minlength=len(names))
        again = times[np.searchsorted(names, name)] > 1
        view, ends = memoryview(part), (start + windows + length - 1).tolist()
        digest = np.array([xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), ends, strict=True)], np.uint64)
        yield start + at, windows, name, digest, again


CONTEXT = "row_key string, name long, digest long, start long, windows long, again boolean"


def _contexts(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8_000_000):
            parts, keys = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in contexts(np.frombuffer(text, np.uint8), length, gram):
                    parts.append(part)
                    keys += [key] * len(part[0])
            if parts:
                start, windows, name, digest, again = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.string()), pa.array(name.view(np.int64)), pa.array(digest.view(np.int64)),
                    pa.array(start.astype(np.int64)), pa.array(windows.astype(np.int64)), pa.array(again)],
                    ["row_key", "name", "digest", "start", "windows", "again"])

    return run


# --- the run-length index

def suffix_order(text: np.ndarray, left: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sorted positions. ``left``: bytes up to the end of the position's string; ``owner``: its string, which breaks ties of equal rests.

    Positions that are alone in their place after some depth are settled; only the others are sorted further, at twice the depth.
    """
    n = len(text)
    wide = np.concatenate((text.astype(np.int64) + 1, np.zeros(7, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(7):  # seven symbols of nine bits
        key = (key << 9) | wide[k : k + n]
    near = np.flatnonzero(left < 7)  # past the end of the string they are 0
    key[near] &= -(np.int64(1) << (9 * (7 - left[near])).astype(np.int64))
    order = np.argsort(key).astype(np.int32)  # equal keys are told apart below, in any order
    rank = np.empty(n, np.int32)

    def ranks(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the groups' first members, and whether a member is alone."""
        new = np.empty(len(keys) + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:-1])
        first = np.maximum.accumulate(np.where(new[:-1], np.arange(len(keys), dtype=np.int32), np.int32(0)))
        return places[first], new[:-1] & new[1:]

    places = np.arange(n, dtype=np.int32)
    rank[order], alone = ranks(key[order], places)
    places = places[~alone]
    depth = 7
    while len(places):
        at = order[places]
        second = np.where(left[at] > depth, rank[np.minimum(at + depth, n - 1)] + np.int32(n), owner[at])
        both = (rank[at].astype(np.int64) << 32) | second
        inside = np.argsort(both)
        at = at[inside]
        order[places] = at
        rank[at], alone = ranks(both[inside], places)
        places = places[~alone]
        depth *= 2
    return order


def match_lengths(text: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffix pairs, up to the ends of their strings."""
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    eight = np.ndarray((len(text) + 8,), np.dtype("<u8"), padded, strides=(1,))
    most = np.minimum(left[a], left[b])
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        differ = eight[a[live] + out[live]] ^ eight[b[live] + out[live]]
        lowest = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8)
        out[live] += same
        live = live[(same == 8) & (out[live] < most[live])]
    return np.minimum(out, most)


def matching_statistics(text: np.ndarray, left: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, int]:
    """For each position the longest match of its suffix with any other, and the number of runs of the transform."""
    n = len(text)
    order = suffix_order(text, left, owner)
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    letter = np.where(first, -1 - owner, np.concatenate(([0], text[:-1]))).astype(np.int64)[order]
    breaks = np.flatnonzero(letter[1:] != letter[:-1]) + 1  # the rows at which a run begins, but for row 0
    best = np.zeros(n, np.int32)
    common = match_lengths(text, left, order[breaks - 1], order[breaks])
    place = np.arange(n, dtype=np.int32)
    for row, edge in ((breaks, 0), (breaks - 1, n - 1)):  # run starts look back, run ends look ahead
        value, sampled = np.zeros(n, np.int32), np.zeros(n, bool)
        value[order[row]] = common
        sampled[order[row]] = sampled[order[edge]] = True
        last = np.maximum.accumulate(np.where(sampled, place, np.int32(0)))  # no match is told of the positions before the first sample
        np.maximum(best, value[last] - (place - last), out=best)
    return best, len(breaks) + 1


def repeated_windows(strings: list[bytes], copies: list[bool], length: int = LENGTH) -> list[np.ndarray]:
    """Per string the starts of windows that occur elsewhere in the strings: all of a string with copies, which stands in the index once."""
    sizes = np.array([len(s) for s in strings])
    text = np.frombuffer(b"".join(strings), np.uint8)
    end = np.cumsum(sizes)
    left = (np.repeat(end, sizes) - np.arange(len(text))).astype(np.int32)
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)
    best, _ = matching_statistics(text, left, owner)
    begin = end - sizes
    return [np.arange(max(n - length + 1, 0)) if c else np.flatnonzero(best[b : b + n] >= length)
            for b, n, c in zip(begin.tolist(), sizes.tolist(), copies, strict=True)]


def ranges(starts: np.ndarray) -> list[dict]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    first, last = starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))]
    return [{"a": int(a), "b": int(b)} for a, b in zip(first, last, strict=True)]


RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
MARKS = "name long, digest long, marks array<struct<a:long,b:long>>"


def _index(length: int):
    def run(group: pa.Table) -> pa.Table:
        rows = {}
        for name, digest, times, data in zip(*[group.column(c).to_pylist() for c in ("name", "digest", "times", "data")], strict=True):
            rows[name, digest] = (times > 1, data)
        found = repeated_windows([d for _, d in rows.values()], [c for c, _ in rows.values()], length)
        kept = [(n, d, ranges(x)) for (n, d), x in zip(rows, found, strict=True) if len(x)]
        names, digests, marks = zip(*kept, strict=True) if kept else ((), (), ())
        return pa.Table.from_arrays([pa.array(names, pa.int64()), pa.array(digests, pa.int64()), pa.array(marks, RANGES)],
                                    names=["name", "digest", "marks"])

    return run


# --- names too common for an index

def window_hashes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each window."""
    out = []
    for seed in (1, 2):
        letters = mix64(np.arange(256, dtype=np.uint64) + np.uint64(seed << 32))
        base = letters[seed] | np.uint64(1)
        power = np.cumprod(np.full(len(data), base, np.uint64))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters[data] * power)))
        back = np.cumprod(np.full(len(data) - length + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64))
        out.append(mix64((total[length:] - total[:-length]) * back))  # every window at the same powers
    return out[0], out[1]


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, digest, times, data in zip(*[batch.column(c).to_pylist() for c in ("name", "digest", "times", "data")], strict=True):
                for at in range(0, len(data) - length + 1, BLOCK):
                    h, g = window_hashes(np.frombuffer(data[at : at + BLOCK + length - 1], np.uint8), length)
                    n = len(h)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, name)), pa.array(np.full(n, digest)), pa.array(np.full(n, times)),
                        pa.array(np.arange(at, at + n)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))],
                        ["name", "digest", "times", "at", "h", "g"])

    return run


def counted_marks(data: DataFrame, length: int) -> DataFrame:
    windows = data.mapInArrow(_windows(length), "name long, digest long, times long, at long, h long, g long")
    again = windows.groupBy("h", "g").agg(F.sum("times").alias("n")).where("n > 1").drop("n")
    found = windows.join(again, ["h", "g"], "left_semi")
    return found.groupBy("name", "digest").agg(F.collect_set(F.struct(F.col("at").alias("a"), F.col("at").alias("b"))).alias("marks"))


# --- the whole corpus

def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are compressed before they are shuffled; the text is the last column."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([press.compress(x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], [*batch.schema.names[:-1], "pressed"])


def _cutter(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            out = {c: [] for c in ("name", "digest", "times", "data")}
            for packed, found in zip(batch.column("pressed").to_pylist(), batch.column("found").to_pylist(), strict=True):
                text = plain.decompress(packed)
                for f in found:
                    out["name"].append(f["name"])
                    out["digest"].append(f["digest"])
                    out["times"].append(f["times"])
                    out["data"].append(text[f["start"] : f["start"] + f["windows"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(out["name"], pa.int64()), pa.array(out["digest"], pa.int64()),
                                              pa.array(out["times"], pa.int64()), pa.array(out["data"], pa.binary())],
                                             ["name", "digest", "times", "data"])

    return run


def keep_mask(size: int, marks: list[dict]) -> np.ndarray:
    """Which bytes stay, given the ranges (first, last) of removed bytes."""
    step = np.zeros(size + 1, np.int64)
    for m in marks:
        step[m["a"]] += 1
        step[m["b"] + 1] -= 1
    return np.cumsum(step[:-1]) == 0


RESULT = "doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    plain = zstandard.ZstdDecompressor()
    for batch in slices(batches, "pressed", 4_000_000):
        size, removed, spans, kept = [], [], [], []
        for packed, marks in zip(batch.column("pressed").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            text = plain.decompress(packed)
            mask = keep_mask(len(text), marks or [])
            gone = ~mask
            size.append(len(text))
            removed.append(int(gone.sum()))
            spans.append(int(gone[:1].sum() + (gone[1:] & mask[:-1]).sum()))
            kept.append(text if not removed[-1] else np.frombuffer(text, np.uint8)[mask].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                                          pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def marks_of(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES,
             most_bytes: int = MOST_BYTES) -> DataFrame:
    """(row_key, marks): ranges (first, last) of removed bytes. ``texts`` has (row_key, text as bytes)."""
    all_contexts = materialise(texts.mapInArrow(_contexts(length, gram), CONTEXT))
    again = all_contexts.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"))
    held = attach(all_contexts.drop("again"), again.where("n > 1 or again").select("name"), ["name"], "left_semi", salts=8)
    sorts = materialise(held.groupBy("name", "digest").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("row_key", "start", "windows")).alias("one")))
    names = sorts.groupBy("name").agg(F.sum(F.col("one.windows") + length - 1).alias("bytes"))
    names = settle(names.select("name", "bytes", (F.col("bytes") > most_bytes).alias("common")))
    total = names.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))

    # the bytes of one instance of each sort of context
    places = sorts.groupBy("one.row_key").agg(F.collect_list(F.struct(
        "name", "digest", "times", F.col("one.start").alias("start"), F.col("one.windows").alias("windows"))).alias("found"))

    pressed = texts.mapInArrow(_press, "row_key string, pressed binary")
    data = places.join(pressed, "row_key").mapInArrow(_cutter(length), "name long, digest long, times long, data binary")
    any_common = not names.where("common").isEmpty()
    if any_common:
        data = materialise(data)
        common = names.where("common").select("name")
        marks = counted_marks(data.join(common, "name", "left_semi"), length)
        data = data.join(common, "name", "left_anti")
    bucket = F.pmod(F.xxhash64("name"), F.lit(buckets)).alias("bucket")
    indexed = data.select("*", bucket).groupBy("bucket").applyInArrow(_index(length), MARKS)
    marks = settle(indexed.unionByName(marks) if any_common else indexed)

    # back to every document that holds the context
    times = marks.join(sorts.select("name", "digest", "times"), ["name", "digest"])
    held = join_skewed(all_contexts.select("row_key", "name", "digest", "start"), settle(times), ["name", "digest"], "times")
    moved = F.transform("marks", lambda m: F.struct((m["a"] + F.col("start")).alias("a"), (m["b"] + F.col("start") + length - 1).alias("b")))
    return held.select("row_key", F.explode(moved).alias("m")).groupBy("row_key").agg(F.collect_set("m").alias("marks"))


def row_key(doc_id: str, text: Column) -> Column:
    """Names a row by its id and text, so that identical rows share it."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.hex(F.xxhash64(text)))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text's remaining bytes."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    texts = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, raw).alias("row_key"), raw.alias("text"))
    marks = marks_of(texts.select("row_key", "text"), **options)
    kind = texts.schema["doc_id"].dataType.simpleString()
    pressed = texts.mapInArrow(_press, f"doc_id {kind}, row_key string, pressed binary")
    joined = pressed.join(marks, "row_key", "left").select("doc_id", "pressed", "marks")
    return joined.mapInArrow(_remove, RESULT.format(kind=kind))


def report(docs: DataFrame, **options) -> DataFrame:
    """The counts, and a digest of the remaining bytes."""
    return remove_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
