"""Words and word shingles of whole Arrow batches, hashed in NumPy without a loop over words.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. Those six are single bytes in UTF-8, so byte runs and character runs agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values (the finaliser known as splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of the rows of a batch, in order; row i has words first[i] up to first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word never crosses from one row to the next
    before = np.concatenate(([False], ink[:-1])) if len(data) else ink
    after = np.concatenate((ink[1:], [False])) if len(data) else ink
    start = np.flatnonzero(ink & (~before | edge[:-1]))
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, long: int = 4096) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes wherever they stand.

    A span is read as pieces of eight bytes, the last one filled up with zeros; its hash is the
    scrambled sum of the scrambled pieces, each shifted by its place.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    keep = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    length = (end - start).astype(np.int64)
    total = length.astype(np.uint64) * _BASE
    live = np.flatnonzero((length > 0) & (length <= long))
    place = 0
    while len(live):
        piece = eight[start[live] + 8 * place] & keep[np.minimum(length[live] - 8 * place, 8)]
        total[live] += mix64(piece + np.uint64((place + 1) * int(_BASE) % 2**64))
        place += 1
        live = live[length[live] > 8 * place]
    for i in np.flatnonzero(length > long):
        pieces = -(-length[i] // 8)
        piece = eight[start[i] : start[i] + 8 * pieces : 8].copy()
        piece[-1] &= keep[length[i] - 8 * (pieces - 1)]
        total[i : i + 1] += np.sum(mix64(piece + np.arange(1, pieces + 1, dtype=np.uint64) * _BASE), dtype=np.uint64)
    return mix64(total)


def hash_words(data: np.ndarray, words: Words) -> np.ndarray:
    return hash_spans(data, words.start, words.end)


def shingle_hashes(word_hash: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``width`` words, and where each row's begin.

    A row of fewer words has one shingle, all its words; a row without words has none.
    """
    counts = np.diff(first)
    whole = np.maximum(counts - width + 1, 0)
    short = (counts > 0) & (counts < width)
    per_row = whole + short
    begin = np.concatenate(([0], np.cumsum(per_row)))
    row = np.repeat(np.arange(len(counts)), per_row)
    at = first[row] + (np.arange(begin[-1]) - begin[row])
    value = np.zeros(begin[-1], np.uint64)
    for k in range(width):
        inside = k < counts[row]
        word = np.where(inside, word_hash[np.minimum(at + k, max(len(word_hash) - 1, 0))] if len(word_hash) else 0, np.uint64(k + 1))
        value = mix64(value * _BASE + word)
    return value, begin


def give_back() -> None:
    """Memory that is free again goes back to the system: a worker that rests between tasks holds only what it uses."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one stay near ``most`` bytes; a longer text stands alone. What they took is given back at the end."""
    for batch in batches:
        column = batch.column(text)
        _, offsets = buffers(column)
        low = 0
        while low < len(column):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
            yield batch.slice(low, high - low)
            low = high
        del batch, column, _
    give_back()
