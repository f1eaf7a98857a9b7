"""Packing of tokenised documents into sequences of fixed capacity.

A document's ids are cut at multiples of the capacity. The pieces are dealt to random groups of bounded size, and each group is
packed on its own: first-fit decreasing, where a tournament tree over the bins' free capacities finds the first bin that
fits in log2 n steps. What first fit leaves open is then closed by cutting the pieces of the emptiest bins, so that all
sequences but the last few are full; the remainder of a group stands in sequences whose lengths are powers of two.

Defined cases: a null text is the empty text, whose only id is the closing one; rows of equal id are packed as documents of
their own; a null id stays null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

CAPACITY = 4096
END_ID = 2
GROUP_BYTES = 8_000_000
CACHED_WORDS = 800_000
KEPT_WORDS = 200_000
SEED = 8
PIECES = "group long, doc_id long, start long, doc_tokens long, ids binary"
PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


# --- tokens

class Known(dict):
    """Ids by word; words that were asked for in vain are noted."""

    def __init__(self):
        super().__init__()
        self.new: set[str] = set()

    def __missing__(self, word: str) -> None:
        self.new.add(word)


class Ids:
    """Ids of texts, with a bounded store of the ids of words between spaces.

    The tokenizer drops white space and never joins ids across it, so a text's ids are those of its words in order.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, Known()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.type = np.dtype("<u2" if max(vocabulary.values()) < 65536 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, self.type).tobytes() for x in found]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only, in one go: each ends in the one id that closes a word."""
        out: list[bytes] = []
        for low in range(0, len(words), 200):
            part = words[low : low + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):  # letters that this tokenizer's tables know otherwise
                out += self._encode(part)
                continue
            flat, size = ids.astype(self.type).tobytes(), self.type.itemsize
            edges = [0, *(stops * size).tolist()]
            out += [flat[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        return out

    def _learn(self, words: set[str]) -> None:
        letters, marked, stems, tails, other = set(), [], [], [], set()
        for w in words:
            if w.isalpha():
                letters.add(w)
                continue
            stem = w.rstrip(punctuation)  # marks after letters are a piece of their own to the tokenizer, however many
            if stem.isalpha() and len(stem) < len(w):
                tail = w[len(stem) :]
                marked.append(w)
                stems.append(stem)
                tails.append(tail)
                if stem not in self.known:
                    letters.add(stem)
                if tail not in self.known:
                    other.add(tail)
            else:
                other.add(w)
        letters, other = list(letters), list(other)
        self.known.update(zip(letters, self._letters(letters), strict=True))
        self.known.update(zip(other, self._encode(other), strict=True))
        known = self.known
        for w, stem, tail in zip(marked, stems, tails, strict=True):
            known[w] = known[stem] + known[tail]

    def of(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        split = [text.replace("\n", " ").split(" ") for text in texts]
        found, lacking = [], []
        for words in split:
            before = len(known.new)
            found.append(list(map(known.__getitem__, words)))
            lacking.append(len(known.new) > before or None in found[-1])
        if known.new:
            new, known.new = known.new, set()
            self._learn(new)
        return [b"".join([known[w] if x is None else x for w, x in zip(words, ids, strict=True)] if lack else ids)
                for words, ids, lack in zip(split, found, lacking, strict=True)]

    def rest(self, keep: int = KEPT_WORDS) -> None:
        """Between tasks a worker, which may do other work next, keeps the words it met first: the common ones."""
        if len(self.known) > keep:
            few = Known()
            few.update(islice(self.known.items(), keep))
            self.known = few


@lru_cache(maxsize=1)
def ids_of(path: str, words: int = CACHED_WORDS) -> Ids:
    return Ids(path, words)


def _tokenise(path: str, end_id: int, capacity: int, groups: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path, words)
        step = capacity * ids.type.itemsize
        for batch in slices(batches, "text", 2_000_000):
            doc_id, draw, start, total, part = [], [], [], [], []
            texts = [x.decode("utf-8", "replace") for x in batch.column("text").to_pylist()]
            end = np.array([end_id], ids.type).tobytes()
            for i, d, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids.of(texts), strict=True):
                tokens += end
                for k, at in enumerate(range(0, len(tokens), step)):
                    doc_id.append(i)
                    draw.append((d + k * 0x9E3779B1) % groups)
                    start.append(k * capacity)
                    total.append(len(tokens) // ids.type.itemsize)
                    part.append(tokens[at : at + step])
            yield pa.RecordBatch.from_arrays([
                pa.array(draw, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()),
                pa.array(total, pa.int64()), pa.array(part, pa.binary())], ["group", "doc_id", "start", "doc_tokens", "ids"])
        ids.rest()

    return run


def token_pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, doc_id: str = "doc_id",
                 text: str = "text", group_bytes: int = GROUP_BYTES, seed: int = SEED, words: int = CACHED_WORDS) -> DataFrame:
    """Documents' ids cut at multiples of the capacity, each piece in a random group: PIECES.

    Groups are as many as keep one near ``group_bytes`` of text; a long document's pieces go to different ones. ``words`` are the most
    whose ids a worker holds: some 200 bytes each.
    """
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    size = docs.agg(F.sum(F.octet_length(raw) + 1)).first()[0] or 0
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.xxhash64(F.lit(seed), F.col(doc_id)).alias("draw"), raw.alias("text"))
    return rows.mapInArrow(_tokenise(path, end_id, capacity, max(1, -(-size // group_bytes)), words), PIECES)


# --- first-fit decreasing

def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece. A tournament tree holds the free capacity of each bin and the larger of two at each node."""
    order = np.argsort(-lengths, kind="stable")
    leaves = 1 << max(0, int(len(lengths) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    out = np.zeros(len(lengths), np.int64)
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        node = 1
        while node < leaves:  # the left child wins if it fits: the first bin of all that fit
            node = 2 * node if tree[2 * node] >= n else 2 * node + 1
        out[i] = node - leaves
        tree[node] -= n
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return out


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, from, to). All are full, but for the last few, whose lengths are powers of two."""
    if not len(lengths):
        return []
    where = first_fit_decreasing(lengths, capacity)
    count = int(where.max()) + 1
    fill = np.bincount(where, lengths, count).astype(np.int64)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    for i, n in sorted(enumerate(lengths.tolist()), key=lambda x: -x[1]):
        bins[where[i]].append((i, 0, n))
    order = np.argsort(-fill, kind="stable").tolist()
    full = int(lengths.sum()) // capacity
    kept, loose = [bins[b] for b in order[:full]], [p for b in order[full:] for p in bins[b]]
    loose.reverse()

    def take(n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            i, a, b = loose.pop()
            if b - a > n:
                loose.append((i, a + n, b))
                b = a + n
            out.append((i, a, b))
            n -= b - a
        return out

    for k, b in enumerate(order[:full]):
        kept[k] += take(capacity - int(fill[b]))
    rest = sum(b - a for _, a, b in loose)
    return kept + [take(1 << k) for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pack(capacity: int, type_of: str):
    def run(group: pa.Table) -> pa.Table:
        # the same order whatever order the rows arrive in
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        ids = [np.frombuffer(x, type_of) for x in group.column("ids").to_pylist()]
        doc, start, total = (group.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        number = group.column("group")[0].as_py() << 32
        rows = []
        for s, sequence in enumerate(pack_lengths(np.array([len(x) for x in ids], np.int64), capacity)):
            offset = 0
            for i, a, b in sequence:
                rows.append((doc[i], start[i] + a, b - a, ids[i][a:b].astype("<u4").tobytes(), total[i], number + s, offset))
                offset += b - a
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in PACKED.split(", ")]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)

    return run


def pack(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, doc_id: str = "doc_id",
         text: str = "text", group_bytes: int = GROUP_BYTES, seed: int = SEED, words: int = CACHED_WORDS) -> DataFrame:
    """The pieces of all documents with their ids (little-endian unsigned 32-bit), sequence and offset there: PACKED."""
    pieces = token_pieces(docs, path, end_id, capacity, doc_id, text, group_bytes, seed, words)
    return pieces.groupBy("group").applyInArrow(_pack(capacity, ids_of(path, words).type.str), PACKED)


def report(docs: DataFrame, path: str, **options) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs, path, **options).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                              "sequence_id", "offset")
