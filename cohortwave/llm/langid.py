"""Language identification by a linear-chain conditional random field over the words of a text.

A word is a maximal run of letters. Its features are its prefixes and suffixes of one to three letters and its inner runs of one to four,
hashed to ``SLOTS`` weights per language, and its share of each language's lexicon. Neighbouring words are linked by learned transition
weights. Forward-backward gives each word's posterior over the languages, so a text that switches is labelled word by word; a document's language
is that of the largest mean posterior, which is its score.

Lexicons are counted over all labelled rows outside the held-out part but for the fit sample, each word in one of ``ENTRIES``
buckets. The weights are fitted on at most about ``PASSAGES`` passages of ``PASSAGE`` words, cut from whole documents that are drawn by a hash of their
id, ``JOINED`` passages of different documents in a row, so that the transitions see switches. Forward-backward is exact at any
length: a document is cut into segments, whose transfer matrices are formed side by side and chained.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; so is every text where no label can be learned from. Equal posteriors go to the first language by
code point. A null id is learned from and not held out. Repeated rows are labelled alike. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise
from .words import hash_spans, mix64, slices

FOLDS, HELD = 4, 2
SLOTS = 1 << 16
ENTRIES = 1 << 16
LONGEST = 4
PASSAGES = 6_000
PASSAGE = 16
JOINED = 4
SEGMENT = 32
STEPS = 60
RATE = 0.08
L2 = 1e-3
SEED = 13
UNDETERMINED = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_EDGE = 0x110000  # stands before and after a word


# --- words

@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and their lower case where that is one code point."""
    letter, lower = np.zeros(_EDGE + 1, bool), np.arange(_EDGE + 1, dtype=np.uint32)
    for i in range(_EDGE):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            small = c.lower()
            if len(small) == 1:
                lower[i] = ord(small)
    return letter, lower


@dataclass
class Tokens:
    """Words of some texts: row i has words first[i] up to first[i + 1]; ``word`` tells which distinct word each is."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    base: np.ndarray
    word: np.ndarray
    code: np.ndarray
    at: np.ndarray
    size: np.ndarray
    hash: np.ndarray


def tokens(texts: list[str]) -> Tokens:
    letter, lower = _alphabet()
    base = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    code = lower[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ink = letter[code]
    edge = np.zeros(len(code) + 1, bool)
    edge[base] = True
    start = np.flatnonzero(ink & (edge[:-1] | ~np.concatenate(([False], ink[:-1]))[: len(ink)]))
    end = np.flatnonzero(ink & (edge[1:] | ~np.concatenate((ink[1:], [False]))[: len(ink)])) + 1
    named, one, word = np.unique(hash_spans(code.view(np.uint8), 4 * start, 4 * end), return_index=True, return_inverse=True)
    return Tokens(start, end, np.searchsorted(start, base), base, word, code, start[one], (end - start)[one], named)


def features(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the distinct words' affixes and inner runs, and where each word's begin."""
    padded = t.size + 2
    first = np.concatenate(([0], np.cumsum(padded)))
    word = np.repeat(np.arange(len(t.size)), padded)
    inside = np.arange(first[-1]) - first[word]
    code = np.full(first[-1], _EDGE, np.uint64)
    inner = (inside > 0) & (inside <= t.size[word])
    code[inner] = t.code[t.at[word[inner]] + inside[inner] - 1]
    value, slots, owner = np.zeros(len(code), np.uint64), [], []
    for n in range(1, LONGEST + 1):
        fits = np.flatnonzero(inside + n <= padded[word])
        value = mix64(value[fits] * _BASE + code[fits + n - 1] + np.uint64(n)) if n == 1 else mix64(
            value[np.searchsorted(before, fits)] * _BASE + code[fits + n - 1] + np.uint64(n))
        before = fits
        # an edge alone says nothing
        real = inner[fits] if n == 1 else np.ones(len(fits), bool)
        slots.append(value[real] & np.uint64(SLOTS - 1))
        owner.append(word[fits[real]])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(slots)[order].astype(np.int64), np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(t.size)))))


def entry(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20) & np.uint64(ENTRIES - 1)).astype(np.int64)


def lexicon(counts: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Per bucket and language the log of its smoothed share, less the mean over the languages; 0 for a bucket never seen."""
    share = np.log((counts + smooth) / (counts.sum(axis=0) + smooth * len(counts)))
    share -= share.mean(axis=1, keepdims=True)
    return np.where(counts.sum(axis=1, keepdims=True) > 0, share, 0.0).astype(np.float32)


# --- the chain

def chain(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Posterior of each label at each word: rows of ``emission`` are the words, row i of the texts has first[i] up to first[i + 1].

    ``transition`` and ``opening`` are weights in logs. Texts are cut into segments of ``SEGMENT`` words. The product of a segment's
    matrices leads from what comes in on its left to what goes out on its right, so segments are chained by one small
    product each, and the words inside all segments are then passed over side by side.
    """
    n, k = emission.shape
    count = np.diff(first)
    per = -(-count // SEGMENT)
    begin = np.concatenate(([0], np.cumsum(per)))
    if not n:
        return np.zeros((0, k))
    text = np.repeat(np.arange(len(count)), per)
    number = np.arange(begin[-1]) - begin[text]
    low = first[text] + number * SEGMENT
    size = np.minimum(first[text + 1] - low, SEGMENT)
    step = np.exp(transition - transition.max())
    local = np.exp(emission - emission.max(axis=1, keepdims=True))
    order = np.argsort(-size, kind="stable")  # segments of one length pass over together; shorter ones drop out
    low, size, number, text = low[order], size[order], number[order], text[order]
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    live = [int(np.searchsorted(-size, -j, side="left")) for j in range(SEGMENT)]
    many = int(np.searchsorted(-count[np.argsort(-count, kind="stable")], -SEGMENT, side="left"))
    left = np.empty((len(order), k))
    right = np.ones((len(order), k))
    left[:] = np.exp(opening - opening.max())
    if many:  # some text has more than one segment
        through = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
        for j in range(SEGMENT):
            m = live[j]
            if not m:
                break
            x = through[:m] if j == 0 else through[:m] @ step
            x = x * local[low[:m] + j][:, None, :]
            through[:m] = x / x.sum(axis=(1, 2), keepdims=True)
        longest = int(per.max())
        for r in range(1, longest):
            own = np.flatnonzero(per > r)
            at, back = place[begin[own] + r], place[begin[own] + r - 1]
            x = np.einsum("ij,ijk->ik", left[back], through[back]) @ step
            left[at] = x / x.sum(axis=1, keepdims=True)
        for r in range(longest - 2, -1, -1):
            own = np.flatnonzero(per > r + 1)
            at, ahead = place[begin[own] + r], place[begin[own] + r + 1]
            x = np.einsum("ijk,ik->ij", through[ahead], right[ahead]) @ step.T
            right[at] = x / x.sum(axis=1, keepdims=True)
    alpha = np.empty((n, k))
    now = left
    for j in range(SEGMENT):
        m = live[j]
        if not m:
            break
        x = (now[:m] if j == 0 else now[:m] @ step) * local[low[:m] + j]
        now = x / x.sum(axis=1, keepdims=True)
        alpha[low[:m] + j] = now
    now = right.copy()
    for j in range(SEGMENT - 1, -1, -1):
        m = live[j]
        if not m:
            continue
        at = low[:m] + j
        x = now[:m]
        alpha[at] *= x
        back = (x * local[at]) @ step.T
        now[:m] = back / back.sum(axis=1, keepdims=True)
    return alpha / alpha.sum(axis=1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    slots: np.ndarray        # SLOTS x labels
    lexicon: np.ndarray      # ENTRIES x labels
    trust: float             # weight of the lexicon
    bias: np.ndarray
    transition: np.ndarray
    opening: np.ndarray

    def emission(self, t: Tokens) -> np.ndarray:
        slots, begin = features(t)
        out = self.bias + self.trust * self.lexicon[entry(t.hash)].astype(float)
        if len(slots):
            out += np.add.reduceat(self.slots[slots], begin[:-1], axis=0)
        return out[t.word]

    def posteriors(self, t: Tokens) -> np.ndarray:
        return chain(self.emission(t), t.first, self.transition, self.opening)

    def classify(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        t = tokens(texts)
        count = np.diff(t.first)
        if not self.labels or not len(t.start):
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        row = np.repeat(np.arange(len(texts)), count)
        posterior = self.posteriors(t)
        total = np.stack([np.bincount(row, posterior[:, j], len(texts)) for j in range(len(self.labels))], axis=1)
        best = total.argmax(axis=1)
        score = total[np.arange(len(texts)), best] / np.maximum(count, 1)
        return [self.labels[b] if c else UNDETERMINED for b, c in zip(best, count, strict=True)], np.clip(score, 0.0, 1.0)


def fit(passages: list[tuple[list[str], int]], labels: list[str], counts: np.ndarray, steps: int = STEPS, rate: float = RATE,
        l2: float = L2, joined: int = JOINED, seed: int = SEED) -> Model:
    """Adam on the mean negative log likelihood of sequences of ``joined`` passages (words, label)."""
    k = len(labels)
    model = Model(labels, np.zeros((SLOTS, k)), lexicon(counts), 0.0, np.zeros(k), np.zeros((k, k)), np.zeros(k))
    if k < 2 or not passages:
        return model
    rng = np.random.default_rng(seed)
    passages = [passages[i] for i in rng.permutation(len(passages))]
    sequences = [passages[i : i + joined] for i in range(0, len(passages), joined)]
    t = tokens([" ".join(w for words, _ in s for w in words) for s in sequences])
    truth = np.concatenate([np.repeat([y for _, y in s], [len(words) for words, _ in s]) for s in sequences])
    slots, begin = features(t)
    owner = np.repeat(np.arange(len(t.size)), np.diff(begin))
    known = model.lexicon[entry(t.hash)].astype(float)
    used, slots = np.unique(slots, return_inverse=True)
    n, words = len(t.word), len(t.size)
    follows = np.ones(n, bool)
    follows[t.first[:-1][np.diff(t.first) > 0]] = False
    follows, opens = np.flatnonzero(follows), np.flatnonzero(~follows)
    gold_word = np.bincount(t.word * k + truth, minlength=words * k).reshape(words, k)
    gold_pair = np.bincount(truth[follows - 1] * k + truth[follows], minlength=k * k).reshape(k, k)
    gold_open = np.bincount(truth[opens], minlength=k)
    parts = [np.zeros((len(used), k)), np.zeros(1), np.zeros(k), np.zeros((k, k)), np.zeros(k)]
    moment, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for at in range(1, steps + 1):
        own, trust, bias, transition, opening = parts
        emission = bias + trust[0] * known + np.add.reduceat(own[slots], begin[:-1], axis=0)
        single, pair = marginals(emission[t.word], t.first, transition, opening, follows)
        excess = np.stack([np.bincount(t.word, single[:, j], words) for j in range(k)], axis=1) - gold_word
        slope = [np.stack([np.bincount(slots, excess[owner, j], len(used)) for j in range(k)], axis=1) / n + l2 * own / len(used),
                 np.array([np.sum(excess * known) / n]), excess.sum(axis=0) / n, (pair - gold_pair) / n + l2 * transition / n,
                 (single[opens].sum(axis=0) - gold_open) / n]
        for p, m, s, g in zip(parts, moment, square, slope, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= rate * (m / (1 - 0.9**at)) / (np.sqrt(s / (1 - 0.99**at)) + 1e-8)
    model.slots[used] = parts[0]
    model.slots = model.slots.astype(np.float32)
    model.trust, model.bias, model.transition, model.opening = float(parts[1][0]), *parts[2:]
    return model


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, opening: np.ndarray,
              follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of words, and the expected number of each transition.

    The posterior of a pair is the left word's forward vector, the transition, and the right word's emission and backward
    vector; with single posteriors p the backward vector is p over the forward one, up to scale, so that one pass serves both.
    """
    single = chain(emission, first, transition, opening)
    forward = forwards(emission, first, transition, opening)
    step = np.exp(transition - transition.max())
    a, b = forward[follows - 1], single[follows]
    came = np.maximum(a @ step, 1e-300)
    # p(i, j) = a_i step_ij p_j / sum_i' a_i' step_i'j
    return single, np.einsum("ni,nj->ij", a, b / came) * step


def forwards(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Normalised forward vectors of short texts, side by side."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    step, local = np.exp(transition - transition.max()), np.exp(emission - emission.max(axis=1, keepdims=True))
    out, now = np.empty_like(local), np.exp(opening - opening.max())[None, :].repeat(len(count), 0)
    for j in range(int(count.max(initial=0))):
        m = int(np.searchsorted(-count[order], -j, side="left"))
        at = first[:-1][order[:m]] + j
        x = (now[:m] if j == 0 else now[:m] @ step) * local[at]
        now = x / x.sum(axis=1, keepdims=True)
        out[at] = now
    return out


# --- over tables

def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def _strings(column: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _learner(labels: list[str], share: int):
    """Lexicon counts of the rows outside the fit sample, and passages of those inside."""
    place = {x: i for i, x in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ENTRIES, len(labels)), np.int64)
        for batch in slices(batches, "text"):
            y = np.array([place[x] for x in batch.column("lang").to_pylist()], int)
            draw = batch.column("draw").to_numpy(zero_copy_only=False)
            texts = _strings(batch.column("text"))
            t = tokens(texts)
            row = np.repeat(np.arange(len(texts)), np.diff(t.first))
            learnt = draw[row] >= share
            np.add.at(total, (entry(t.hash)[t.word[learnt]], y[row[learnt]]), 1)
            out: list[tuple[int, int, str]] = []
            for i in np.flatnonzero(draw < share):
                words = [texts[i][a - t.base[i] : b - t.base[i]] for a, b in zip(
                    t.start[t.first[i] : t.first[i + 1]].tolist(), t.end[t.first[i] : t.first[i + 1]].tolist(), strict=True)]
                out += [(int(y[i]), 0, " ".join(words[j : j + PASSAGE])) for j in range(0, len(words), PASSAGE)]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([-1] * len(out), pa.int32()), pa.array(columns[0], pa.int32()),
                                                  pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                                                 ["entry", "label", "n", "passage"])
        at, label = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(label, pa.int32()), pa.array(total[at, label], pa.int64()),
                                          pa.nulls(len(at), pa.string())], ["entry", "label", "n", "passage"])

    return run


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", passages: int = PASSAGES,
          passage_bytes: int = 2_000, seed: int = SEED, **options) -> Model:
    """A model of the labelled rows outside the held-out part.

    Half of the rows at most, and about ``passages`` passages, are the fit sample, as many of each language as the draw gives; all others are counted for the
    lexicons. Passages of more than ``passage_bytes`` are not fitted on.
    """
    known = docs.where(F.col(lang).isNotNull() & ~held_out(doc_id))
    labels = sorted(r[0] for r in known.select(lang).distinct().collect())
    if not labels:
        return Model([], np.zeros((SLOTS, 0)), np.zeros((ENTRIES, 0)), 0.0, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    letters = known.agg(F.sum(F.octet_length(text))).first()[0] or 0
    share = min(0.5, 1.5 * passages / max(1.0, letters / (8 * PASSAGE)))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text)), F.lit(1 << 30))
    rows = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
    told = materialise(rows.mapInArrow(_learner(labels, int(share * (1 << 30))), "entry int, label int, n long, passage string"))
    counts = np.zeros((ENTRIES, len(labels)))
    for r in told.where("entry >= 0").groupBy("entry", "label").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.entry, r.label] = r.n
    cut = told.where((F.col("entry") < 0) & (F.octet_length("passage") <= passage_bytes))
    sample = cut.select("label", "passage").orderBy(F.xxhash64(F.lit(seed), "passage"), "passage", "label").limit(passages).collect()
    return fit([(r.passage.split(" "), r.label) for r in sample], labels, counts, seed=seed, **options)


def _classifier(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            pred, score = model.classify(_strings(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score)],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    model = train(docs, doc_id, text, lang, **options)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_classifier(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _tagger(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = _strings(batch.column("text"))
            t = tokens(texts)
            row = np.repeat(np.arange(len(texts)), np.diff(t.first))
            if not len(row) or not model.labels:
                continue
            posterior = model.posteriors(t)
            best = posterior.argmax(axis=1)
            new = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (row[1:] != row[:-1]))))
            last = np.concatenate((new[1:], [len(row)])) - 1
            sure = np.add.reduceat(posterior[np.arange(len(row)), best], new) / (last - new + 1)
            own = t.base[row[new]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[new])), pa.array(t.start[new] - own), pa.array(t.end[last] - own),
                 pa.array([model.labels[b] for b in best[new]], pa.string()), pa.array(last - new + 1, pa.int64()), pa.array(sure)],
                ["doc_id", "start", "end", "lang", "words", "score"])

    return run


def spans(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, lang, words, score): runs of words of one language, by code points, end exclusive."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_tagger(model), f"doc_id {kind}, start long, end long, lang string, words long, score double")
