"""Toxicity classifier that is regularised by counterfactuals.

A logistic model over the words of a text and their first four and five bytes, present or not, with an L1 penalty; features that tell positive rows from others by fewer than ``LEAST_ERRORS``
standard errors are left out. Sentences of
the training sample that name a group get counterfactual twins, in which each identity term is swapped for another of its kind; the
squared difference of the two raw scores is added to the loss. So a group's name cannot carry weight that another group's does not,
and neutral mentions are not taken for toxic ones.

The model is fitted on at most ``FIT_ROWS`` labelled rows, drawn by a hash of their id; every text is scored whole.

Defined cases: a null text is the empty text; a text without words has the score of the intercept; a label row that is null or
belongs to no document is left out, and a document with several label rows counts as each of them; where no label can be learned from,
or all are equal, the score is the smoothed share of positive labels. A null id is held out never and learned from never.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import settle
from .words import buffers, hash_spans, mix64, slices, split_words

FIT_ROWS = 10_000
FOLDS = 5
PREFIXES = (4, 5)
L1 = 1e-5
COUNTERFACTUAL = 0.2
TWINS = 2
STEPS = 400
LEAST_ERRORS = 4.0
MOST_FEATURES = 4000
SEED = 2

# Terms that name groups, by kind; a term is swapped for another of its row.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("mother", "father"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"), ("transgender", "cisgender"),
    ("immigrants", "natives", "refugees", "foreigners"), ("immigrant", "native", "refugee", "foreigner"),
    ("old", "young", "elderly"), ("deaf", "blind", "disabled"), ("poor", "rich"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulman", "chrétien", "juif"), ("noir", "blanc"),
    ("frauen", "männer"), ("frau", "mann"), ("muslimisch", "christlich", "jüdisch"), ("schwarz", "weiß"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmán", "cristiano", "judío"), ("negro", "blanco"),
)

# upper case to lower, ASCII other than letters and digits to a space
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the features of each text, repeats included, and the row of each."""
    data, offsets = buffers(column)
    data = _PLAIN[data]
    words = split_words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    names = [hash_spans(data, words.start, words.end)]
    for n in PREFIXES:
        names.append(mix64(hash_spans(data, words.start, np.minimum(words.start + n, words.end)) + np.uint64(n)))
    return np.concatenate(names), np.tile(row, len(names))


def swap_table(terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> dict[bytes, list[bytes]]:
    return {t.encode(): [x.encode() for x in kind if x != t] for kind in terms for t in kind}


def counterfactual(text: bytes, swaps: dict[bytes, list[bytes]], rng: random.Random) -> bytes | None:
    """The text, in plain words, with each identity term swapped for another of its kind; None if it has none."""
    words = _PLAIN[np.frombuffer(text, np.uint8)].tobytes().split()
    if not any(w in swaps for w in words):
        return None
    return b" ".join(rng.choice(swaps[w]) if w in swaps else w for w in words)


@dataclass
class Model:
    """Names of the features that carry weight, in order, their weights, and the intercept."""

    names: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, column: pa.Array) -> np.ndarray:
        raw = np.full(len(column), self.intercept)
        if len(self.names):
            names, row = features(column)
            likely = np.zeros(1 << 20, bool)
            likely[self.names & np.uint64((1 << 20) - 1)] = True
            some = likely[names & np.uint64((1 << 20) - 1)]
            names, row = names[some], row[some]
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            known = self.names[at] == names
            once = np.unique(row[known] * len(self.names) + at[known])
            raw += np.bincount(once // len(self.names), self.weights[once % len(self.names)], len(raw))
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def fit(texts: list[bytes], labels: np.ndarray, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, l1: float = L1,
        counterfactual_weight: float = COUNTERFACTUAL, twins: int = TWINS, steps: int = STEPS, least_rows: int = 3,
        least_errors: float = LEAST_ERRORS, most_features: int = MOST_FEATURES, seed: int = SEED) -> Model:
    """Accelerated proximal gradient on the logistic loss, the L1 penalty and the squared change of twins' scores."""
    labels = np.asarray(labels, float)
    n = len(labels)
    share = (labels.sum() + 0.5) / (n + 1)
    prior = float(np.log(share / (1 - share)))
    if n == 0 or labels.min() == labels.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), prior)
    swaps, rng = swap_table(terms), random.Random(seed)
    pairs = [(i, t) for i, x in enumerate(texts) for _ in range(twins) if (t := counterfactual(x, swaps, rng)) is not None]

    def present(own: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Features of some texts at a time, once per text."""
        for low in range(0, len(own), 500):
            names, row = features(pa.array(own[low : low + 500], pa.binary()))
            order = np.lexsort((names, row))
            names, row = names[order], row[order]
            new = np.ones(len(names), bool)
            new[1:] = (names[1:] != names[:-1]) | (row[1:] != row[:-1])
            yield names[new], row[new] + low

    counts = []
    for names, row in present(texts):
        names, at = np.unique(names, return_inverse=True)
        counts.append((names, np.bincount(at).astype(float), np.bincount(at, labels[row])))
    known, at = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
    seen, toxic = (np.bincount(at, np.concatenate([c[i] for c in counts]), len(known)) for i in (1, 2))
    del counts, at
    positives = labels.sum()
    # how many standard errors a feature's share among positive rows lies off that among the others
    pooled = seen / n
    apart = (toxic / positives - (seen - toxic) / (n - positives)) / np.sqrt(
        np.maximum(pooled * (1 - pooled), 1e-12) * (1 / positives + 1 / (n - positives)))
    clear = np.flatnonzero((seen >= least_rows) & (np.abs(apart) >= least_errors))
    known = known[np.sort(clear[np.argsort(-np.abs(apart[clear]), kind="stable")[:most_features]])]
    if not len(known):
        return Model(np.zeros(0, np.uint64), np.zeros(0), prior)

    def matrix(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows, cols = [np.zeros(0, int)], [np.zeros(0, int)]
        for names, row in present(own):
            at = np.minimum(np.searchsorted(known, names), len(known) - 1)
            ok = known[at] == names
            rows.append(row[ok])
            cols.append(at[ok])
        return np.concatenate(rows), np.concatenate(cols)

    row, col = matrix(texts)
    twin_row, twin_col = matrix([t for _, t in pairs])
    of = np.array([i for i, _ in pairs], int)
    p = len(known)

    def slope(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        z = np.bincount(row, w[col], n)
        off = (1 / (1 + np.exp(-np.clip(z + b, -500, 500))) - labels) / n
        pull = off.copy()
        g = np.zeros(p)
        if len(of):
            change = 2 * counterfactual_weight / n * (z[of] - np.bincount(twin_row, w[twin_col], len(of)))
            pull += np.bincount(of, change, n)
            g -= np.bincount(twin_col, change[twin_row], p)
        return g + np.bincount(col, pull[row], p), float(off.sum())

    # step length from the largest curvature, by power iteration
    v = np.random.default_rng(seed).random(p) + 0.1
    for _ in range(12):
        v /= np.linalg.norm(v)
        z = np.bincount(row, v[col], n) / n / 4
        pull, extra = z, np.zeros(p)
        if len(of):
            change = 2 * counterfactual_weight / n * (4 * n * z[of] - np.bincount(twin_row, v[twin_col], len(of)))
            pull = z + np.bincount(of, change, n)
            extra = -np.bincount(twin_col, change[twin_row], p)
        v = np.bincount(col, pull[row], p) + extra
    step = 1 / (1.5 * np.linalg.norm(v) + 0.25 + 1e-12)
    w, b, y, yb, t = np.zeros(p), prior, np.zeros(p), prior, 1.0
    for _ in range(steps):
        g, gb = slope(y, yb)
        new = y - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = yb - step * gb
        if np.sum((y - new) * (new - w)) > 0:  # momentum points uphill: start it anew
            t = 1.0
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, yb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    keep = np.abs(w) > 1e-6
    return Model(known[keep], w[keep], b)


def held_out(doc_id: str, folds: int = FOLDS):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int = FIT_ROWS,
                  seed: int = SEED) -> list[tuple[bytes, int]]:
    """At most about ``rows`` labelled texts outside the held-out part, in a fixed order."""
    known = settle(labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
                   .select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label")).distinct())
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(seed), "__id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * share)))
    picked = docs.join(F.broadcast(drawn), F.col(doc_id) == F.col("__id")).select(
        F.col("__id"), F.col("__label"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("__text"))
    return [(bytes(t), y) for _, y, t in sorted((i, y, bytes(t)) for i, y, t in picked.collect())]


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score = model.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score),
                                              pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
             rows: int = FIT_ROWS, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    sample = training_rows(docs, labels, doc_id, text, label, rows)
    model = fit([t for t, _ in sample], np.array([y for _, y in sample]), **options)
    texts = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_scorer(model), f"doc_id {kind}, held_out boolean, score double, predicted int")
