"""Personal data by weak supervision.

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers; what they find always stands. Wider patterns
propose further candidates (and secrets as a fifth kind). Labelers vote yes, no or nothing on each candidate: format
and checksum rules, gazetteers of top-level domains, card issuers, dial codes and key prefixes, and the words around it.
Expectation-maximisation on the counts of vote patterns estimates how reliable each labeler is per kind, and so how likely each
pattern is personal data. With these likelihoods as soft labels, a logistic classifier over the span's shape and its context is
trained; candidates that it accepts are added to the base spans.

The classifier is trained on at most about ``FIT_SPANS`` candidates, drawn by hash; vote counts cover all candidates of all texts.

Defined cases: a null text is the empty text; bytes that are no UTF-8 count as one code point each; of overlapping candidates, the
first by kind and start is taken, and none overlaps a base span; without candidates nothing is added; rows of equal id, and rows
without one, are each searched. Every search is linear in the length of the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise
from .words import slices

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
FIT_SPANS = 20_000
DIMS = 1 << 16
ROUNDS = 50
ACCEPT = 0.5
SEED = 7

# Gazetteers and context words in English, French, German and Spanish.
TOP_LEVEL = frozenset("com org net edu gov mil int info io dev app ai co biz me eu uk us ca au de fr es it nl ch at be se no dk fi pl pt ru cn jp in br mx ar".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "2221", "2720", "6011", "65", "3528", "3589", "36", "38")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "pk_live_", "AIza", "ya29.", "eyJ")
CONTEXT = {
    "email": frozenset("mail email e-mail contact write address courriel adresse correo kontakt escribir schreiben".split()),
    "ip": frozenset("ip ipv4 ipv6 host server address client serveur servidor adresse dirección".split()),
    "card": frozenset("card visa mastercard amex credit debit payment carte tarjeta karte kreditkarte zahlung pago paiement".split()),
    "phone": frozenset("phone tel call mobile cell fax telephone telefon téléphone teléfono handy appeler anrufen llamar".split()),
    "secret": frozenset("password passwd pwd token secret key api_key apikey auth bearer credential passwort contraseña clave".split()),
}
COUNTER_CONTEXT = frozenset("isbn issn version release page pages chapter section figure table no nr number order invoice id doi total".split())


# --- base patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match inside a run of digits would be one from its start
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the run before an @ sign, so the leftmost match of each sign is found from the sign."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    found: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


# --- candidates and their labelers

_VEILED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}"
                     r"(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]{1,63}){1,4}")
_LOCAL_HOST = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?![A-Za-z0-9.-])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){0,6}(?![0-9A-Za-z:])")
_NUMBER = re.compile(r"(?<![0-9+(])[0-9(](?:[ ().-]{0,2}[0-9]){7,18}(?![0-9])")
_KEYED = re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?([^\s\"']{6,})")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,40}[0-9])[A-Za-z0-9_-]{16,}+")
_WORD = re.compile(r"[^\W\d_][\w-]*")
LABELERS = ("format", "checksum", "gazetteer", "context", "counter_context", "boundary", "spread")


class Cover:
    """Spans, and whether another one overlaps any of them."""

    def __init__(self, spans: list[Span]):
        self.starts = sorted(a for _, a, _ in spans)
        ends = [b for _, a, b in sorted(spans, key=lambda s: s[1])]
        self.upto = list(accumulate(ends, max))  # the furthest end of the spans so far
        self.more: list[tuple[int, int]] = []

    def meets(self, span: Span) -> bool:
        _, a, b = span
        k = bisect_left(self.starts, b)
        if k and self.upto[k - 1] > a:
            return True
        k = bisect_left(self.more, (b, 0))
        return k > 0 and self.more[k - 1][1] > a

    def add(self, span: Span) -> None:
        """Add a span that meets none."""
        insort(self.more, span[1:])


def candidates(text: str, base: list[Span]) -> list[Span]:
    """What wider patterns propose outside the base spans; the base spans themselves stand first."""
    found: list[Span] = list(base)
    if "@" in text:
        found += [("email", m.start(), m.end()) for m in _LOCAL_HOST.finditer(text)]
    if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text:
        found += [("email", m.start(), m.end()) for m in _VEILED.finditer(text)]
    if _DIGIT.search(text):
        if ":" in text:
            found += [("ip", m.start(), m.end()) for m in _IP6.finditer(text) if m[0].count(":") > 2]
        for m in _NUMBER.finditer(text):
            n = len(digits_of(m[0]))
            found.append(("card" if n >= 13 else "phone", m.start(), m.end()))
        found += [("secret", m.start(), m.end()) for m in _TOKEN.finditer(text)]
    if "=" in text or ":" in text:
        found += [("secret", m.start(1), m.end(1)) for m in _KEYED.finditer(text)]
    fixed, seen, taken = Cover(base), set(base), list(base)
    for span in found[len(base) :]:
        if span not in seen and not fixed.meets(span):
            seen.add(span)
            taken.append(span)
    return taken


def _near(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    before = [w.lower() for w in _WORD.findall(text[max(0, a - 48) : a])]
    return before[-4:], [w.lower() for w in _WORD.findall(text[b : b + 24])][:2]


def spread(text: str) -> float:
    """Entropy of the characters, in bits."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in (text.count(x) for x in set(text)))


def votes(text: str, span: Span) -> str:
    """One of + - 0 per labeler: yes, no, nothing to say."""
    kind, a, b = span
    own, (before, after) = text[a:b], _near(text, a, b)
    digits = digits_of(own)

    def say(yes: bool, no: bool = False) -> str:
        return "+" if yes else "-" if no else "0"

    shape = {
        "email": lambda: say("@" in own and "." in own.partition("@")[2], "@" not in own and "(" not in own and "[" not in own),
        "ip": lambda: say(own.count(".") == 3 or own.count(":") == 7 or "::" in own, True),
        "card": lambda: say(len(digits) in (14, 15, 16) and len(set(map(len, re.split("[ -]", own)))) <= 3, len(digits) > 16),
        "phone": lambda: say(own[0] == "+" or "(" in own or len(re.findall("[ .-]", own)) in (1, 2, 3, 4), len(digits) == len(own)),
        "secret": lambda: say(bool(re.search("[A-Za-z]", own)) and bool(digits), own.isalpha() or own.isdigit()),
    }[kind]()
    check = {
        "email": lambda: "0", "secret": lambda: "0", "ip": lambda: say(octets(own), True) if "." in own else "0",
        "card": lambda: say(luhn(digits), True), "phone": lambda: say(8 <= len(digits) <= 15 and digits[0] != "0", len(digits) > 13),
    }[kind]()
    listed = {
        "email": lambda: say(own.rpartition(".")[2].lower() in TOP_LEVEL, "." not in own),
        "ip": lambda: say(own.startswith(("10.", "192.168.", "172.16.", "fe80:", "2001:"))),
        "card": lambda: say(digits.startswith(ISSUERS), True),
        "phone": lambda: say(own.startswith(("+1", "+33", "+34", "+44", "+49", "00", "(")), False),
        "secret": lambda: say(own.startswith(KEY_PREFIXES)),
    }[kind]()
    key = text[max(0, a - 2) : a]
    told = say(any(w in CONTEXT[kind] for w in before) or kind == "secret" and "=" in key)
    against = "-" if any(w in COUNTER_CONTEXT for w in before[-1:]) else "0"
    cut = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
    even = spread(own.lower())
    wide = say(even >= 3.0, even < 2.0) if kind == "secret" else say(False, even < 1.5)
    return shape + check + listed + told + against + ("-" if cut else "0") + wide


def traits(text: str, span: Span) -> list[int]:
    """Hashed traits of a span: its shape, length and neighbours, each within its kind."""
    from xxhash import xxh32_intdigest

    kind, a, b = span
    own, (before, after) = text[a:b], _near(text, a, b)
    classes = re.sub(r"(.)\1+", r"\1", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", own))))
    digits = len(digits_of(own))
    names = ["bias", f"shape {classes[:24]}", f"digits {digits}", f"length {min(len(own), 48) // 4}",
             f"share {10 * digits // len(own)}", f"spread {int(2 * spread(own.lower()))}", f"first {own[:2]}",
             f"key {text[max(0, a - 1):a]}", f"next {text[b:b + 1]}", *[f"before {w}" for w in before[-2:]], *[f"after {w}" for w in after[:1]]]
    return [xxh32_intdigest(f"{kind} {n}", SEED) % DIMS for n in names]


# --- reliabilities and the classifier

def reliabilities(patterns: dict[tuple[str, str], int], rounds: int = ROUNDS) -> dict[tuple[str, str], float]:
    """Probability that a candidate with these votes is personal data, by EM per kind.

    The votes of a labeler are taken as independent given the truth. Weak priors say that yes is likelier for true
    spans, which keeps the two classes from changing places.
    """
    out: dict[tuple[str, str], float] = {}
    place = {"+": 0, "-": 1, "0": 2}
    for kind in sorted({k for k, _ in patterns}):
        rows = sorted((v, n) for (k, v), n in patterns.items() if k == kind)
        vote = np.array([[place[c] for c in v] for v, _ in rows])
        count = np.array([n for _, n in rows], float)
        truth = 1 / (1 + np.exp(-1.5 * ((vote == 0).sum(1) - (vote == 1).sum(1))))
        prior = np.array([[4.0, 1.0, 2.0], [1.0, 4.0, 2.0]])  # of true and of other spans: yes, no, nothing
        for _ in range(rounds):
            table = np.zeros((2, vote.shape[1], 3))
            for y, weight in enumerate((truth, 1 - truth)):
                for v in range(3):
                    table[y, :, v] = (count * weight) @ (vote == v) + prior[y, v]
            table /= table.sum(axis=2, keepdims=True)
            share = ((count * truth).sum() + 1) / (count.sum() + 2)
            each = np.log(table)[:, np.arange(vote.shape[1])[None, :], vote].sum(axis=2)
            truth = 1 / (1 + np.exp(np.clip(each[1] - each[0] + np.log(1 - share) - np.log(share), -500, 500)))
        out.update({(kind, v): float(t) for (v, _), t in zip(rows, truth, strict=True)})
    return out


def train(rows: list[tuple[list[int], float]], steps: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression on soft labels: the traits that carry weight, and their weights."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0)
    row = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
    names, col = np.unique(np.concatenate([t for t, _ in rows]), return_inverse=True)
    label = np.array([y for _, y in rows])
    w, look, t = np.zeros(len(names)), np.zeros(len(names)), 1.0
    rate = 4 / max(len(x) for x, _ in rows)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.bincount(row, look[col], len(rows))))
        new = look - rate * (np.bincount(col, (p - label)[row], len(names)) / len(rows) + ridge * look)
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / nt * (new - w), new, nt
    return names.astype(np.int64), w


@dataclass
class Model:
    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self.of = dict(zip(self.names.tolist(), self.weights.tolist(), strict=True))

    def probability(self, own: list[int]) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, sum(self.of.get(i, 0.0) for i in own)))))


def accepted(base: list[Span], others: list[tuple[Span, list[int]]], model: Model) -> list[Span]:
    """Base spans and the candidates that the classifier accepts, by kind and start."""
    taken, cover = list(base), Cover(base)
    for span, own in sorted(others, key=lambda x: (KINDS.index(x[0][0]), x[0][1], x[0][2])):
        if not cover.meets(span) and model.probability(own) >= ACCEPT:
            cover.add(span)
            taken.append(span)
    return sorted(taken, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


# --- on Spark

SPAN = "struct<kind:string,start:long,end:long,votes:string,traits:array<int>,base:boolean>"
_SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.string()),
                        ("traits", pa.list_(pa.int32())), ("base", pa.bool_())])


def examine(text: str) -> list[dict]:
    base = base_spans(text)
    return [{"kind": s[0], "start": s[1], "end": s[2], "votes": votes(text, s), "traits": traits(text, s), "base": i < len(base)}
            for i, s in enumerate(candidates(text, base))]


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [examine(x.decode("utf-8", "replace")) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN_TYPE))], ["doc_id", "found"])


def examined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found): the candidates of every text with their votes and traits. A written table."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return materialise(rows.mapInArrow(_examine, f"doc_id {kind}, found array<{SPAN}>"))


def learn(found: DataFrame, rows: int = FIT_SPANS, seed: int = SEED) -> Model:
    """Reliabilities from the counts of all vote patterns, then the classifier from a bounded sample of candidates."""
    spans = found.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.*")
    patterns = {(r[0], r[1]): r[2] for r in spans.groupBy("kind", "votes").count().collect()}  # 3 to the labelers at most
    truth = reliabilities(patterns)
    total = sum(patterns.values())
    share = min(1.0, rows / max(1, total))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start"), F.lit(1 << 30)) < F.lit(int((1 << 30) * share))
    sample = sorted((list(r[0]), truth[r[1], r[2]]) for r in spans.where(drawn).select("traits", "kind", "votes").collect())
    return Model(*train(sample))


def _label(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column("found").to_pylist():
                all_spans = [((s["kind"], s["start"], s["end"]), s["traits"], s["base"]) for s in found]
                base = sorted((s for s, _, b in all_spans if b), key=lambda s: (KINDS.index(s[0]), s[1]))
                spans = accepted(base, [(s, t) for s, t, b in all_spans if not b], model)
                join = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
                out.append([*[sum(k == kind for k, _, _ in base) for kind in BASE_KINDS],
                            hashlib.sha256(join(base).encode()).hexdigest(), join(spans)])
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]],
                ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"])

    return run


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = FIT_SPANS) -> DataFrame:
    """Per document the number of base spans of each kind, a digest of them, and all spans."""
    found = examined(docs, doc_id, text)
    kind = found.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return found.mapInArrow(_label(learn(found, rows)), f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redact_text(text: str, model: Model) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are replaced as one."""
    base = base_spans(text)
    others = [(s, traits(text, s)) for s in candidates(text, base)[len(base) :]]
    out, at = [], 0
    for kind, a, b in sorted(accepted(base, others, model), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = FIT_SPANS) -> DataFrame:
    """The documents with their spans replaced; texts are changed where they stand, and null stays null."""
    model = learn(examined(docs, doc_id, text), rows)

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else redact_text(x.decode("utf-8", "replace"), model)
                         for x in column.cast(pa.binary()).to_pylist()], pa.string())

    return docs.withColumn(text, clean(F.col(text)))
