"""Target resampling, ranked lexical search and language identification: edge cases and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from check import connect
from cohortwave.llm import importance, langid, lexical, terms
from cohortwave.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, rank int, score double, `item_id` long, words string"
LONG = " ".join(f"w{i % 997}x" for i in range(60_000))
SAID = "the quick brown fox jumps over the lazy dog while twenty seven other small animals look on from the far side"


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "a", 1, 0.5, 9, "x")


ROWS = [row(1, SAID), row(2, None), row(3, ""), row(4, " \t\n ..!? "), row(5, LONG), row(6, SAID, None), row(7, "solo"),
        row(8, "ünï cødé 日本 é Ünï ÜNÏ"), row(9, "x" * 70_000), row(None, SAID), row(10, "A\x00B\x1fC\x85D"),
        row(6, SAID), row(11, "12 34 ... !!"), row(12, SAID.upper()), row(None, None)]
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


# --- 11 target resampling

def test_checksums_of_runs():
    rng = random.Random(1)
    texts = [r[1] for r in ROWS] + [" ".join(rng.choice(["ab", "c", "Ümlaut", "d" * 65, "e" * 300]) for _ in range(50))]
    want = Counter()
    for i, t in enumerate(texts):
        w = plain_terms(t)
        for n in (1, 2, 3):
            for j in range(len(w) - n + 1):
                want[i, zlib.crc32(" ".join(w[j : j + n]).encode())] += 1
    sums, rows = importance.run_checksums(*terms.terms(pa.array(texts)))
    assert Counter(zip(rows.tolist(), sums.tolist())) == want
    assert all(len(x) == 0 for x in importance.run_checksums(*terms.terms(pa.array([], pa.string()))))


def test_cutoff_is_the_exact_key(spark):
    rng = random.Random(2)
    keys = [(rng.randint(-30, 30), i) for i in range(900)] + [(5, 7)] * 40
    frame = importance.materialise(spark.createDataFrame(keys, "score long, id long").repartition(7))
    order = sorted(keys, key=lambda x: (-x[0], x[1]))
    for k in (1, 2, 57, 400, 470, 939, 940):
        assert importance.cutoff(frame, k, block=50, finish=4, rewrite=3) == order[k - 1]
    assert importance.cutoff(frame, 300) == order[299]
    for k in (0, 941):
        with pytest.raises(ValueError):
            importance.cutoff(frame, k)


def plain_resample(rows, target, percent, least):
    def grams(text):
        w = plain_terms(text)
        return [zlib.crc32(" ".join(w[j : j + n]).encode()) % 10_000 for n in (1, 2, 3) for j in range(len(w) - n + 1)]

    s, t = Counter(g for _, x in rows for g in grams(x)), Counter(g for x in target for g in grams(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out = []
    for k, x in rows:
        u = (int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        weight = sum(gain[g] for g in grams(x))
        out.append([k, len(grams(x)), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, len(plain_terms(x))])
    large = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(large[: percent * len(large) // 100], 1):
        r[4] = i
    return Counter(tuple(r[:5]) for r in out)


def test_resampling(spark, docs, none):
    target = [SAID + " and more words", None, "", "other words"]
    targets = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    pairs = [(r[0], r[1]) for r in ROWS]
    for percent, options in ((40, {}), (100, {"block": 2, "finish": 1}), (0, {})):
        got = importance.resample(docs, targets, percent=percent, least_words=6, **options)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert Counter(map(tuple, got.collect())) == plain_resample(pairs, target, percent, 6)
    assert importance.resample(none, targets).isEmpty()
    assert importance.resample(docs, none).count() == len(ROWS)


def test_drawn_look_like_the_target(spark):
    rng = random.Random(3)
    raw = [(i, " ".join(rng.choice("abcdefghij" if i % 10 else "klmnopqrst") for _ in range(40))) for i in range(600)]
    target = spark.createDataFrame([(" ".join(rng.choice("klmnopqrst") for _ in range(400)),)], "text string")
    drawn = importance.resample(spark.createDataFrame(raw, "doc_id long, text string"), target).where("rank is not null").collect()
    assert len(drawn) == 30 and all(r.doc_id % 10 == 0 for r in drawn)


# --- 12 lexical search

def plain_search(rows, items, top):
    terms_of = [(k, plain_terms(t)) for k, t in rows]
    holding = [w for _, w in terms_of if w]
    n_docs, length = len(holding), sum(map(len, holding))
    df = Counter(x for w in holding for x in set(w))
    asked = defaultdict(Counter)
    for k, t in items:
        asked[k].update(plain_terms(t))
    out = Counter()
    for k, words in asked.items():
        found = []
        for d, w in terms_of:
            counts, score = Counter(w), 0
            for x, r in words.items():
                if counts[x]:
                    m = 75 + 25 * len(w) * n_docs // length
                    score += r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (
                        1_000_000_000 * counts[x] // (1000 * counts[x] + 12 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out.update((k, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:top], 1))
    return out


@pytest.mark.parametrize("options", [{}, {"short": 1}, {"short": 10**9}, {"block": 300, "stride": 4, "short": 3}, {"item_bytes": 200}])
def test_search_against_brute_force(spark, options):
    rng = random.Random(4)
    vocabulary = [f"t{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(5, rows[5][1]), (None, rows[3][1]), (2000, None)]
    items = [(i, " ".join(rng.choice([*vocabulary, "never"]) for _ in range(rng.randint(1, 20)))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "never seen"), (None, rows[3][1]), (3, items[4][1]), (33, "T1 t1 t1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(frame, asked, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_search(rows, items, 20)


def test_search_edges(spark, docs, none):
    asked = spark.createDataFrame([(1, SAID, "x"), (2, "日本 ünï", "y"), (3, None, "z")], "item_id long, text string, rank string")
    got = lexical.search(docs, asked)
    assert Counter(map(tuple, got.collect())) == plain_search([(r[0], r[1]) for r in ROWS], [(1, SAID), (2, "日本 ünï")], 20)
    assert lexical.search(none, asked).isEmpty() and lexical.search(docs, none).isEmpty()


def test_long_lists_are_skipped():
    """With a few documents that hold rare terms, those that hold frequent terms only are never scored."""
    rng = random.Random(5)
    texts = [" ".join(["the", "of", *(["rare", "odd"] if i < 40 else []), *(f"f{rng.randint(0, 9)}" for _ in range(20))]) for i in range(4000)]
    hashes = np.sort(lexical.hash_words(*terms.terms(pa.array(["the of rare odd"]))))
    items = lexical.Items(hashes, [np.arange(4)], [np.ones(4, np.int64)])
    block = lexical.postings(pa.array(texts), items)
    statistics = lexical.Statistics(4000, 4000 * 22, np.diff(block.first))
    best = [lexical.Best(20)]
    share = lexical.shares(block, statistics, statistics.weights())
    met = lexical.search_block(block, share, items, best, np.arange(4000), np.zeros(4000, bool), stride=64)
    assert met < 200 and set(best[0].ids.tolist()) <= set(range(40))


# --- 13 language by words

def plain_chain(emission, transition, opening):
    n, k = emission.shape
    a, b = np.zeros((n, k)), np.zeros((n, k))
    add = np.logaddexp.reduce
    a[0] = opening + emission[0]
    for i in range(1, n):
        a[i] = emission[i] + add(a[i - 1][:, None] + transition, axis=0)
    for i in range(n - 2, -1, -1):
        b[i] = add(transition + (emission[i + 1] + b[i + 1])[None, :], axis=1)
    z = add(a[-1])
    pair = np.zeros((k, k))
    for i in range(1, n):
        pair += np.exp(a[i - 1][:, None] + transition + (emission[i] + b[i])[None, :] - z)
    return np.exp(a + b - z), pair


def test_forward_backward_is_exact_at_any_length():
    rng = np.random.default_rng(6)
    sizes = [0, 1, 5, 31, 32, 33, 64, 65, 500, 0, 2]
    first = np.concatenate(([0], np.cumsum(sizes)))
    emission, transition, opening = rng.normal(0, 3, (first[-1], 3)), rng.normal(0, 2, (3, 3)), rng.normal(0, 1, 3)
    got = langid.chain(emission, first, transition, opening)
    pairs = np.zeros((3, 3))
    for i, n in enumerate(sizes):
        if n:
            want, pair = plain_chain(emission[first[i] : first[i + 1]], transition, opening)
            assert np.allclose(got[first[i] : first[i + 1]], want, atol=1e-9)
            pairs += pair
    follows = np.ones(first[-1], bool)
    follows[first[:-1][np.diff(first) > 0]] = False
    single, pair = langid.marginals(emission, first, transition, opening, np.flatnonzero(follows))
    assert np.allclose(single, got) and np.allclose(pair, pairs, atol=1e-8)
    assert langid.chain(np.zeros((0, 3)), np.array([0, 0]), transition, opening).shape == (0, 3)


def test_words_and_features():
    texts = ["Ünï c0dé, It's", "", "日本 x", "İstanbul"]
    t = langid.tokens(texts)
    words = [texts[i][a - t.base[i] : b - t.base[i]] for i in range(4) for a, b in zip(
        t.start[t.first[i] : t.first[i + 1]], t.end[t.first[i] : t.first[i + 1]])]
    assert words == ["Ünï", "c", "dé", "It", "s", "日本", "x", "İstanbul"]
    slots, begin = langid.features(langid.tokens(["ab"]))
    # ^a ^ab ab$ b$ a b ab ^ab$
    assert len(slots) == 8 and begin.tolist() == [0, 8]
    a, b = (set(langid.features(langid.tokens([x]))[0].tolist()) for x in ("abc", "zabc"))
    assert len(a & b) >= 6
    assert len(langid.features(langid.tokens(["", "1 2"]))[0]) == 0


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op13_language_by_words"](spark, sf).collect()}
    truth = dict(connect(sf).execute("SELECT doc_id, lang FROM documents").fetchall())
    assert rows.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 for k, r in rows.items())
    held = [rows[k].lang_pred == v for k, v in truth.items() if v and rows[k].held_out]
    assert len(held) > 200 and np.mean(held) > 0.98


def test_switched_texts_are_labelled_by_word(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(frame)
    assert (np.diag(model.transition) > model.transition.mean(axis=1)).all()
    some = connect("/root/testdata/sf0.01").execute(
        "SELECT lang, text FROM documents WHERE doc_id % 4 = 1 AND length(text) BETWEEN 300 AND 3000 ORDER BY doc_id").fetchall()
    some = [(y, " ".join(x.split()[:30])) for y, x in some if len(x.split()) >= 30][:60]
    mixed = [(i, f"{a[1]} {b[1]}", a[0], b[0], len(a[1])) for i, (a, b) in enumerate(zip(some, some[7:]))]
    tagged = defaultdict(list)
    for r in langid.spans(spark.createDataFrame([(m[0], m[1]) for m in mixed], "doc_id long, text string"), model).collect():
        tagged[r.doc_id].append(r)
    right = total = 0
    for i, text, a, b, cut in mixed:
        for r in tagged[i]:
            total += r.end - r.start
            right += max(0, min(r.end, cut) - r.start) * (r.lang == a) + max(0, r.end - max(r.start, cut)) * (r.lang == b)
    assert right > 0.9 * total


def test_language_edges(spark, docs, none):
    rows = langid.identify(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)
    by = {r.doc_id: r for r in rows}
    assert {by[k].lang_pred for k in (2, 3, 4, 11)} == {"und"} and by[2].score == 0.0
    assert {by[k].lang_pred for k in (1, 5, 6, 7, 8, 9)} == {"en"}
    assert not by[None].held_out
    assert langid.identify(none).isEmpty()
    unknown = docs.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.identify(unknown).collect()} == {"und"}
