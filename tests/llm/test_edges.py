"""Nulls, empty and long texts, ties, repeated rows, empty tables and further columns with clashing names."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortwave.llm import ann, minhash, mixing, packing, pii, quality, simhash, suffix_dedup, tables, toxicity, warc, words
from corpus_pipeline import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, `key` string, draw double"


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text), 7, 1, "k", 0.5)


LONG = " ".join(f"w{i % 997}x" for i in range(60_000))
ROWS = [row(1, "one two three four five six seven"), row(2, None), row(3, ""), row(4, "  \t\n "), row(5, LONG),
        row(6, "one two three four five six seven", "b"), row(7, "solo", None), row(8, "ünï cødé 日本 é", "b"),
        row(9, "x" * 70_000, None), row(None, "no id here at all today", "b"), row(10, "A\x00B\x1fC\x85D", "b"),
        row(6, "one two three four five six seven", "b"), row(11, "mail me at ann.b@mail.example.org or +1 (415) 555-0100.", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 0), (9, 0, 1), (None, 1, 1), (5, None, None), (99, 0, 0)],
                                 "doc_id long, quality int, toxic int")


def same_ids(rows):
    return Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)


# --- shared steps

def test_words_and_hashes():
    texts = ["a bb  ccc\ndd ee", None, "", "one", "x" * 9000 + " yy", "bb ccc dd ee ff", "ünï cødé x \x85\x1c b"]
    data, offsets = words.buffers(pa.array(texts))
    found = words.split_words(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(found.start, found.end)] == [w for t in texts for w in (t or "").encode().split()]
    named = {}
    for a, b, h in zip(found.start, found.end, words.hash_words(data, found)):
        assert named.setdefault(bytes(data[a:b]), h) == h
    assert len(set(named.values())) == len(named)
    sliced = pa.array(["zz", *texts]).slice(1)
    assert (words.buffers(sliced)[0] == data).all()


def test_threshold_and_positions(spark):
    rng = random.Random(1)
    rows = [(g, rng.getrandbits(60), rng.randint(0, 9)) for g in "abc" for _ in range(300)]
    frame = spark.createDataFrame(rows, "g string, k long, w long")
    goals = [("a", 0.0), ("b", 500.3), ("c", 1e9)]
    got = dict(tables.threshold(frame, spark.createDataFrame(goals, "g string, goal double"), "g", "k", "w", "goal", "last").collect())
    assert got["a"] == -1 and got["c"] == 1 << tables.KEY_BITS
    taken = sum(w for g, k, w in rows if g == "b" and k <= got["b"])
    assert abs(taken - 500.3) <= 4.5
    names = spark.createDataFrame([("é",), ("z",), (None,), ("B",), ("a",)], "s string")
    assert {r.s: r.at for r in tables.positions(names, "s", "at").collect()} == {"B": 0, "a": 1, "z": 2, "é": 3, None: 4}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(map(tuple, tables.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert all(got.get(x, x) == find(x) for x in root)
    assert tables.components(spark.createDataFrame([], "a long, b long"), "a", "b").isEmpty()


def test_join_skewed_keeps_every_row(spark):
    rows = spark.createDataFrame([(i % 3 if i % 2 else 9, i) for i in range(500)], "k int, v int")
    values = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    for most in (1, 3, 1000):
        assert tables.join_skewed(rows, values, "k", "n", most).count() == 500


# --- 1 mixing

def test_mixing(docs, none):
    rows = mixing.report(docs).collect()
    assert same_ids(rows) and all(r.taken <= 2 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    total = sum(r.size for r in rows)
    assert sum({(r.source_size, r.target) for r in rows} and {r.target for r in rows}) == pytest.approx(1.5 * total)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.report(docs.repartition(5)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.taken // r.size for r in rows if r.size) + sum(
        1 for _ in mixed.where("text is null or trim(text) = '' or text rlike '^[ \\t\\n]*$'").collect())
    assert mixing.report(none).isEmpty() and mixing.mix(none).isEmpty()


def test_water_filling_clamps_until_feasible(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 20), ("d", 0), (None, 500)]
    frame = spark.createDataFrame([(s, n, w) for (s, n), w in zip(sizes, (3, 1, 2, 3, 1))], "s string, n long, w int")
    got = {r.s: r["__target"] for r in mixing.water_fill(frame, "n", "w", 1.5, 2).collect()}
    assert got["a"] == 20 and got["c"] == 40 and got["d"] == 0
    assert got[None] == 1000 and got["b"] == pytest.approx(1.5 * 1530 - 1060)


# --- 2 toxicity

def test_toxicity(spark, docs, none, labels):
    rows = toxicity.classify(docs, labels).collect()
    assert same_ids(rows) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert toxicity.classify(none, labels).isEmpty()
    assert toxicity.classify(docs, labels.limit(0)).count() == len(ROWS)


def test_counterfactuals_lower_false_positives_on_neutral_mentions():
    rng = random.Random(5)
    filler = [f"word{i}" for i in range(60)]
    texts, labels_ = [], []
    for i in range(1500):
        toxic = i % 3 == 0
        body = rng.sample(filler, 8) + (["vile"] if toxic and rng.random() < 0.7 else [])
        # in the sample one group is named in toxic sentences mostly, another one evenly
        body += ["muslim"] if rng.random() < (0.6 if toxic else 0.03) else ["christian"] if rng.random() < 0.3 else []
        texts.append(" ".join(body).encode())
        labels_.append(int(toxic))
    neutral = pa.array([" ".join([*rng.sample(filler, 8), "muslim"]) for _ in range(200)])
    plain = toxicity.fit(texts, np.array(labels_), counterfactual_weight=0.0).score(neutral)
    fair = toxicity.fit(texts, np.array(labels_), counterfactual_weight=20.0).score(neutral)
    assert (fair >= 0.5).mean() < (plain >= 0.5).mean() and fair.mean() < plain.mean() - 0.1
    vile = toxicity.fit(texts, np.array(labels_), counterfactual_weight=20.0).score(pa.array(["a vile word1 word2"]))
    assert vile[0] > 0.5


# --- 3 repeats

def plain_removal(raw, length):
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def test_run_length_index():
    rng = random.Random(3)
    for _ in range(150):
        strings = ["".join(rng.choice("ab\0") for _ in range(rng.randint(1, 40))).encode() for _ in range(rng.randint(1, 6))]
        strings = list(dict.fromkeys([*strings, strings[0] * 2, b"ab" * 20]))
        copies = [rng.random() < 0.3 for _ in strings]
        length = rng.choice([3, 5, 8])
        seen = Counter()
        for s, c in zip(strings, copies):
            for i in range(len(s) - length + 1):
                seen[s[i : i + length]] += 1 + c
        for s, got in zip(strings, suffix_dedup.repeated_windows(strings, copies, length)):
            assert got.tolist() == [i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1]


def test_strings_with_copies_stand_in_the_index_once(monkeypatch):
    sizes, plain = [], suffix_dedup.matching_statistics
    monkeypatch.setattr(suffix_dedup, "matching_statistics", lambda text, *rest: sizes.append(len(text)) or plain(text, *rest))
    found = suffix_dedup.repeated_windows([b"abcdefgh", b"xxabcdyy", b"ab"], [True, False, True], 4)
    assert sizes == [18] and [x.tolist() for x in found] == [[0, 1, 2, 3, 4], [2], []]


def test_runs_are_fewer_in_repetitive_text():
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh") for _ in range(400)).encode()
    strings = [base[:i] + b"#" + base[i:] for i in range(50, 90)]
    text = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    left = (np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))).astype(np.int32)
    best, runs = suffix_dedup.matching_statistics(text, left, np.repeat(np.arange(len(strings), dtype=np.int32), sizes))
    assert runs < len(text) / 5 and best.max() > 300


@pytest.mark.parametrize("options", [{}, {"most_bytes": 200}])
def test_repeats(spark, docs, none, options):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcd ") for _ in range(300)) for _ in range(4)]
    texts = []
    for _ in range(40):
        t = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 200)))
        b, a = rng.choice(base), rng.randint(0, 200)
        texts.append(t[:50] + b[a : a + rng.randint(30, 100)] * (rng.random() < 0.5) + t[50:] + "xy" * rng.choice([0, 0, 0, 40]))
    texts += [texts[0], texts[1], "é" * 40, None, "", "z" * 500]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[2]), (3, texts[3])]
    raw = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), t, gone in zip(rows, raw, plain_removal(raw, 48)):
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, suffix_dedup.report(frame, length=48, gram=16, bucket_bytes=4000, **options).collect())) == want
    if not options:
        assert suffix_dedup.report(none).isEmpty() and same_ids(suffix_dedup.report(docs).collect())


# --- 4 simhash

def test_trie_join(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    values = list(map(int, base))
    for x in base[:40]:
        for _ in range(12):
            y = int(x)
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                y ^= 1 << int(b)
            values.append(y)
    values = np.unique(np.array(values, np.uint64))
    signed = values.view(np.int64).tolist()
    want = {(min(signed[i], signed[j]), max(signed[i], signed[j])) for i in range(len(values)) for j in range(i)
            if int(np.bitwise_count(values[i] ^ values[j])) <= 2}
    frame = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    for hot in (10**6, 20):
        assert {tuple(r) for r in simhash.links(frame, 2, hot=hot).collect()} == want


def test_simhash(docs, none):
    rows = simhash.groups(docs).collect()
    assert same_ids(rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == "0" * 16 and by[4].component_id == 2
    assert by[1].component_id == by[6].component_id == 1
    assert simhash.groups(none).isEmpty() and simhash.one_of_each(none).isEmpty()
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({r.component_id for r in rows if r.doc_id is not None} | {None})


# --- 5 nearest neighbours

def test_nearest_with_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(40)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8),
             (403, [1.0] * 3), (404, [1.0, None, *[0.0] * 6]), (405, [float("inf")] * 8), (0, rows[0][1]), (None, rows[1][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    good = {}
    for i, v in rows[:340]:
        good[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    norm = np.linalg.norm(x, axis=1)
    got = {}
    for r in ann.search(frame, F.col("vec_id") % 10 == 0, list_rows=50, chunk_rows=40).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = [i for i in ids if i % 10 == 0]
    assert sorted(got) == queries
    hits = 0
    for q in queries:
        score = x @ good[q] / norm / np.linalg.norm(good[q])
        score[ids == q] = -9
        best = ids[np.lexsort((ids, -np.round(score, 12)))[:5]]
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        hits += len({v for _, v, _ in got[q]} & set(best.tolist()))
    assert hits >= 0.95 * 5 * len(queries)
    assert ann.search(frame.limit(0), F.col("vec_id") % 10 == 0).isEmpty()
    assert ann.search(frame, F.col("vec_id") < 0).isEmpty()
    few = ann.search(frame.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [r.rank for r in few] == [1, 2]


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = ann.unit(rng.normal(size=(500, 32))), ann.unit(rng.normal(size=(50, 32)))
    centre = ann.unit(rng.normal(size=(1, 32)))[0]
    turn = ann.rotation(32)
    value, error = ann.estimate(*ann.encode(x, centre, turn), centre, q, turn)
    assert (np.abs(value - q @ x.T) <= error).mean() > 0.99


# --- 6 quality

def test_quality(spark, docs, none, labels):
    rows = quality.report(docs, labels).collect()
    assert same_ids(rows) and all(r.log_weight == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert quality.report(none, labels).isEmpty() and quality.resample(none, labels).isEmpty()
    assert quality.resample(docs, labels.limit(0)).count() == len(ROWS)
    assert quality.resample(docs, labels).columns == docs.columns
    whole = spark.createDataFrame([(i, f"text number {i} of many") for i in range(400)], "doc_id long, text string")
    kept = quality.report(whole, labels, k=100).where("kept")
    assert kept.count() == 100


def test_gumbel_draws_follow_the_weights():
    cut = quality.best_cut(np.array([1.0, 2.0, 5.0, 6.0]), np.array([0, 0, 1, 1]))
    assert cut == 3.5
    assert quality.best_cut(np.array([1.0, 2.0]), np.array([1, 1])) == float("-inf")


# --- 7 personal data

def test_base_spans_against_plain_patterns():
    from .test_whole_tables import plain_spans
    rng = random.Random(1)
    for letters in ("12.@+ -a()", "0123456789.", "a@.b@", "+1 2-().3", "4 1-"):
        for _ in range(2000):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == plain_spans(t)


def test_reliabilities_tell_labelers_apart():
    rng = random.Random(2)
    counts = Counter()
    for _ in range(4000):
        true = rng.random() < 0.4
        vote = "".join(("+" if (rng.random() < p) == true else "-") if rng.random() < 0.8 else "0" for p in (0.95, 0.9, 0.55))
        counts["x", vote] += 1
    truth = pii.reliabilities(counts)
    assert truth["x", "++-"] > 0.9 and truth["x", "--+"] < 0.1


def test_personal_data(docs, none):
    rows = pii.report(docs).collect()
    assert same_ids(rows)
    by = {r.doc_id: r for r in rows}
    assert (by[11].n_email, by[11].n_phone) == (1, 1) and by[2].spans == ""
    assert by[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.report(none).isEmpty() and pii.redact(none).isEmpty()
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[11] == "mail me at <EMAIL> or <PHONE>." and clean[2] is None and clean[5] == LONG


def test_redaction_sees_every_candidate():
    """A veiled address without digit, '=', ':' or '@', which the classifier accepts."""
    for text in ("write to jane.doe [at] example.com today", "or jane.doe (AT) example.org"):
        (span,) = pii.examine(text)
        model = pii.Model(np.array(span["traits"][:1]), np.array([9.0]))
        assert pii.accepted([], [((span["kind"], span["start"], span["end"]), span["traits"])], model)
        assert pii.redact_text(text, model) == text[: span["start"]] + "<EMAIL>" + text[span["end"] :]


def test_searches_are_linear():
    import time
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+(" * 100_000, "a@" * 20_000, "A1-" * 60_000):
        start = time.process_time()
        pii.examine(text)
        assert time.process_time() - start < 20


# --- 8 packing

def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(4)
    for _ in range(50):
        lengths = np.array([rng.randint(1, 50) for _ in range(rng.randint(1, 60))])
        bins, want = [], np.zeros(len(lengths), int)
        for i in np.argsort(-lengths, kind="stable"):
            k = next((k for k, free in enumerate(bins) if free >= lengths[i]), len(bins))
            if k == len(bins):
                bins.append(50)
            bins[k] -= lengths[i]
            want[i] = k
        assert packing.first_fit_decreasing(lengths, 50).tolist() == want.tolist()
        sequences = packing.pack_lengths(lengths, 64)
        sizes = [sum(b - a for _, a, b in s) for s in sequences]
        assert sum(sizes) == lengths.sum() and all(n == 64 or n & (n - 1) == 0 for n in sizes)


def test_ids_of_odd_texts():
    own = packing.Ids(tokenizer_file(), most=5)
    texts = ["", "  a  b", "<|endoftext|> x<|startoftext|>", "İstanbul ΣΑΣ ΟΔΟΣ äb 가", "it's DON'T we'll", "a\tb c\x85d　e",
             "x" * 5000, "0123 4,5.6 a.b, c.. d., e,", " ,", "١٢٣ ⅷ x²", "\x00\x1f", " ̈x", ". , a. a, ."]
    for _ in range(2):
        for text, ids in zip(texts, own.of(texts)):
            assert ids == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes(), text


def test_ids_of_letters_with_marks_behind(monkeypatch):
    """Letters and the marks behind them are looked up apart, so only marks and odd words go to the tokenizer one by one."""
    own, plain, alone = packing.Ids(tokenizer_file()), packing.Ids._encode, []
    monkeypatch.setattr(packing.Ids, "_encode", lambda self, w: alone.extend(w) or plain(self, w))
    stems = ["Haus", "\u00c9t\u00e9", "e\u0301te", "\u01c5a", "\u0130x", "\u03a3\u03a3", "\u4e2d\u6587", "it", "we", "\u00aa", "\ufb01n"]
    tails = [".", ",.", "###", "&&&", "'", "''", "!!'", "_", "$%&*", "<", "=", ">", "~^`|"]
    words = [s + t for s in stems for t in tails] + ["it's", "it's!!", "a1###", "#a#", "x\u0338=", "'s", "we'll.", "a'd'", "\u00e9\u0301!"]
    want = [own.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    got = own.of(words) + own.of([" ".join(words)])
    assert [np.frombuffer(x, own.type).tolist() for x in got] == want + [sum(want, [])]
    assert len(alone) < len(words) / 2


def test_packing(docs, none):
    from .test_whole_tables import encode, packed_right
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_file())
    texts = {r[0]: r[1] or "" for r in ROWS}
    rows = packing.report(docs, tokenizer_file()).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert packed_right(rows, lambda k: encode(tokenizer, texts[k])) == 0
    small = packing.report(docs, tokenizer_file(), group_bytes=1000).collect()
    assert packed_right(small, lambda k: encode(tokenizer, texts[k])) == 0
    assert packing.report(none, tokenizer_file()).isEmpty()


# --- 9 fingerprints

def test_fingerprints(docs, none):
    for per_part in (2000, 2):
        rows = minhash.fingerprints(docs, rows_per_part=per_part).collect()
        assert same_ids(rows)
        by = {r.doc_id: r for r in rows}
        assert by[1].fingerprint == by[6].fingerprint and by[2].fingerprint == by[3].fingerprint == by[4].fingerprint
        order = sorted({r[0] for r in ROWS if r[0] is not None}, reverse=True)
        texts = {r[0]: r[1] or "" for r in ROWS}
        for a, b in zip(order, order[1:]):
            if a != 6:  # its repeated row follows it
                new = minhash.edited(texts[a], texts[b])
                assert (by[a].n_chars, by[a].edited_sha256) == (len(texts[a]), hashlib.sha256(new.encode()).hexdigest())
        assert by[None].edited_sha256 == hashlib.sha256(minhash.edited(texts[None], texts[11]).encode()).hexdigest()
    assert minhash.fingerprints(none).isEmpty()


def test_near_duplicates(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(3000)}" for _ in range(200)] for _ in range(20)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        texts.append("  ".join(b))
        near = list(b)
        near[rng.randrange(200)] = "changed"
        texts.append(" ".join(near))
    texts += [None, "", "short one"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(map(tuple, minhash.groups(frame).collect()))
    assert got == {**{i: i // 3 * 3 for i in range(60)}, 60: 60, 61: 60, 62: 62}


def test_near_copies_of_the_pipeline(spark):
    """Copies of Jaccard 0.8 and more that two bits of a SimHash do not link, a band with many members, and a chain."""
    from corpus_pipeline import drop_near_copies

    rng = random.Random(11)
    texts = []
    for _ in range(12):
        b = [f"w{rng.randrange(3000)}" for _ in range(200)]
        texts += [" ".join(b), " ".join([*b[:60], "changed", *b[61:130], "other", *b[131:]])]
    common = [f"c{i}" for i in range(60)]
    texts += [" ".join([*common, *[f"t{i}x{j}" for j in range(12 + i % 30)]]) for i in range(60)]
    chain = [f"k{i}" for i in range(100)]
    texts += [" ".join([*chain[4 * i :], *[f"n{j}" for j in range(4 * i)]]) for i in range(14)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in drop_near_copies(spark, frame, "").collect()} == set(root)
    assert simhash.one_of_each(frame).count() > len(set(root))
    for options in ({"tries": 0, "sketch_block": 9}, {"tries": 0, "block": 7}):
        assert dict(map(tuple, minhash.groups(frame, **options).collect())) == dict(enumerate(root))


def test_simhash_links_near_copies_first(spark, monkeypatch):
    from corpus_pipeline import drop_near_copies

    asked, plain = [], simhash.linked
    monkeypatch.setattr(simhash, "linked", lambda rows, name, *more: asked.append(name) or plain(rows, name, *more))
    long = [f"w{i}" for i in range(4000)]
    frame = spark.createDataFrame([(0, " ".join(long)), (1, " ".join([*long[:-1], "changed"])), (2, "another text"), (3, None)], "doc_id long, text string")
    rows = minhash.shingle_rows(frame)
    nodes = {r.doc_id: r.node for r in rows.collect()}
    assert [set(r) for r in minhash.simhash_pairs(rows).collect()] == [{nodes[0], nodes[1]}]
    assert {r.doc_id for r in drop_near_copies(spark, frame, "").collect()} == {0, 2, 3} and asked == ["node", "node"]


def test_simhash_groups_are_candidates_without_a_shared_band(spark):
    """Bands that nothing shares, one fingerprint for all: every alike pair is found, also those whose smallest class is like neither."""
    rng = random.Random(21)
    texts = []
    for _ in range(8):
        b = [f"w{rng.randrange(3000)}" for _ in range(120)]
        texts += [" ".join(b), " ".join([*b[:60], "changed", *b[61:]]), " ".join([*b[:30], "other", *b[31:]])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = minhash.shingle_rows(frame).withColumns({"fingerprint": F.lit(7).cast("long"), "bands": F.array(F.xxhash64("node"))})
    rows = tables.materialise(rows)
    of = {r.doc_id: r.node for r in rows.collect()}
    root = {r.node: r.root for r in minhash.roots_of(frame, rows).collect()}
    assert len(root) == 24 and len(set(root.values())) == 8
    assert all(root[of[i]] == root[of[i // 3 * 3]] for i in range(24))


def test_pairs_are_verified_on_whole_sets(spark):
    """Hubs with many partners, dealt in parts, against plain sets."""
    rng = np.random.default_rng(12)
    sets = {i: np.unique(np.concatenate([np.arange(40 + i % 20), rng.integers(0, 2**63, i % 25)]).astype(np.uint64) * np.uint64(2**58 + 9)).view(np.int64)
            for i in range(200)}
    frame = spark.createDataFrame([(i, np.sort(x.view(np.uint64)).view(np.int64).tolist()) for i, x in sets.items()], "node long, shingles array<long>")
    pairs = [(i, int(rng.integers(0, 3))) for i in range(3, 200)] + [(int(a), int(b)) for a, b in rng.integers(3, 200, (60, 2)) if a != b]
    pairs = list(dict.fromkeys(pairs))
    plain = {i: set(x.tolist()) for i, x in sets.items()}
    want = {(a, b) for a, b in pairs if len(plain[a] & plain[b]) >= 0.8 * len(plain[a] | plain[b])}
    for rows in (1000, 7):
        got = minhash.verified(tables.settle(spark.createDataFrame(pairs, "a long, b long")), frame, 0.8, rows)
        assert Counter(map(tuple, got.collect())) == Counter(want)
    assert 0 < len(want) < len(pairs)


def test_one_row_of_each_group(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (1, b), (2, b), (3, a), (None, a), (None, "no id"), (None, "no id"), (4, None), (5, "")]
    kept = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(1, a), (1, b), (None, "no id"), (4, None)])
    assert minhash.one_of_each(kept.limit(0)).isEmpty() and minhash.groups(kept.limit(0)).isEmpty()


# --- 10 archives

PAGES = [(1, "http://a/\r\nx", "<p>small</p>"), (2, None, None), (3, "http://c/ü", "y" * 2000), (7, "http://d", "y" * 2000),
         (5, "http://e", "z" * 90_000 + "WARC/1.1\r\n\r\n0\r\n\r\n"), (6, "http://f", "z" * 90_000 + "WARC/1.1\r\n\r\n0\r\n\r\n"),
         (None, "http://g", "y" * 2000), (8, "http://h", "é" * 600), (7, "http://d", "y" * 2000), (9, "http://i", "long " * 20_000),
         (9, "http://i", "long " * 20_000)]


def test_archives(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, path string").repartition(3)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.problem)
                  for r in warc.round_trip(pages, segment_bytes=16_384).collect())
    want = Counter()
    for k, _, html in PAGES:
        body = (html or "").encode()
        last = {"y" * 2000: 7, PAGES[4][2]: 6, "long " * 20_000: 9}.get(html)
        revisit = last is not None and k != last
        want[k, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last if revisit else None, None] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).isEmpty()


def test_chunked_framing():
    for body in (b"", b"a", b"x" * 20_000, b"0\r\n\r\n"):
        assert warc.unchunked(warc.chunked(body, 7)) == body
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\n", b"5\r\nab\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_incomplete_records_are_told(spark, tmp_path):
    records = list(warc.records_of(4, "http://x", b"q" * 5000, None, 1000))
    whole = list(warc.records_of(3, "http://y", b"fine", None, 1000))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in [*records[::-1][:-2], records[0], *whole]))
    (tmp_path / "b.warc").write_bytes(b"".join(warc.records_of(5, "http://z", b"w" * 5000, None, 900)))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",), (f"file://{tmp_path}/b.warc",)], "path string")
    got = {r.record_id.split(":")[2]: (r.payload_bytes, r.problem) for r in warc.read_archives(manifest).collect()}
    assert got == {"4": (None, "segments are missing"), "3": (4, None), "5": (5000, None)}


def test_components_of_few_links_are_written_in_few_pieces(spark, tmp_path):
    """However many partitions a shuffle has, each round writes as many pieces as the links need."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    folder = spark.sparkContext.getCheckpointDir()
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 20 != 19], "a long, b long")
        spark.sparkContext.setCheckpointDir(str(tmp_path))
        roots = {r["node"]: r["root"] for r in tables.components(links, "a", "b").collect()}
    finally:
        spark.sparkContext.setCheckpointDir(folder.removeprefix("file:"))
        for k, v in held.items():
            spark.conf.set(k, v)
    assert roots == {i: i // 20 * 20 for i in range(60)}
    assert len(list(tmp_path.rglob("part-*"))) <= 40 + 20


def test_components_are_the_same_in_one_task_and_dealt(spark):
    rng = random.Random(5)
    links = spark.createDataFrame([(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(7, 7), (None, 3)], "a long, b long")
    plain = sorted(map(tuple, tables.components(links, "a", "b").collect()))
    assert plain and plain == sorted(map(tuple, tables.components(links, "a", "b", most=10).collect()))


def test_small_steps_of_near_copies_are_few_tasks(spark):
    """However many partitions a shuffle has: the tasks of tables of a few rows are not that many times the steps."""
    rng = random.Random(3)
    body = [[rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(90)] for _ in range(12)]
    texts = [" ".join(w if rng.random() > 0.01 * (i % 4) else "x" for w in body[i % 12]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    expected = sorted(map(tuple, minhash.groups(docs).collect()))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    sc = spark.sparkContext
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("near copies", "")
    try:
        got = sorted(map(tuple, minhash.groups(docs).collect()))
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("near copies")]
        stages = {s: sc.statusTracker().getStageInfo(s) for j in jobs for s in j.stageIds}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    ran = sum(s.numCompletedTasks for s in stages.values() if s)
    assert got == expected
    assert ran <= 60 * 40, ran
