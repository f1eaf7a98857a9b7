"""The queries over the smallest tables, against SQL, brute force, a round trip or held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from check import connect, rows_of
from cohortwave.llm import pii, toxicity
from cohortwave.llm.queries import ORACLES, QUERIES
from corpus_pipeline import STAGES, tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.fixture(scope="module")
def result(spark):
    done = {}

    def run(name):
        if name not in done:
            df = QUERIES[name](spark, SF)
            done[name] = df.columns, df.collect()
        return done[name][1]

    run.done = done
    return run


def words(text):
    return text.encode().split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(result, duck, name):
    rows = result(name)
    got = rows_of(result.done[name][0], rows)
    cur = duck.execute(ORACLES[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_mix_takes_near_its_targets(result, duck):
    rows = {r.doc_id: r for r in result("op1_mix_sources")}
    sources = defaultdict(list)
    for doc_id, source in duck.execute("SELECT doc_id, source FROM documents").fetchall():
        sources[source].append(rows[doc_id])
    total = sum(r.size for r in rows.values())
    assert sum(v[0].target for v in sources.values()) == pytest.approx(1.5 * total)
    for own in sources.values():
        assert all(r.taken <= 2 * r.size for r in own) and own[0].target <= 2 * own[0].source_size + 1e-6
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1e-6


def test_toxicity_on_held_out_rows(spark):
    larger = "/root/testdata/sf0.01"  # the smallest tables label five toxic rows only
    rows = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, larger).collect()}
    labels = dict(connect(larger).execute("SELECT doc_id, toxic FROM labels").fetchall())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    for held in (True, False):
        assert np.mean([rows[k].predicted == y for k, y in labels.items() if rows[k].held_out == held]) > 0.95


def test_toxicity_generalises():
    import duckdb
    import pyarrow as pa
    both = duckdb.sql("SELECT d.doc_id, coalesce(text, ''), toxic FROM '/root/testdata/sf0.1/documents.parquet' d "
                      "JOIN '/root/testdata/sf0.1/labels.parquet' l USING (doc_id) ORDER BY 1").fetchall()
    held = [r for r in both if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    rest = [r for r in both if zlib.crc32(str(r[0]).encode()) % 5]
    model = toxicity.fit([r[1].encode() for r in rest], np.array([r[2] for r in rest]))
    guess = model.score(pa.array([r[1] for r in held])) >= 0.5
    truth = np.array([r[2] for r in held]) == 1
    assert (guess == truth).mean() > 0.97 and (guess & ~truth).sum() <= 0.01 * len(truth)


def test_repeats_against_brute_force(result, texts):
    raw = {k: t.encode() for k, t in texts.items()}
    seen = Counter(t[i : i + 400] for t in raw.values() for i in range(len(t) - 399))
    for r in result("op3_suffix_repeats"):
        t = raw[r.doc_id]
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        rest = hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), spans, rest)


def simhash(text):
    from xxhash import xxh64_intdigest
    w = text.encode().lower().split()
    h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, most=2):
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= most):
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(result, texts):
    prints = {k: simhash(t) for k, t in texts.items()}
    roots = linked(prints)
    rows = result("op4_simhash_groups")
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {k: (f"{prints[k]:016x}", roots[k]) for k in texts}
    assert len(rows) == len(texts)


def test_nearest_against_brute_force(result, duck):
    data = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY 1").fetchall()
    ids = np.array([r[0] for r in data])
    x = np.array([r[1] for r in data], float)
    norm = np.linalg.norm(x, axis=1)
    hits = total = 0
    rows = defaultdict(list)
    for r in result("op5_nearest_by_codes"):
        rows[r.query_id].append(r)
    for q in ids[ids % 50 == 0]:
        score = x @ x[ids == q][0] / norm / norm[ids == q]
        score[ids == q] = -9
        best = ids[np.lexsort((ids, -score))[:5]]
        own = sorted(rows[q], key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and all(a.score >= b.score for a, b in zip(own, own[1:]))
        assert all(r.score == pytest.approx(score[ids == r.vec_id][0], abs=1e-12) for r in own)
        hits, total = hits + len({r.vec_id for r in own} & set(best.tolist())), total + 5
    assert hits >= 0.9 * total


def test_quality_keeps_good_and_rejects_poor(result, duck):
    kept = {r.doc_id: r.kept for r in result("op6_importance_resampling")}
    labels = duck.execute("SELECT doc_id, quality FROM labels").fetchall()
    assert np.mean([kept[k] for k, q in labels if q == 1]) > 0.98
    assert np.mean([kept[k] for k, q in labels if q == 0]) < 0.05


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    n = lambda m: len(re.sub("[^0-9]", "", m[0]))
    return ([("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
            + [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
            + [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= n(m) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
            + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= n(m) <= 15])


def test_personal_data_base(result, texts):
    for r in result("op7_personal_data"):
        base = plain_spans(texts[r.doc_id])
        text = [f"{k}:{a}:{b}" for k, a, b in base]
        counts = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in pii.BASE_KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(text).encode()).hexdigest()
        assert set(text) <= set(r.spans.split(","))


def packed_right(rows, ids_of):
    """Each document's ids once, no gaps, and how much of the sequences is padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, own in by_doc.items():
        ids = ids_of(k)
        copies = Counter(r.start for r in own)[0]
        covered = np.zeros(len(ids), int)
        for r in own:
            assert r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            covered[r.start : r.start + r.length] += 1
        assert (covered == copies).all()
    used = padded = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        used, padded = used + at, padded + (0 if at & (at - 1) == 0 else 4096 - at)
    return padded / max(1, used)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_file())


def encode(tokenizer, text):
    return np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")


def test_packing_round_trip(result, texts, tokenizer):
    rows = result("op8_pack_sequences")
    assert {r.doc_id for r in rows} == set(texts)
    assert packed_right(rows, lambda k: encode(tokenizer, texts[k])) < 0.01


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_fingerprints_against_shingle_sets(result, texts):
    order = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in result("op9_minhash_fingerprints")}
    by_text = defaultdict(set)
    for i, k in enumerate(order):
        own, after, r = texts[k], texts[order[(i + 1) % len(order)]], rows[k]
        half = len(own) // 2
        new = own[: len(own) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(new.encode()).hexdigest())
        for text, found in ((new, r.near_edited), (after, r.near_next)):
            a, b = shingles(own), shingles(text)
            assert abs(found - (len(a & b) / len(a | b) if a | b else 1)) < 0.15
        by_text[own].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def alike(sets, least=0.8):
    """The smallest id that each can reach by likenesses of ``least`` or more; two texts without words are alike."""
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def test_pipeline_stages_against_brute_force(spark, duck, tokenizer):
    """Each stage on what the stage before it kept."""
    from cohortwave.operators.scale import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in STAGES:
        kept.append(materialise(stage(spark, kept[-1], SF)))
        assert name == "packing" or kept[-1].columns == columns
    rows = [{r.doc_id: r for r in df.collect()} for df in kept[:4]]
    labels = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    assert all(k in rows[1] for k, q in labels.items() if q == 1 and k in rows[0])
    assert not any(k in rows[1] for k, q in labels.items() if q == 0)
    roots = alike({k: shingles(r.text or "") for k, r in rows[1].items()})
    assert set(rows[2]) == set(roots.values()) and kept[2].count() == len(rows[2])
    assert set(rows[3]) == set(rows[2])
    for k, r in rows[3].items():
        before = plain_spans(rows[2][k].text or "")
        assert (r.text == rows[2][k].text or before or "<SECRET>" in r.text or "<" in r.text) and r.n_chars == len(r.text)
        for kind, a, b in before:
            assert rows[2][k].text[a:b] not in r.text or b - a < 8
    mixed = kept[4].collect()
    times = Counter(r.doc_id for r in mixed)
    assert max(times.values()) <= 2 and set(times) <= set(rows[3])
    total = sum(len(words(r.text)) for r in rows[3].values())
    assert abs(sum(len(words(r.text)) for r in mixed) - 1.5 * total) < 0.1 * total
    packed = kept[5].collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == times
    assert packed_right(packed, lambda k: encode(tokenizer, rows[3][k].text)) < 0.01
    assert len(packed) == QUERIES["pipeline"](spark, SF).count()
