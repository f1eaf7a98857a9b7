"""The operators applied to the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import ann, importance, langid, lexical, minhash, mixing, packing, pii, quality, simhash, suffix_dedup, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


OP1_SQL = f"""
WITH docs AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{mixing.SEED}|' || doc_id), 1, 15) AS BIGINT) AS draw
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM docs GROUP BY source),
steps AS (
  SELECT *, source_size * 2.0::DOUBLE / w AS stop,
         coalesce(sum(source_size * 2) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
         sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         (sum(source_size) OVER ()) * 1.5::DOUBLE AS wanted
  FROM sources),
level AS (
  SELECT (wanted - clamped) AS rest, open_w FROM steps
  WHERE (wanted - clamped) / open_w <= stop ORDER BY stop, open_w DESC LIMIT 1),
targets AS (
  SELECT s.source, s.source_size,
         CASE WHEN rest * w / open_w_level > s.source_size * 2 THEN CAST(s.source_size * 2 AS DOUBLE)
              ELSE rest * w / open_w_level END AS target
  FROM sources s, (SELECT CAST(rest AS DOUBLE) AS rest, CAST(open_w AS DOUBLE) AS open_w_level FROM level)),
parts AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM targets),
runs AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw) AS upto
  FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM runs"""


@query("op1_mix_sources", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it."""
    return mixing.report(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM p LEFT JOIN g USING (digest)"""


@query("op10_warc_round_trip", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives with revisit records, read back and reassembled."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op9_minhash_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole documents and of their edited texts, and how near neighbours are."""
    return minhash.fingerprints(table(spark, sf_dir, "documents"))


@query("op4_simhash_groups")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the smallest id that it can be linked to."""
    return simhash.groups(table(spark, sf_dir, "documents"))


@query("op8_pack_sequences")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in sequences of at most 4096."""
    return packing.report(table(spark, sf_dir, "documents"), corpus_pipeline.tokenizer_file())


@query("op5_nearest_by_codes")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_importance_resampling")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log importance weights of all documents, and which of them are sampled."""
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    return pii.report(table(spark, sf_dir, "documents"))


@query("op3_suffix_repeats")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes covered by 400-byte strings that occur again."""
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# CRC-32 is linear: a byte's part in the checksum depends on the byte and on how many bytes follow, and parts add by xor
OP11_SQL = f"""
WITH RECURSIVE step AS (
  SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS v
    FROM range(256) r(b))),
texts AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS (
  SELECT kind, id, unnest(t) AS g FROM texts
  UNION ALL SELECT kind, id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM texts
  UNION ALL SELECT kind, id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM texts),
counted AS (SELECT kind, id, g, count(*) AS n FROM runs GROUP BY ALL),
grams AS (SELECT g, hex(g) AS h, CAST(strlen(g) AS BIGINT) AS size FROM (SELECT DISTINCT g FROM counted)),
parts AS (
  SELECT CAST(0 AS BIGINT) AS d, b, CAST(t[b + 1] AS BIGINT) AS c FROM step, range(256) r(b) UNION ALL SELECT 0, 256, 4294967295
  UNION ALL SELECT d + 1, b, xor(CAST(t[c % 256 + 1] AS BIGINT), c // 256) FROM parts, step WHERE d < (SELECT max(size) FROM grams)),
letters AS (SELECT g, size, unnest(range(size)) AS i, h FROM grams),
sums AS (
  SELECT g, bit_xor(c) AS c FROM letters JOIN parts ON d = size - 1 - i AND b = CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) GROUP BY g),
buckets AS (
  SELECT g, xor(xor(s.c, p.c), 4294967295) % 10000 AS bucket FROM sums s JOIN grams USING (g) JOIN parts p ON p.d = size AND p.b = 256),
each AS (SELECT kind, id, bucket, CAST(sum(n) AS BIGINT) AS n FROM counted JOIN buckets USING (g) GROUP BY ALL),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM each GROUP BY 1),
sizes AS (SELECT sum(s) AS big_s, sum(t) AS big_t FROM totals),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000)))) AS BIGINT) AS gain FROM totals, sizes),
weighed AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM each JOIN gain USING (bucket) WHERE kind = 0 GROUP BY 1),
scored AS (
  SELECT x.id AS doc_id, len(x.t) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || x.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM texts x LEFT JOIN weighed w ON w.id = x.id WHERE x.kind = 0),
placed AS (
  SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS place,
         count(*) FILTER (words >= 20) OVER () AS large FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * large // 100 THEN place END AS rank FROM placed"""


@query("op11_target_resampling", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed by how much they look like the benchmark's texts, and those drawn."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS length FROM d WHERE len(t) > 0),
held AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM held GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
asked AS (SELECT item_id, term, count(*) AS r FROM (
  SELECT item_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
share AS (
  SELECT doc_id, term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT)
         * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))) AS part
  FROM tf JOIN df USING (term), s WHERE term IN (SELECT term FROM asked)),
scored AS (SELECT item_id, doc_id, CAST(sum(r * part) AS BIGINT) AS score FROM asked JOIN share USING (term) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20"""


@query("op12_lexical_search", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents of highest score for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_language_by_words")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by its words' labels."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents filtered, deduplicated, redacted, mixed and packed."""
    return corpus_pipeline.run(spark, sf_dir)
