"""Scalars, quality rules, joins, segments and diagnostics on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, scalars as x
from ..operators import quality as q
from ..operators import segments as s
from ..operators import subjects as sub
from ..operators.scale import attach
from .proxies import SPEC, rounded, sql
from .recordings import build_segments
from .registry import query


# ---- quality rules -------------------------------------------------------------------------

@query("p1_feature_columns", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def _(t):
    df = t.lineitem
    return df.select(names.feature_columns(df, "l_", "key", "order") + names.feature_columns(df, "l_", contains="number")
                     + names.feature_columns(df, suffix="quantity") + names.feature_columns(df, contains="price"))


@query("p2_numeric_columns", "SELECT p_size, p_retailprice FROM part")
def _(t):
    return t.part.select(names.numeric_columns(t.part, ["p_partkey"]))


@query("p3_coerce_numeric", """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'abc'
    WHEN event_type = 'view' THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS reading
    FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id, NULL FROM events WHERE event_type = 'view'""")
def _(t):
    kind = F.col("event_type")
    text = F.when(kind == "error", "abc").when(kind == "view", "NaN").otherwise(F.col("value").cast("string"))
    return q.coerce_numeric(t.events.select("event_id", text.alias("reading")), ["reading"])


@query("p4_adaptive_threshold", sql("rec", """SELECT subject, event_id,
    CASE WHEN max(overall) OVER (PARTITION BY subject) <= 1 THEN 0.7::DOUBLE ELSE 70::DOUBLE END AS cut_overall,
    CASE WHEN max(value / 500) OVER (PARTITION BY subject) <= 1 THEN 0.7::DOUBLE ELSE 70::DOUBLE END AS cut_share FROM rec"""))
def _(t):
    rec = t.rec.select("subject", "event_id", "overall", (F.col("value") / 500).alias("share"))
    both = q.adaptive_threshold(q.adaptive_threshold(rec, "overall", 0.7, "subject", "cut_overall"),
                                "share", 0.7, "subject", "cut_share")
    return both.select("subject", "event_id", F.round("cut_overall", 6).alias("cut_overall"), "cut_share")


@query("p5_all_at_least", sql("rec", """SELECT event_id, coalesce(ch_a >= 2, false) AND coalesce(ch_b >= 2, false)
    AS good FROM rec"""))
def _(t):
    return t.rec.select("event_id", q.all_at_least(["ch_a", "ch_b"], 2).alias("good"))


@query("p6_quality_mask", sql("checked", "SELECT event_id, subject, ts, value FROM checked WHERE ok"))
def _(t):
    return q.quality_mask(t.marked, SPEC).where("ok").select("event_id", "subject", "ts", "value")


@query("p7_drop_missing", sql("gaps", "SELECT subject, task, round(price, 7) AS price, round(tax, 7) AS tax FROM gaps WHERE price IS NOT NULL AND tax IS NOT NULL"))
def _(t):
    return rounded(q.drop_missing(t.gaps.select("subject", "task", "price", "tax"), ["price", "tax"]), ["price", "tax"])


@query("p8_fill_missing", sql("gaps", "SELECT subject, task, round(coalesce(price, 0), 7) AS price, round(coalesce(tax, 0), 7) AS tax FROM gaps"))
def _(t):
    return rounded(q.fill_missing(t.gaps.select("subject", "task", "price", "tax"), 0.0, ["price", "tax"]), ["price", "tax"])


@query("p9_drop_sparse", sql("gaps", """WITH has AS (SELECT subject, count(qty) > 0 AS hq, count(price) > 0 AS hp,
    count(tax) > 0 AS ht FROM gaps GROUP BY 1),
    whole AS (SELECT g.*, hq::INT + hp::INT + ht::INT AS width FROM gaps g JOIN has USING (subject)
      WHERE NOT (hq AND qty IS NULL) AND NOT (hp AND price IS NULL) AND NOT (ht AND tax IS NULL)),
    keep AS (SELECT subject FROM whole GROUP BY 1 HAVING count(*) > 1 AND any_value(width) > 1)
    SELECT * FROM (SELECT subject, task, unnest(['qty', 'price', 'tax']) AS metric, unnest([round(qty, 7), round(price, 7), round(tax, 7)]) AS value
      FROM whole WHERE subject IN (SELECT subject FROM keep)) WHERE value IS NOT NULL"""))
def _(t):
    return rounded(q.drop_sparse(t.gaps.select("subject", "task", "qty", "price", "tax"), "subject", ["qty", "price", "tax"]), ["value"])


@query("p10_exclude_holdout", sql("obs", "SELECT subject, task, round(qty, 7) AS qty FROM obs WHERE subject NOT IN (16, 45)"))
def _(t):
    return rounded(q.exclude_holdout(t.obs.select("subject", "task", "qty"), "subject", [16, 45]), ["qty"])


@query("p11_select_subset", sql("obs", "SELECT subject, task, round(qty, 7) AS qty FROM obs WHERE task IN ('1-URGENT', '5-LOW')"))
def _(t):
    return rounded(q.select_subset(t.obs.select("subject", "task", "qty"), "task", [" 1-urgent", "5-low "]), ["qty"])


@query("p12_split_by_threshold", sql("obs", """SELECT side, count(*) AS n, round(sum(qty), 4) AS total FROM (
    SELECT *, CASE WHEN hours <= 6 THEN 'at_most_6' ELSE 'above_6' END AS side FROM obs
    UNION ALL SELECT *, CASE WHEN hours < 7 THEN 'below_7' ELSE 'from_7' END FROM obs) GROUP BY side"""))
def _(t):
    low6, high6 = q.split_by_threshold(t.obs, "hours", 6)
    low7, high7 = q.split_by_threshold(t.obs, "hours", 7, closed="right")
    sides = [d.withColumn("side", F.lit(n)) for d, n in
             ((low6, "at_most_6"), (high6, "above_6"), (low7, "below_7"), (high7, "from_7"))]
    return sub.concat_rows(sides).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("qty"), 4).alias("total"))


@query("p13_rename_pattern", "SELECT c_custkey AS cust, c_name AS c_name, c_acctbal AS acctbal FROM customer")
def _(t):
    return names.rename_pattern(t.customer.select("c_custkey", "c_acctbal"), "c_", "key").join(
        t.customer.select(F.col("c_custkey").alias("cust"), "c_name"), "cust")


@query("p14_require_columns", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def _(t):
    return names.require_columns(t.orders, ["o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"], ["o_orderstatus"])


@query("p15_reference_all_missing", sql("windows", """SELECT subject, marker_id, count(*) AS segment_rows FROM windows
    GROUP BY 1, 2 HAVING count(f1) = 0"""))
def _(t):
    return q.reference_all_missing(t.windows, ["subject", "marker_id"], "f1")


@query("p16_require_groups", sql("obs", "SELECT subject, count(*) AS tasks FROM obs GROUP BY 1"))
def _(t):
    return q.require_groups(t.obs, "subject", 3, "task", 2).groupBy("subject").agg(F.count(F.lit(1)).alias("tasks"))


# ---- joins ---------------------------------------------------------------------------------

@query("j1_allowed_only", sql("markers allowed", """SELECT subject, marker_id, task FROM markers
    WHERE lower(trim(task)) IN (SELECT task FROM allowed)"""))
def _(t):
    return s.allowed_only(t.markers, t.allowed)


@query("j2_not_allowed", sql("markers allowed", """SELECT subject, marker_id, task FROM markers
    WHERE lower(trim(task)) NOT IN (SELECT task FROM allowed)"""))
def _(t):
    return s.not_allowed(t.markers, t.allowed)


@query("j3_enrich_inner", """SELECT o_orderkey, o_totalprice, p_type FROM orders JOIN (SELECT DISTINCT p_type,
      CASE p_size WHEN 1 THEN 'urgent' WHEN 2 THEN ' LOW' ELSE p_name END AS task FROM part) AS lookup
    ON lower(trim(split_part(o_orderpriority, '-', 2))) = lower(trim(task))""")
def _(t):
    lookup = t.part.select(F.when(F.col("p_size") == 1, "urgent").when(F.col("p_size") == 2, " LOW")
                           .otherwise(F.col("p_name")).alias("task"), "p_type").distinct()
    orders = t.orders.select("o_orderkey", "o_totalprice", F.get(F.split("o_orderpriority", "-"), F.lit(1)).alias("task"))
    return sub.enrich_inner(orders, lookup).select("o_orderkey", "o_totalprice", "p_type")


@query("j4_enrich_subject", sql("rec meta", "SELECT event_id, subject, value, hours, gender FROM rec JOIN meta USING (subject)"))
def _(t):
    return sub.enrich_subject(t.rec.select("event_id", "subject", "value"), t.meta)


@query("j5_join_aggregates", sql("windows", """WITH w AS (SELECT * FROM windows WHERE f1 IS NOT NULL),
    m AS (SELECT subject, task, median(f1) AS f1, median(f2) AS f2 FROM w GROUP BY 1, 2),
    n AS (SELECT subject, task, count(window_index) AS num_windows FROM w GROUP BY 1, 2)
    SELECT m.subject, m.task, round(f1, 6) AS f1, round(f2, 6) AS f2, num_windows FROM m LEFT JOIN n USING (subject, task)"""))
def _(t):
    w = q.drop_missing(t.windows, ["f1"])
    medians = s.segment_median(w, ["subject", "task"], ["f1", "f2"])
    counts = w.groupBy("subject", "task").agg(F.count("window_index").alias("num_windows"))
    return sub.join_aggregates(medians, counts, ["subject", "task"]).select(
        "subject", "task", F.round("f1", 6).alias("f1"), F.round("f2", 6).alias("f2"), "num_windows")


@query("j6_align", sql("obs", """SELECT subject, hours, num_stimuli, round(urgent_qty, 7) AS urgent_qty FROM
    (SELECT subject, min(hours) AS hours, count(DISTINCT task) AS num_stimuli FROM obs GROUP BY 1)
    JOIN (SELECT subject, qty AS urgent_qty FROM obs WHERE task = '1-URGENT') USING (subject)"""))
def _(t):
    view = t.obs.where("task = '1-URGENT'").select("subject", F.col("qty").alias("urgent_qty"))
    return rounded(sub.align(sub.subject_targets(t.obs), view), ["urgent_qty"])


@query("j7_combine_views", sql("obs", """SELECT coalesce(a.subject, b.subject) AS subject, round(a.qty, 7) AS first__qty,
    round(b.qty, 7) AS last__qty, round(b.tax, 7) AS last__tax FROM (SELECT * FROM obs WHERE task = '1-URGENT') a
    FULL JOIN (SELECT * FROM obs WHERE task = '5-LOW') b ON a.subject = b.subject"""))
def _(t):
    views = {"first": t.obs.where("task = '1-URGENT'").select("subject", "qty"),
             "last": t.obs.where("task = '5-LOW'").select("subject", "qty", "tax")}
    return rounded(sub.combine_views(views), ["first__qty", "last__qty", "last__tax"])


@query("j8_pair_markers", sql("pairs", "SELECT * FROM pairs"))
def _(t):
    return s.pair_markers(t.clean)


@query("j9_segment_join", sql("clean pairs", """SELECT c.event_id, c.subject, p.marker_id, c.ts, c.value FROM clean c
    JOIN pairs p ON c.subject = p.subject AND c.ts BETWEEN p.t_start AND p.t_end WHERE p.t_end > p.t_start"""))
def _(t):
    return s.segment_join(t.clean, s.valid_segments(t.pairs)).select("event_id", "subject", "marker_id", "ts", "value")


@query("j12_last_wins_lookup", sql("markers", "SELECT subject, marker_id, task FROM markers"))
def _(t):
    return s.last_wins_lookup(t.marker_lines, ["subject", "marker_id"], "task", ["ts", "event_id"])


# ---- segments and windows ------------------------------------------------------------------

@query("w1_window_index", sql("windows", "SELECT subject, marker_id, event_id, window_index FROM windows"))
def _(t):
    cut = s.segment_join(t.clean, s.valid_segments(t.pairs))
    return s.window_index(cut, ["subject", "marker_id"], ["ts", "event_id"]).select(
        "subject", "marker_id", "event_id", "window_index")


@query("w4_downsample_even", sql("windows", """WITH r AS (SELECT *, row_number() OVER w - 1 AS r0, count(*) OVER
      (PARTITION BY subject, marker_id) AS c FROM windows WINDOW w AS (PARTITION BY subject, marker_id ORDER BY ts, event_id)),
    kept AS (SELECT * FROM r WHERE c <= 8 OR r0 IN (SELECT (i * (c - 1)) // 7 FROM range(8) g(i))),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY subject, marker_id ORDER BY ts, event_id) AS pos FROM kept)
    SELECT subject, marker_id, event_id, window_index, CASE WHEN c <= 8 THEN window_index ELSE pos END
      AS window_index_downsampled FROM numbered"""))
def _(t):
    return s.downsample_even(t.windows, ["subject", "marker_id"], ["ts", "event_id"], 8).select(
        "subject", "marker_id", "event_id", "window_index", "window_index_downsampled")


@query("w5_first_event", """SELECT user_id, event_type, arg_min(event_id, ts) AS first_value FROM events GROUP BY 1, 2""")
def _(t):
    return s.first_event(t.events, ["user_id", "event_type"], ["ts", "event_id"], "event_id")


@query("a1_segment_mean", sql("windows", """SELECT subject, marker_id, round(avg(f1), 6) AS f1, round(avg(f2), 6) AS f2
    FROM windows GROUP BY 1, 2"""))
def _(t):
    means = s.segment_mean(t.windows, ["subject", "marker_id"], ["f1", "f2"])
    return means.withColumns({c: F.round(c, 6) for c in ("f1", "f2")})


@query("a2_segment_median", sql("windows", """SELECT subject, task, round(median(f1), 6) AS f1, round(median(f2), 6) AS f2
    FROM windows WHERE f1 IS NOT NULL GROUP BY 1, 2"""))
def _(t):
    medians = s.segment_median(q.drop_missing(t.windows, ["f1"]), ["subject", "task"], ["f1", "f2"])
    return medians.withColumns({c: F.round(c, 6) for c in ("f1", "f2")})


@query("a3_segment_meta", sql("windows", """SELECT subject, task, arg_min(event_type, (ts, event_id)) AS event_type,
    arg_min(f1, (ts, event_id)) FILTER (WHERE f1 IS NOT NULL) AS f1, count(window_index) AS num_windows
    FROM windows GROUP BY 1, 2"""))
def _(t):
    return s.segment_meta(t.windows, ["subject", "task"], ["event_type", "f1"], ["ts", "event_id"])


# ---- diagnostics ---------------------------------------------------------------------------

STATUS = """status AS (SELECT m.subject, m.marker_id, m.task, CASE
      WHEN lower(trim(m.task)) NOT IN (SELECT task FROM allowed) THEN 'not_allowed_by_reference_tasks'
      WHEN coalesce(start_rows, 0) = 0 OR coalesce(end_rows, 0) = 0 THEN 'missing_start_or_end'
      WHEN t_end <= t_start THEN 'bad_timestamps' WHEN coalesce(segment_rows, 0) = 0 THEN 'empty_segment'
      WHEN reference_rows = 0 THEN 'all_reference_fft_nan' ELSE 'ok' END AS status, segment_rows, t_start, t_end
    FROM markers m LEFT JOIN pairs USING (subject, marker_id)
    LEFT JOIN (SELECT subject, marker_id, count(*) AS segment_rows, count(f1) AS reference_rows FROM windows
               GROUP BY 1, 2) USING (subject, marker_id)),
    diag AS (SELECT subject, marker_id, task, status,
      CASE WHEN status IN ('all_reference_fft_nan', 'ok') THEN segment_rows END AS segment_rows,
      CASE WHEN status IN ('bad_timestamps', 'empty_segment', 'ok') THEN t_start END AS t_start,
      CASE WHEN status IN ('bad_timestamps', 'empty_segment', 'ok') THEN t_end END AS t_end,
      CASE WHEN status = 'ok' THEN t_end - t_start END AS duration_ticks FROM status)"""


def _status(t):
    rows = t.windows.groupBy("subject", "marker_id").agg(F.count(F.lit(1)).alias("segment_rows"),
                                                         F.count("f1").alias("reference_rows"))
    return s.segment_status(t.markers, t.pairs, t.allowed, rows)


@query("d1_segment_status", sql("markers allowed windows", f"WITH {STATUS} SELECT * FROM diag"))
def _(t):
    return _status(t)


@query("d2_segment_duration", sql("windows", """SELECT subject, marker_id, count(*) AS segment_rows,
    max(t_end) - min(t_start) AS duration_ticks FROM windows GROUP BY 1, 2"""))
def _(t):
    return s.segment_duration(t.windows, ["subject", "marker_id"])


@query("d3_kept_counts", sql("markers allowed windows", f"""WITH {STATUS} SELECT c_custkey AS subject,
    coalesce(kept_tasks, 0) AS kept_tasks, coalesce(kept_windows, 0) AS kept_windows, coalesce(skipped, 0) AS skipped
    FROM customer LEFT JOIN (SELECT subject, count(*) FILTER (WHERE status = 'ok') AS kept_tasks,
      CAST(sum(segment_rows) FILTER (WHERE status = 'ok') AS BIGINT) AS kept_windows,
      count(*) FILTER (WHERE status <> 'ok') AS skipped FROM diag GROUP BY 1) ON subject = c_custkey"""))
def _(t):
    return s.kept_counts(_status(t), t.meta)


@query("d4_row_attrition", sql("checked", """SELECT subject, count(*) AS raw_rows, count(*) FILTER (WHERE ok) AS clean_rows
    FROM checked GROUP BY 1"""))
def _(t):
    return q.row_attrition(q.quality_mask(t.marked, SPEC))


@query("d5_run_summary", sql("obs", """SELECT count(*) AS rows, count(DISTINCT subject) AS subjects,
    count(DISTINCT task) AS tasks, CAST(4 AS BIGINT) AS features FROM obs"""))
def _(t):
    return sub.run_summary(t.obs, ["qty", "price", "disc", "tax"])


def _flow(t):
    return build_segments(t.marked, t.markers, t.meta, t.allowed, SPEC, ["f1", "f2"], "f1", tie=["event_id"])


@query("flow_segment_medians", sql("markers allowed windows meta", """WITH w AS (SELECT w.*, hours, gender FROM windows w
      JOIN meta USING (subject) WHERE f1 IS NOT NULL AND lower(trim(task)) IN (SELECT task FROM allowed))
    SELECT subject, task, round(median(f1), 6) AS f1, round(median(f2), 6) AS f2, min(hours) AS hours,
      min(gender) AS gender, count(*) AS num_windows, task || '-' || subject AS segment_id FROM w GROUP BY 1, 2"""))
def _(t):
    return _flow(t).medians.withColumns({c: F.round(c, 6) for c in ("f1", "f2")})


@query("flow_segment_windows", sql("markers allowed windows meta", """SELECT
      task || '-' || subject || '-window' || window_index AS window_id, task || '-' || subject AS segment_id, subject,
      task, marker_id, window_index, ts, f1, f2, hours, gender FROM windows JOIN meta USING (subject)
    WHERE f1 IS NOT NULL AND lower(trim(task)) IN (SELECT task FROM allowed)"""))
def _(t):
    return _flow(t).windows


@query("flow_segment_diagnostics", sql("markers allowed windows", f"""WITH {STATUS} SELECT diag.*, raw_rows, clean_rows FROM diag
    JOIN (SELECT subject, count(*) AS raw_rows, count(*) FILTER (WHERE ok) AS clean_rows FROM checked GROUP BY 1)
    USING (subject) WHERE subject IN (SELECT c_custkey FROM customer)"""))
def _(t):
    return _flow(t).diagnostics


# ---- scalars -------------------------------------------------------------------------------

@query("x1_clean_key", """SELECT p_partkey, lower(trim('  ' || p_name || ' ')) AS task_key, upper(trim(p_type || ' ')) AS id_key
    FROM part""")
def _(t):
    padded = F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))
    return t.part.select("p_partkey", x.clean_key(padded).alias("task_key"),
                         x.clean_key(F.concat("p_type", F.lit(" ")), upper=True).alias("id_key"))


@query("x2_segment_key", """SELECT l_orderkey, l_linenumber, l_returnflag || '-' || l_suppkey AS segment_id,
    l_returnflag || '-' || l_suppkey || '-window' || l_linenumber AS window_id FROM lineitem""")
def _(t):
    flag, supp = F.col("l_returnflag"), F.col("l_suppkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", x.segment_key(flag, supp).alias("segment_id"),
                             x.segment_key(flag, supp, F.col("l_linenumber")).alias("window_id"))


@query("x3_split_feature", """SELECT p_partkey, split_part('POW.' || p_brand || '.' || p_type, '.', 2) AS channel,
    split_part('POW.' || p_brand || '.' || p_type, '.', 3) AS band FROM part""")
def _(t):
    channel, band = x.split_feature(F.concat_ws(".", F.lit("POW"), F.col("p_brand"), F.col("p_type")))
    return t.part.select("p_partkey", channel.alias("channel"), band.alias("band"))


def _words(c: str, words: list[str]) -> str:
    if not words:
        return "false"
    return "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for w in words) + ")"


def _category_sql(name: str, description: str, domain: str) -> str:
    cases = " ".join(f"WHEN {_words(name, n)} OR {_words(domain, c)} OR {_words(description, d)} THEN '{cat}'"
                     for cat, n, c, d in x.TASK_CATEGORIES)
    return f"CASE {cases} ELSE '{x.OTHER_CATEGORY}' END"


@query("x4_keyword_category", f"""SELECT doc_id, {_category_sql('text', 'source', 'lang')} AS by_name,
    {_category_sql('source', 'text', 'lang')} AS by_description, {_category_sql('lang', 'source', 'text')} AS by_domain
    FROM documents""")
def _(t):
    text, source, lang = F.col("text"), F.col("source"), F.col("lang")
    return t.documents.select("doc_id", x.keyword_category(text, source, lang).alias("by_name"),
                              x.keyword_category(source, text, lang).alias("by_description"),
                              x.keyword_category(lang, source, text).alias("by_domain"))


def _family_sql(c: str, families, baseline: str) -> str:
    cases = " ".join(f"WHEN starts_with({c}, '{p}') THEN '{f}'" for p, f in families if p != baseline)
    return f"CASE WHEN {c} = '{baseline}' THEN 'baseline' {cases} ELSE 'other' END"


PART_TASK = "(CASE p_type WHEN 'ECONOMY' THEN 'frontal' WHEN 'SMALL' THEN 'baseline_talk' WHEN 'STANDARD' THEN 'imagine' " \
            "WHEN 'LARGE' THEN 'valdo' ELSE 'saying_words' END || CASE WHEN p_size > 25 THEN '' ELSE '_a' END)"


@query("x5_task_family", f"SELECT p_partkey, {_family_sql(PART_TASK, x.TASK_FAMILIES, x.BASELINE_TASK)} AS family FROM part")
def _(t):
    kind = F.col("p_type")
    stem = (F.when(kind == "ECONOMY", "frontal").when(kind == "SMALL", "baseline_talk").when(kind == "STANDARD", "imagine")
            .when(kind == "LARGE", "valdo").otherwise("saying_words"))
    task = F.concat(stem, F.when(F.col("p_size") > 25, "").otherwise("_a"))
    return t.part.select("p_partkey", x.task_family(task).alias("family"))


@query("x6_bin_label", sql("meta", """SELECT subject, CASE WHEN hours >= 0 AND hours < 6 THEN 'Short' WHEN hours >= 6 AND hours < 8
    THEN 'Normal' WHEN hours >= 8 AND hours < 99 THEN 'Long' END AS label FROM meta"""))
def _(t):
    return t.meta.select("subject", x.bin_label(F.col("hours")).alias("label"))


@query("x7_bin_label_inclusive", sql("meta", """SELECT subject, CASE WHEN hours < 6 THEN 'Short' WHEN hours > 8 THEN 'Long'
    ELSE 'Normal' END AS label FROM meta"""))
def _(t):
    return t.meta.select("subject", x.bin_label_inclusive(F.col("hours")).alias("label"))


@query("x8_two_way_label", sql("meta", """SELECT subject, CASE WHEN hours < 6 THEN 'Short' ELSE 'NotShort' END AS below_6,
    CASE WHEN hours < 7 THEN 'LowSleep' ELSE 'HigherSleep' END AS below_7, CASE WHEN hours <= 7 THEN 'low' ELSE 'high' END
    AS at_most_7, CASE WHEN hours > 6 THEN 1 ELSE 0 END AS above_6, CASE WHEN hours <= 6 THEN 1 ELSE 0 END AS at_most_6
    FROM meta"""))
def _(t):
    h = F.col("hours")
    return t.meta.select("subject", x.two_way_label(h, 6, "<", "Short", "NotShort").alias("below_6"),
                         x.two_way_label(h, 7, "<", "LowSleep", "HigherSleep").alias("below_7"),
                         x.two_way_label(h, 7, "<=", "low", "high").alias("at_most_7"),
                         x.two_way_label(h, 6, ">", 1, 0).alias("above_6"),
                         x.two_way_label(h, 6, "<=", 1, 0).alias("at_most_6"))


@query("x9_signed_log1p", "SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS slog FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.round(x.signed_log1p(F.col("c_acctbal")), 6).alias("slog"))


@query("x10_clip", sql("gaps", """SELECT subject, task, CASE WHEN tax IS NOT NULL THEN greatest(least((tax - 0.04) * 100, 3), -3)
    END AS clipped FROM gaps""".replace("(tax - 0.04) * 100", "round((tax - 0.04) * 100, 7)")))
def _(t):
    return t.gaps.select("subject", "task", x.clip(F.round((F.col("tax") - 0.04) * 100, 7), -3.0, 3.0).alias("clipped"))


@query("x11_significance_stars", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount / l_quantity < 0.001 THEN '***'
    WHEN l_discount / l_quantity < 0.01 THEN '**' WHEN l_discount / l_quantity < 0.05 THEN '*' ELSE 'n.s.' END AS stars
    FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             x.significance_stars(F.col("l_discount") / F.col("l_quantity")).alias("stars"))


@query("x12_round_half_even", """SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 1) AS quarter,
    round_even(l_quantity / 2, 0) AS half FROM lineitem""")
def _(t):
    qty = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", x.round_half_even(qty / 4, 1).alias("quarter"),
                             x.round_half_even(qty / 2, 0).alias("half"))


@query("x13_code_map", sql("meta", """SELECT subject, CASE gender WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 END AS code,
    CASE WHEN hours < 6 THEN 'Short sleeper (under 6h)' WHEN hours > 8 THEN 'Long sleeper (over 8h)'
    ELSE 'Normal sleeper (6–8h)' END AS friendly FROM meta"""))
def _(t):
    kind = x.bin_label_inclusive(F.col("hours"))
    return t.meta.select("subject", x.code_map(F.col("gender"), {"BUILDING": 0, "MACHINERY": 1}).alias("code"),
                         x.code_map(kind, x.FRIENDLY_LABELS).alias("friendly"))


@query("x14_row_mean", sql("gaps", """SELECT subject, task, round((coalesce(qty, 0) + coalesce(price, 0) + coalesce(tax, 0))
    / (CASE WHEN qty IS NULL THEN 0 ELSE 1 END + CASE WHEN price IS NULL THEN 0 ELSE 1 END
       + CASE WHEN tax IS NULL THEN 0 ELSE 1 END), 7) AS mean FROM gaps"""))
def _(t):
    return t.gaps.select("subject", "task", F.round(x.row_mean("qty", "price", "tax"), 7).alias("mean"))


@query("x15_safe_name", "SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part")
def _(t):
    return t.part.select("p_partkey", x.safe_name(F.col("p_name")).alias("name"))


@query("x16_strip_affix", "SELECT p_partkey, p_name AS name FROM part")
def _(t):
    dotted = F.concat(F.lit("PM."), F.col("p_name"), F.lit(".Scaled"))
    return t.part.select("p_partkey", x.strip_affix(dotted).alias("name"))


# ---- row functions of the UDF surface --------------------------------------------------------

@query("f1_row_functions", """SELECT p_partkey, p_type || '-' || p_brand || '-window' || p_size AS window_id,
    CASE WHEN contains(lower(p_name), 'image') THEN 'Emotional' ELSE 'Other_Stimuli' END AS category FROM part""")
def _(t):
    name = F.col("p_name")
    return t.part.select("p_partkey", x.segment_key(F.col("p_type"), F.col("p_brand"), F.col("p_size")).alias("window_id"),
                         x.keyword_category(name, F.lit(None), F.lit(None)).alias("category"))


@query("j4_enrich_large_side", sql("rec meta", "SELECT event_id, hours FROM rec JOIN meta USING (subject)"))
def _(t):
    """The way taken when the per-subject side is too large to broadcast."""
    return attach(t.rec.select("event_id", "subject"), t.meta, ["subject"], rows=10).select("event_id", "hours")
