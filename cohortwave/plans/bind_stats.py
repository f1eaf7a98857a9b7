"""Aggregates, correlation, group comparison, windows, sorts and set operations on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as x
from ..functions.tails import pearson_p
from ..operators import correlation as c
from ..operators import groups as g
from ..operators import quality as q
from ..operators import relative as r
from ..operators import subjects as sub
from ..operators.evaluate import leaderboard
from .proxies import BASELINE, FAMILIES, FEATURES, LABELS, SPEC, rounded, sql
from .registry import query

BAND_SETS = {"volume": ["qty", "price"], "rate": ["disc", "tax"]}
CHANNEL_SETS = {"left": ["qty", "disc"], "right": ["price", "tax"]}


def avgs(cols, digits=7):
    return ", ".join(f"round(avg({k}), {digits}) AS {k}" for k in cols)


SAFE = "covar_samp({a}, {b}) / nullif(stddev_samp({a}) FILTER (WHERE {b} IS NOT NULL) * stddev_samp({b}) FILTER (WHERE {a} IS NOT NULL), 0)"


def corr_sql(a: str, b: str) -> str:
    return SAFE.format(a=a, b=b)


def union(parts) -> str:
    return " UNION ALL ".join(parts)


# ---- subject tables and counts ---------------------------------------------------------------

@query("a4_subject_mean", sql("gaps", f"SELECT subject, {avgs(FEATURES)}, min(hours) AS hours FROM gaps GROUP BY 1"))
def _(t):
    return rounded(sub.subject_mean(t.gaps, FEATURES), FEATURES)


@query("a5_subject_mean_gender", sql("gaps", f"""SELECT subject, {avgs(FEATURES)}, min(hours) AS hours,
    CASE min(gender) WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 END AS gender FROM gaps GROUP BY 1"""))
def _(t):
    return rounded(sub.subject_mean_gender(t.gaps, FEATURES, codes={"BUILDING": 0, "MACHINERY": 1}), FEATURES)


@query("a6_subject_mean_tasks", sql("gaps", f"""SELECT subject, {avgs(FEATURES)}, min(hours) AS hours FROM gaps
    WHERE task IN ('1-URGENT', '2-HIGH') GROUP BY 1"""))
def _(t):
    return rounded(sub.subject_mean_tasks(t.gaps, FEATURES, ["1-URGENT", "2-HIGH"]), FEATURES)


@query("a6_coverage", sql("gaps", """SELECT count(*) AS subjects, CAST(count(*) FILTER (WHERE tax IS NULL)
    + count(*) FILTER (WHERE price IS NULL) AS BIGINT) AS missing_values FROM (SELECT subject, avg(tax) AS tax,
    avg(price) AS price FROM gaps WHERE task IN ('1-URGENT', '2-HIGH') GROUP BY 1)"""))
def _(t):
    return sub.coverage(sub.subject_mean_tasks(t.gaps, FEATURES, ["1-URGENT", "2-HIGH"]), FEATURES)


@query("a7_distinct_counts", sql("obs", """SELECT count(*) AS rows, count(DISTINCT subject) AS subjects,
    count(DISTINCT task) AS tasks, count(DISTINCT (subject, task)) AS pairs FROM obs"""))
def _(t):
    return sub.distinct_counts(t.obs)


@query("a8_value_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def _(t):
    return sub.value_counts(t.events, "event_type")


@query("a9_distinct_members", """SELECT p_type, count(*) AS members, string_agg(p_name, ', ' ORDER BY p_name) AS names
    FROM (SELECT DISTINCT p_type, p_name FROM part) GROUP BY 1""")
def _(t):
    return sub.distinct_members(t.part, "p_type", "p_name")


def _target_counts() -> str:
    left = {"short": "hours >= 0 AND hours < 6", "normal": "hours >= 6 AND hours < 8", "long": "hours >= 8 AND hours < 99"}
    both = {"short": "hours < 6", "normal": "hours >= 6 AND hours <= 8", "long": "hours > 8"}
    return ", ".join([f"count(*) FILTER (WHERE {v}) AS left_closed_{k}" for k, v in left.items()]
                     + [f"count(*) FILTER (WHERE {v}) AS inclusive_{k}" for k, v in both.items()])


@query("a10_describe_target", sql("meta", f"""SELECT round(median(hours), 7) AS median, count(hours) AS n,
    round(avg(hours), 7) AS mean, round(stddev_samp(hours), 7) AS std, min(hours) AS min, max(hours) AS max,
    {_target_counts()} FROM meta"""))
def _(t):
    return rounded(sub.describe_target(t.meta), ["median", "mean", "std"])


@query("a11_quality_report", sql("rec", """WITH cut AS (SELECT *, CASE WHEN max(overall) OVER (PARTITION BY subject) <= 1
      THEN 0.2 ELSE 20 END AS c FROM rec),
    f AS (SELECT *, interpolated = 0 AS a, overall >= c AS b, coalesce(ch_a >= 1 AND ch_b >= 1, false) AS d FROM cut)
    SELECT subject, round_even(100 * (1 - sum(interpolated) / count(*)), 2) AS usable_pct,
      round_even(avg(overall), 2) AS overall_cq, round_even(100 * avg(a::INT), 2) AS interpolated_pass_pct,
      round_even(100 * avg(b::INT), 2) AS overall_pass_pct, round_even(100 * avg(d::INT), 2) AS channels_pass_pct,
      round_even(100 * avg((a AND b AND d)::INT), 2) AS retained_pct, round_even(avg(ch_a), 2) AS mean_ch_a,
      round_even(avg(ch_b), 2) AS mean_ch_b FROM f GROUP BY 1"""))
def _(t):
    return q.quality_report(t.rec, SPEC)


@query("a12_group_minmax", sql("gaps", union(
    f"SELECT '{f}' AS feature, round(min({f}), 7) AS min, round(max({f}), 7) AS max FROM gaps WHERE hours < 7" for f in FEATURES)))
def _(t):
    return rounded(g.group_minmax(t.gaps.where("hours < 7"), FEATURES), ["min", "max"])


@query("a13_cluster_summary", sql("obs", """SELECT gender, count(subject) AS n_subjects, round(avg(hours), 7) AS mean_label,
    round(stddev_samp(hours), 7) AS std_label, min(hours) AS min_label, max(hours) AS max_label FROM obs GROUP BY 1"""))
def _(t):
    return rounded(g.cluster_summary(t.obs, "gender"), ["mean_label", "std_label"])


@query("a13_cluster_summary_subjects", sql("obs", """SELECT gender, count(DISTINCT subject) AS n_subjects,
    round(avg(hours), 7) AS mean_label, round(stddev_samp(hours), 7) AS std_label, min(hours) AS min_label,
    max(hours) AS max_label FROM obs GROUP BY 1"""))
def _(t):
    return rounded(g.cluster_summary(t.obs, "gender", distinct=True), ["mean_label", "std_label"])


def row_mean_sql(cols) -> str:
    total = " + ".join(f"coalesce({k}, 0)" for k in cols)
    n = " + ".join(f"({k} IS NOT NULL)::INT" for k in cols)
    return f"(({total}) / nullif({n}, 0))"


def rollup_sql(groups) -> str:
    means = ", ".join(f"avg({k}) AS {k}" for k in FEATURES)
    cols = ", ".join(f"round({row_mean_sql(v)}, 7) AS {k}" for k, v in groups.items())
    return f"SELECT subject, task, {cols} FROM (SELECT subject, task, {means} FROM {{src}} GROUP BY 1, 2)"


@query("a14_band_rollup", sql("gaps", rollup_sql(BAND_SETS).format(src="gaps")))
def _(t):
    return rounded(sub.group_rollup(t.gaps, ["subject", "task"], BAND_SETS), BAND_SETS)


@query("a15_channel_rollup", sql("gaps", rollup_sql(CHANNEL_SETS).format(src="gaps")))
def _(t):
    return rounded(sub.group_rollup(t.gaps, ["subject", "task"], CHANNEL_SETS), CHANNEL_SETS)


GRID = f"""WITH bands AS ({rollup_sql(BAND_SETS).format(src='gaps')}),
    grid AS (SELECT s.subject, k.task, coalesce(volume, 0) AS volume, coalesce(rate, 0) AS rate
      FROM (SELECT DISTINCT subject FROM obs) s CROSS JOIN (SELECT DISTINCT task FROM obs) k LEFT JOIN bands b
      ON b.subject = s.subject AND b.task = k.task)"""


@query("a16_dense_grid_median", sql("gaps", f"""{GRID} SELECT task, round(median(volume), 7) AS volume,
    round(median(rate), 7) AS rate FROM grid GROUP BY 1"""))
def _(t):
    bands = rounded(sub.group_rollup(t.gaps, ["subject", "task"], BAND_SETS), BAND_SETS)
    return rounded(sub.dense_grid_median(bands, list(BAND_SETS)), BAND_SETS)


# ---- correlation -----------------------------------------------------------------------------

@query("a17_corr_matrix", sql("gaps", union(
    f"SELECT '{a}' AS a, '{b}' AS b, round({corr_sql(a, b)}, 7) AS r FROM gaps" for a in FEATURES for b in FEATURES)))
def _(t):
    return rounded(c.corr_matrix(t.gaps, FEATURES), ["r"])


@query("a18_corr_with_target", sql("gaps", union(
    f"SELECT '{a}' AS feature, round({corr_sql(a, 'hours')}, 7) AS r FROM gaps" for a in FEATURES)))
def _(t):
    return rounded(c.corr_with_target(t.gaps, FEATURES), ["r"])


@query("a18_corr_strength", sql("gaps", f"""SELECT round(median(abs(r)), 7) AS median_abs_r,
    count(*) FILTER (WHERE abs(r) >= 0.002) AS n_ge_0, count(*) FILTER (WHERE abs(r) >= 0.02) AS n_ge_2 FROM (""" + union(
    f"SELECT {corr_sql(a, 'hours')} AS r FROM gaps" for a in FEATURES) + ")"))
def _(t):
    return rounded(c.corr_strength(c.corr_with_target(t.gaps, FEATURES), (0.002, 0.02)), ["median_abs_r"])


@query("a19_corr_block", sql("gaps", union(
    f"SELECT '{a}' AS feature, '{b}' AS metric, round({corr_sql(a, b)}, 7) AS r FROM gaps"
    for a in ("qty", "price") for b in ("disc", "tax"))))
def _(t):
    return rounded(c.corr_block(t.gaps, ["qty", "price"], ["disc", "tax"]), ["r"])


@query("a20_corr_block_region", sql("gaps", "SELECT * FROM (" + union(
    f"SELECT '{a}' AS feature, '{b}' AS metric, round({corr_sql(a, b)}, 7) AS r, '{reg}' AS region FROM gaps"
    for a, reg in (("qty", "front"), ("price", "front"), ("price", "back")) for b in ("disc", "tax")) + ")"))
def _(t):
    block = c.corr_block(t.gaps, ["qty", "price"], ["disc", "tax"])
    return rounded(c.corr_block_region(block, {"front": ["qt", "pri"], "back": ["ice"], "none": ["zz"]}), ["r"])


@query("a21_corr_by_group", sql("gaps", union(
    f"SELECT gender, count(*) AS n, '{a}' AS feature, round({corr_sql(a, 'hours')}, 7) AS r FROM gaps GROUP BY gender HAVING count(*) > 1200"
    for a in FEATURES)))
def _(t):
    return rounded(c.corr_by_group(t.gaps, "gender", FEATURES, min_n=1200), ["r"])


TASK_CORR = "WITH full_rows AS (SELECT * FROM gaps WHERE price IS NOT NULL AND tax IS NOT NULL), tc AS (" + union(
    f"SELECT task, count(*) AS n, '{a}' AS feature, {corr_sql(a, 'hours')} AS r FROM full_rows GROUP BY task HAVING count(*) >= 10"
    for a in FEATURES) + ")"


@query("a22_task_corr", sql("gaps", TASK_CORR + " SELECT task, n, feature, round(r, 7) AS r FROM tc"))
def _(t):
    return rounded(c.task_corr(t.gaps, FEATURES, with_p=False), ["r"])


GRID_STEPS = 2000


def t_tail_sql(rows: str, columns: str) -> str:
    """p of a correlation r over n rows by Simpson sums: with r = sin(a), the share of cos^(n - 3) beyond a."""
    total = f"sum(w * pow(greatest(cos(pi() / 2 * i / {GRID_STEPS}), 0), n - 3))"
    beyond = f"sum(w * pow(greatest(cos(a + (pi() / 2 - a) * i / {GRID_STEPS}), 0), n - 3)) * (pi() / 2 - a) / (pi() / 2)"
    return f"""grid AS (SELECT i, CASE WHEN i IN (0, {GRID_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(0, {GRID_STEPS} + 1) g(i)),
    inside AS (SELECT *, asin(abs(r)) AS a FROM {rows} WHERE abs(r) < 1 AND n > 2),
    p_of AS (SELECT {columns}, n, r, a, {beyond} / {total} AS p FROM inside, grid GROUP BY {columns}, n, r, a)"""


@query("a23_pearson_p", sql("gaps", TASK_CORR + ", " + t_tail_sql("tc", "task, feature")
                            + " SELECT task, feature, n, round(r, 7) AS r, round(p, 7) AS p FROM p_of"))
def _(t):
    """Two-sided p of every task and feature correlation."""
    return rounded(c.task_corr(t.gaps, FEATURES), ["r", "p"])


BANDED = " SELECT * FROM (SELECT task, CASE WHEN feature IN ('qty', 'price') THEN 'volume' ELSE 'rate' END AS band, r FROM tc)"


def _banded(t):
    corr = c.task_corr(t.gaps, FEATURES, with_p=False)
    return corr.withColumn("band", F.when(F.col("feature").isin("qty", "price"), "volume").otherwise("rate"))


@query("a24_band_heatmap", sql("gaps", TASK_CORR + f""" SELECT task, round(avg(r) FILTER (WHERE band = 'volume'), 7) AS volume,
    round(avg(r) FILTER (WHERE band = 'rate'), 7) AS rate FROM ({BANDED}) GROUP BY 1"""))
def _(t):
    return rounded(c.band_heatmap(_banded(t), ["volume", "rate"]), ["volume", "rate"])


@query("a25_ols_line", sql("gaps", """SELECT round(regr_slope(hours, tax), 7) AS slope,
    round(regr_intercept(hours, tax), 7) AS intercept, CAST(regr_count(hours, tax) AS BIGINT) AS n FROM gaps"""))
def _(t):
    return rounded(c.ols_line(t.gaps, "tax", "hours"), ["slope", "intercept"])


# ---- group comparison ------------------------------------------------------------------------

@query("a26_group_mean_sem", sql("gaps", union(
    f"""SELECT gender, task, '{f}' AS feature, round(avg({f}), 7) AS mean,
    round(stddev_samp({f}) / sqrt(count({f})), 7) AS sem, count({f}) AS n FROM gaps GROUP BY 1, 2""" for f in FEATURES)))
def _(t):
    return rounded(g.group_mean_sem(t.gaps, ["gender", "task"], FEATURES), ["mean", "sem"])


@query("j11_pairwise_groups", """SELECT a.o_orderpriority AS group1, b.o_orderpriority AS group2
    FROM (SELECT DISTINCT o_orderpriority FROM orders) a JOIN (SELECT DISTINCT o_orderpriority FROM orders) b
    ON a.o_orderpriority < b.o_orderpriority""")
def _(t):
    return g.pairwise_groups(t.orders, "o_orderpriority")


LABELLED = """labelled AS (SELECT *, CASE WHEN hours < 6 THEN 'Short' WHEN hours < 8 THEN 'Normal' ELSE 'Long' END AS grp FROM subj)"""


def _u_sql(f: str, a: str, b: str) -> str:
    return f"""SELECT '{f}' AS feature, '{a}' AS group1, '{b}' AS group2, n1, n2,
      r1 - n1 * (n1 + 1) / 2.0 AS u FROM (SELECT count(*) FILTER (WHERE grp = '{a}') AS n1,
        count(*) FILTER (WHERE grp = '{b}') AS n2, sum(rk) FILTER (WHERE grp = '{a}') AS r1 FROM
        (SELECT grp, rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS rk FROM labelled
         WHERE grp IN ('{a}', '{b}')))"""


PAIRS = [("Short", "Normal"), ("Short", "Long"), ("Normal", "Long")]


def _labelled(t):
    h = F.col("hours")
    return t.subj.withColumn("grp", F.when(h < 6, "Short").when(h < 8, "Normal").otherwise("Long"))


@query("a27_mann_whitney_u", sql("subj", f"WITH {LABELLED} " + union(_u_sql(f, a, b) for f in ("qty", "tax") for a, b in PAIRS)))
def _(t):
    return g.mann_whitney(_labelled(t), "grp", LABELS, ["qty", "tax"]).select(
        "feature", "group1", "group2", "n1", "n2", "u")


@query("a27_mann_whitney_p")
def _(t):
    """Two-sided p per feature and pair of label groups."""
    return rounded(g.mann_whitney(_labelled(t), "grp", LABELS, FEATURES), ["p"])


@query("a28_bonferroni", """SELECT l_orderkey, l_linenumber, l_discount / l_quantity AS p, CAST(0.05 / 48 AS DOUBLE) AS alpha_corrected,
    CASE WHEN l_discount / l_quantity < 0.05 / 48 THEN '* (Bonf.)' ELSE 'n.s. (Bonf.)' END AS verdict FROM lineitem
    """.replace("0.05 / 48", "0.05::DOUBLE / 48"))
def _(t):
    tests = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") / F.col("l_quantity")).alias("p"))
    return g.bonferroni(tests, features=16, pairs=3)


def _d_sql(f: str) -> str:
    return f"""SELECT '{f}' AS feature, abs(avg({f}) FILTER (WHERE hours <= 6) - avg({f}) FILTER (WHERE hours > 6)) / sqrt(
      ((count(*) FILTER (WHERE hours <= 6) - 1) * var_samp({f}) FILTER (WHERE hours <= 6)
       + (count(*) FILTER (WHERE hours > 6) - 1) * var_samp({f}) FILTER (WHERE hours > 6)) / (count(*) - 2)) AS d FROM gaps"""


def _effects(t):
    return g.cohens_d(t.gaps.withColumn("good", x.two_way_label(F.col("hours"), 6, ">", 1, 0)), FEATURES, "good")


@query("a29_cohens_d", sql("gaps", f"SELECT feature, round(d, 7) AS d FROM ({union(_d_sql(f) for f in FEATURES)})"))
def _(t):
    return rounded(_effects(t), ["d"])


@query("a29_effect_summary", sql("gaps", f"""SELECT round(max(d), 7) AS max_d, round(avg(d), 7) AS mean_d,
    arg_max(feature, d) AS top_feature FROM ({union(_d_sql(f) for f in FEATURES)})"""))
def _(t):
    return rounded(g.effect_summary(_effects(t)), ["max_d", "mean_d"])


@query("a30_mean_cv", sql("gaps", "SELECT gender, round((" + " + ".join(
    f"abs(stddev_samp({f}) / nullif(avg({f}), 0))" for f in FEATURES) + ") / 4, 7) AS mean_cv FROM gaps GROUP BY 1"))
def _(t):
    return rounded(g.mean_cv(t.gaps, FEATURES, ["gender"]), ["mean_cv"])


@query("a31_mean_pairwise_cosine", """WITH u AS (SELECT label, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v
      FROM embeddings),
    nrm AS (SELECT label, vec_id, list_transform(v, lambda a: a / sqrt(list_dot_product(v, v))) AS w FROM u),
    pairs AS (SELECT a.label, list_dot_product(a.w, b.w) AS c FROM nrm a JOIN nrm b ON a.label = b.label AND a.vec_id < b.vec_id)
    SELECT label, n, round(avg(c), 7) AS mean_cosine FROM pairs JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
    USING (label) GROUP BY 1, 2""")
def _(t):
    width = t.embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0
    dims = [f"get(embedding, {i})" for i in range(width)]
    return rounded(g.mean_pairwise_cosine(t.embeddings, dims, ["label"]), ["mean_cosine"])


@query("a31_cosine_of_features", sql("gaps", """WITH n AS (SELECT subject, gender, round(sum(qty) / 50, 7) AS a,
      round(sum(coalesce(tax, 0)), 7) AS b FROM gaps GROUP BY 1, 2),
    w AS (SELECT gender, subject, a / sqrt(a * a + b * b) AS a, b / sqrt(a * a + b * b) AS b FROM n)
    SELECT p.gender, round(avg(p.a * q.a + p.b * q.b), 7) AS mean_cosine FROM w p JOIN w q
    ON p.gender = q.gender AND p.subject < q.subject GROUP BY 1"""))
def _(t):
    rows = t.gaps.groupBy("subject", "gender").agg(F.round(F.sum("qty") / 50, 7).alias("a"),
                                                   F.round(F.sum(F.coalesce("tax", F.lit(0.0))), 7).alias("b"))
    return rounded(g.mean_pairwise_cosine(rows, ["a", "b"], ["gender"]), ["mean_cosine"]).drop("n")


EDGES = [4.75, 5.25, 5.75, 6.25, 6.75, 7.25, 7.75, 8.25, 8.75]


@query("a32_histogram", sql("meta", union(
    f"""SELECT {i} AS bin, CAST({lo} AS DOUBLE) AS low, CAST({hi} AS DOUBLE) AS high, CAST({(lo + hi) / 2} AS DOUBLE) AS centre,
    count(*) FILTER (WHERE hours >= {lo} AND hours {'<=' if i == 7 else '<'} {hi}) AS count FROM meta"""
    for i, (lo, hi) in enumerate(zip(EDGES, EDGES[1:])))))
def _(t):
    return g.histogram(t.meta, "hours", EDGES)


# ---- views relative to the baseline ------------------------------------------------------------

SLOG = "(sign({0}) * ln(1 + abs({0})))"
SUMS = {"median": "median({0})", "mean": "avg({0})", "std": "stddev_pop({0})",
        "iqr": "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"}
BASED = f"""WITH med AS (SELECT subject, {', '.join(f'median({f}) AS {f}' for f in FEATURES)}, count(DISTINCT task) AS num,
      count(*) FILTER (WHERE task <> '{BASELINE}') AS others FROM gaps GROUP BY 1),
    base AS (SELECT m.subject, num, others, g.subject IS NOT NULL AS has_baseline,
      {', '.join(f'CASE WHEN g.subject IS NOT NULL THEN g.{f} ELSE m.{f} END AS {f}' for f in FEATURES)}
      FROM med m LEFT JOIN (SELECT * FROM gaps WHERE task = '{BASELINE}') g ON g.subject = m.subject),
    rel AS (SELECT g.subject, g.task, num, others,
      {', '.join(f'g.{f} - b.{f} AS delta__{f}' for f in FEATURES)},
      {', '.join(f'{SLOG.format("g." + f)} - {SLOG.format("b." + f)} AS log_delta__{f}' for f in FEATURES)},
      {', '.join(f'{SLOG.format("b." + f)} AS baseline_log__{f}' for f in FEATURES)}
      FROM gaps g JOIN base b ON g.subject = b.subject)"""


@query("j10_baseline_lookup", sql("gaps", BASED + f" SELECT subject, has_baseline, {', '.join(f'round({f}, 7) AS {f}' for f in FEATURES)} FROM base"))
def _(t):
    return rounded(r.baseline_lookup(t.gaps, FEATURES, BASELINE), FEATURES)


def _all_numeric(df, digits=7):
    return rounded(df, [f.name for f in df.schema if f.dataType.simpleString() == "double"], digits)


@query("a33_raw_summary", sql("gaps", "SELECT subject, " + ", ".join(
    f"round({fn.format(SLOG.format(f))}, 7) AS raw_{k}__{f}" for f in FEATURES for k, fn in SUMS.items())
    + ", count(DISTINCT task) AS meta_num_stimuli FROM gaps GROUP BY 1"))
def _(t):
    return _all_numeric(r.raw_summary(t.gaps, FEATURES))


@query("a34_baseline_relative", sql("gaps", BASED + " SELECT subject, " + ", ".join(
    f"round({fn.format(f'{p}__{f}')}, 7) AS {p}_{k}__{f}" for p in ("delta", "log_delta") for f in FEATURES for k, fn in SUMS.items())
    + ", " + ", ".join(f"round(any_value(baseline_log__{f}), 7) AS baseline_log__{f}" for f in FEATURES)
    + f", any_value(num) AS meta_num_stimuli FROM rel WHERE task <> '{BASELINE}' OR others = 0 GROUP BY 1"))
def _(t):
    return _all_numeric(r.baseline_relative(t.gaps, FEATURES, BASELINE))


FAMILY = f"CASE WHEN task = '{BASELINE}' THEN 'baseline' WHEN starts_with(task, '2-') THEN 'high' " \
         "WHEN starts_with(task, '3-') OR starts_with(task, '4-') THEN 'mid' ELSE 'other' END"


@query("a35_family_relative", sql("gaps", BASED + f", fam AS (SELECT *, {FAMILY} AS family FROM rel) SELECT subject, " + ", ".join(
    f"round(median({p}__{f}) FILTER (WHERE family = '{fam}'), 7) AS family_{fam}_{p}_median__{f}"
    for fam in ("high", "mid", "other") for p in ("delta", "log_delta") for f in FEATURES)
    + ", any_value(num) AS meta_num_stimuli FROM fam GROUP BY 1"))
def _(t):
    return _all_numeric(r.family_relative(t.gaps, FEATURES, FAMILIES, BASELINE))


TASKS = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("a36_taskwide_relative", sql("gaps", BASED + " SELECT subject, any_value(num) AS meta_num_stimuli, " + ", ".join(
    f"round(max(log_delta__{f}) FILTER (WHERE task = '{k}'), 7) AS \"task_{k.replace(' ', '_')}_log_delta__{f}\""
    for k in TASKS for f in FEATURES) + " FROM rel GROUP BY 1"))
def _(t):
    out = r.taskwide_relative(t.gaps, FEATURES, [BASELINE, *TASKS], BASELINE)
    return out.select("subject", "meta_num_stimuli", *[F.round(F.col(f"`{k}`"), 7).alias(k) for k in out.columns
                                                   if k not in ("subject", "meta_num_stimuli")])


@query("a37_subject_targets", sql("obs", "SELECT subject, min(hours) AS hours, count(DISTINCT task) AS num_stimuli FROM obs GROUP BY 1"))
def _(t):
    return sub.subject_targets(t.obs)


@query("a26_bootstrap_mean", sql("gaps", """WITH k AS (SELECT gender, qty, tax, CAST('0x' || substr(md5('42|' || subject || '|' || task), 1, 7) AS BIGINT) AS k FROM gaps),
    x AS (SELECT *, unnest(range(1, 101)) AS b FROM k), x1 AS (SELECT *, (k * 48271 + b * 69621 + 42) % 2147483647 AS h FROM x),
    x2 AS (SELECT * REPLACE ((h * h + 40014 * b) % 2147483647 AS h) FROM x1), x3 AS (SELECT * REPLACE ((h * 16807 + h // 127773) % 2147483647 AS h) FROM x2),
    x4 AS (SELECT *, ((h * h + h) % 2147483647) / 2147483647.0::DOUBLE AS u FROM x3),
    w AS (SELECT *, """ + " + ".join(f"CAST(u >= {p!r}::DOUBLE AS INTEGER)" for p in g.POISSON) + """ AS w FROM x4),
    l AS (SELECT gender, b, w, unnest(['qty', 'tax']) AS feature, unnest([qty, tax]) AS x FROM w),
    m AS (SELECT gender, feature, b, sum(w * x) / sum(w) AS m FROM l WHERE x IS NOT NULL GROUP BY 1, 2, 3),
    c AS (SELECT gender, feature, quantile_cont(m, 0.16) AS low, quantile_cont(m, 0.84) AS high FROM m GROUP BY 1, 2),
    o AS (SELECT gender, feature, avg(x) AS mean, count(x) AS n FROM (SELECT gender, unnest(['qty', 'tax']) AS feature, unnest([qty, tax]) AS x FROM k) GROUP BY 1, 2)
    SELECT gender, feature, round(mean, 7) AS mean, round(low, 7) AS low, round(high, 7) AS high, n FROM o JOIN c USING (gender, feature)"""))
def _(t):
    """Means and the middle 68 % of their bootstrap distribution."""
    return rounded(g.bootstrap_mean(t.gaps, ["gender"], ["qty", "tax"], ["subject", "task"], 100), ["mean", "low", "high"])


@query("a39_map_order_of_three", sql("obs", """WITH n AS (SELECT subject FROM obs GROUP BY 1 HAVING count(*) = 3),
    s AS (SELECT subject, task, row_number() OVER (PARTITION BY subject ORDER BY task) AS i, """ + ", ".join(
    f"coalesce(({f} - min({f}) OVER w) / nullif(max({f}) OVER w - min({f}) OVER w, 0), 0) AS {f}" for f in FEATURES) + """
      FROM obs JOIN n USING (subject) WINDOW w AS (PARTITION BY subject)),
    d AS (SELECT a.subject, a.i AS i, b.i AS j, """ + " + ".join(f"(a.{f} - b.{f}) ** 2" for f in FEATURES) + """ AS d FROM s a JOIN s b ON a.subject = b.subject AND a.i < b.i),
    f AS (SELECT subject, arg_min(i, (d, i, j)) AS i, arg_min(j, (d, i, j)) AS j FROM d GROUP BY 1)
    SELECT subject, task AS name, CAST(CASE WHEN s.i = f.i THEN 1 WHEN s.i = f.j THEN 2 ELSE 0 END AS INTEGER) AS position FROM s JOIN f USING (subject)"""))
def _(t):
    """Of subjects with three tasks, where the tasks stand in their clustered map: the nearest two stand side by side."""
    three = t.obs.groupBy("subject").count().where("count = 3").select("subject")
    order = sub.map_order(t.obs.join(three, "subject"), FEATURES)
    return order.where("axis = 'task'").select("subject", "name", "position")


@query("a39_map_order_sides", sql("gaps", """WITH m AS (SELECT subject, max(CAST(price IS NOT NULL AS INTEGER)) AS p, max(CAST(tax IS NOT NULL AS INTEGER)) AS x FROM gaps GROUP BY 1),
    k AS (SELECT subject, p + x + 2 AS metrics, count(*) FILTER ((p = 0 OR price IS NOT NULL) AND (x = 0 OR tax IS NOT NULL)) AS tasks
      FROM gaps JOIN m USING (subject) GROUP BY 1, 2)
    SELECT subject, unnest(['task', 'metric']) AS axis, unnest([tasks, metrics]) AS names, unnest([tasks * (tasks - 1) // 2, metrics * (metrics - 1) // 2]) AS positions
    FROM k WHERE tasks >= 2"""))
def _(t):
    """Per subject and side of its map: the names, and the sum of their positions."""
    return sub.map_order(t.gaps, FEATURES).groupBy("subject", "axis").agg(
        F.count_distinct("name").alias("names"), F.sum("position").alias("positions"))


@query("a39_metric_by_task", sql("gaps", """WITH m AS (SELECT subject, task, avg(qty) AS qty, avg(tax) AS tax FROM gaps GROUP BY 1, 2)
    SELECT subject, task, round(qty, 7) AS qty, round(tax, 7) AS tax,
      round((qty - min(qty) OVER s) / nullif(max(qty) OVER s - min(qty) OVER s, 0), 7) AS qty_scaled,
      round((tax - min(tax) OVER s) / nullif(max(tax) OVER s - min(tax) OVER s, 0), 7) AS tax_scaled
    FROM m WINDOW s AS (PARTITION BY subject)"""))
def _(t):
    return rounded(sub.metric_by_task(t.gaps, ["qty", "tax"]), ["qty", "tax", "qty_scaled", "tax_scaled"])


# ---- windows -----------------------------------------------------------------------------------

@query("w2_zscore_by", sql("gaps", "SELECT subject, task, " + ", ".join(
    f"""round(coalesce(CASE WHEN coalesce(stddev_samp({f}) OVER s, 0) = 0 THEN {f} * 0
    ELSE ({f} - avg({f}) OVER s) / stddev_samp({f}) OVER s END, 0), 5) AS {f}""" for f in ("qty", "tax"))
    + " FROM gaps WINDOW s AS (PARTITION BY subject)"))
def _(t):
    z = g.zscore_by(t.gaps.select("subject", "task", "qty", "tax"), "subject", ["qty", "tax"])
    return z.select("subject", "task", *[(F.round(k, 5) + 0.0).alias(k) for k in ("qty", "tax")])


@query("w3_zscore_columns", sql("subj", "SELECT subject, " + ", ".join(
    f"round(({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER (), 7) AS {f}" for f in FEATURES) + " FROM subj"))
def _(t):
    return rounded(g.zscore_columns(t.subj.select("subject", *FEATURES), FEATURES), FEATURES)


@query("w6_average_rank", """SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
    + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rank FROM lineitem""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return g.average_rank(rows, ["l_returnflag"], "l_quantity").select("l_orderkey", "l_linenumber", "rank")


# ---- sorts, limits, sets -----------------------------------------------------------------------

@query("t1_leaderboard", sql("obs", "SELECT task, count(*) AS n, round(avg(qty), 7) AS qty FROM obs GROUP BY 1"))
def _(t):
    table = t.obs.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("qty"), 7).alias("qty"))
    return leaderboard(table, descending=["n"], ascending=["qty"])


@query("t2_top_abs", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 10")
def _(t):
    return g.top_abs(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 10, ["c_custkey"])


@query("t3_top_k_features", sql("gaps", f"""SELECT feature, round(d, 7) AS d FROM ({union(_d_sql(f) for f in FEATURES)})
    ORDER BY d DESC, feature LIMIT 2"""))
def _(t):
    return rounded(g.top_k_features(_effects(t), "d", 2, ["feature"]), ["d"])


@query("t4_arg_max", sql("gaps", TASK_CORR + " SELECT task, arg_max(feature, abs(r)) AS feature, round(max(abs(r)), 7) AS size FROM tc GROUP BY 1"))
def _(t):
    corr = c.task_corr(t.gaps, FEATURES, with_p=False).withColumn("size", F.abs("r"))
    return rounded(g.arg_max(corr, ["task"], "feature", "size"), ["size"])


@query("t5_order_by_row_max", sql("gaps", TASK_CORR + f""" SELECT *, greatest(abs(volume), abs(rate)) AS max_abs FROM (SELECT task,
    round(avg(r) FILTER (WHERE band = 'volume'), 7) AS volume, round(avg(r) FILTER (WHERE band = 'rate'), 7) AS rate
    FROM ({BANDED}) GROUP BY 1)"""))
def _(t):
    heat = rounded(c.band_heatmap(_banded(t), ["volume", "rate"]), ["volume", "rate"])
    return c.order_by_row_max(heat, ["volume", "rate"])


@query("u1_concat_rows", """SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL AS name FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier""")
def _(t):
    return sub.concat_rows([
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))])


@query("u2_set_difference", "SELECT DISTINCT c_custkey AS id FROM customer EXCEPT SELECT user_id FROM events")
def _(t):
    return sub.set_difference(t.customer.select(F.col("c_custkey").alias("id")), t.events.select("user_id"))


@query("u3_distinct_values", "SELECT DISTINCT p_brand FROM part")
def _(t):
    return sub.distinct_values(t.part, "p_brand")


# ---- tails and names -----------------------------------------------------------------------------

@query("f4_tail_probabilities", "WITH base AS (SELECT p_partkey, (p_retailprice - 950) / 60 AS r, CAST(p_size AS BIGINT) AS n FROM part WHERE p_size > 2), "
       + t_tail_sql("base", "p_partkey") + """ SELECT p_partkey, round(r, 7) AS r, n, round(p, 7) AS p FROM p_of
       UNION ALL SELECT p_partkey, round(r, 7), n, CASE WHEN r IS NOT NULL THEN 0.0::DOUBLE END FROM base WHERE abs(r) >= 1 OR r IS NULL""")
def _(t):
    """p of a correlation-like value per line of the part table."""
    rows = t.part.select("p_partkey", ((F.col("p_retailprice") - 950) / 60).alias("r"), F.col("p_size").cast("long").alias("n"))
    return rounded(rows.where("n > 2").withColumn("p", pearson_p(F.col("r"), F.col("n"))), ["r", "p"])


@query("f2_element_functions", sql("obs", f"""SELECT subject, task, {FAMILY} AS family,
    CASE WHEN hours <= 6 THEN '6h (Short)' ELSE '7h+ (Normal)' END AS side FROM obs"""))
def _(t):
    return t.obs.select("subject", "task", x.task_family(F.col("task"), FAMILIES, BASELINE).alias("family"),
                        x.two_way_label(F.col("hours"), 6, "<=", "6h (Short)", "7h+ (Normal)").alias("side"))


@query("f3_group_functions", sql("obs", """SELECT subject, task, round(CASE WHEN coalesce(stddev_samp(qty) OVER s, 0) = 0 THEN 0
    ELSE (qty - avg(qty) OVER s) / stddev_samp(qty) OVER s END, 5) AS qty FROM obs WINDOW s AS (PARTITION BY subject)"""))
def _(t):
    z = g.zscore_by(t.obs.select("subject", "task", "qty"), "subject", ["qty"], fill=None)
    return z.select("subject", "task", (F.round("qty", 5) + 0.0).alias("qty"))
