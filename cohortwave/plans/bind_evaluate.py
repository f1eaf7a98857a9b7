"""Sampling, folds, baselines, linear models and evaluation on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import bin_label
from ..operators import baselines as b
from ..operators import evaluate as e
from ..operators import folds as v
from ..operators import linear as lin
from ..operators import sampling as y
from .proxies import FEATURES, LABELS, U, rounded, sql
from .registry import query

SCORES = {"Short": "p_short", "Normal": "p_normal", "Long": "p_long"}


def union(parts) -> str:
    return " UNION ALL ".join(parts)


# ---- sampling and balancing --------------------------------------------------------------------

@query("y1_stratified_quota", sql("meta", f"""SELECT subject, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum
    ORDER BY {U(1, 'subject')}, subject) AS r FROM (SELECT subject, CASE WHEN hours <= 6 THEN 'short' WHEN hours < 8 THEN 'medium'
    ELSE 'long' END AS stratum FROM meta)) WHERE r <= CASE stratum WHEN 'medium' THEN 4 ELSE 3 END"""))
def _(t):
    h = F.col("hours")
    stratum = F.when(h <= 6, "short").when(h < 8, "medium").otherwise("long")
    return y.stratified_quota(t.meta, stratum, {"short": 3, "medium": 4, "long": 3}, 1, ["subject"]).select("subject", "stratum")


SIDES = "sides AS (SELECT *, CASE WHEN hours > 6 THEN 1 ELSE 0 END AS target FROM obs)"


@query("y2_undersample_rows", sql("obs", f"""WITH {SIDES}, least AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM sides GROUP BY target))
    SELECT subject, task, target, {U('7-shuffle', 'subject', 'task')} AS shuffle_key FROM (SELECT *, row_number() OVER
    (PARTITION BY target ORDER BY {U(7, 'subject', 'task')}, subject, task) AS r FROM sides), least WHERE r <= m"""))
def _(t):
    sides = t.obs.withColumn("target", F.when(F.col("hours") > 6, 1).otherwise(0))
    return y.undersample_rows(sides, "target", 7, ["subject", "task"]).select("subject", "task", "target", "shuffle_key")


@query("y3_undersample_groups", sql("obs", f"""WITH {SIDES}, subs AS (SELECT DISTINCT subject, target FROM sides),
    least AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM subs GROUP BY target)),
    chosen AS (SELECT subject FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {U(42, 'subject')}, subject) AS r
      FROM subs), least WHERE r <= m) SELECT subject, task, target FROM sides WHERE subject IN (SELECT subject FROM chosen)"""))
def _(t):
    sides = t.obs.withColumn("target", F.when(F.col("hours") > 6, 1).otherwise(0))
    return y.undersample_groups(sides, "subject", "target", 42).select("subject", "task", "target")


@query("y4_sample_cap", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY {U(42, 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey', 'floor(l_extendedprice)::BIGINT')}, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000")
def _(t):
    rows = t.lineitem.withColumn("whole_price", F.floor("l_extendedprice").cast("long"))
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "whole_price"]
    return y.sample_cap(rows, 1000, 42, key).select("l_orderkey", "l_linenumber", "l_partkey")


NUMBER = "round(lo + {u} * (hi - lo), 7)"


@query("y5_augment_uniform", sql("obs", f"""WITH low AS (SELECT * FROM obs WHERE hours > 7), n AS (SELECT 2 * count(*) - (SELECT count(*) FROM obs) AS c FROM low),
    ids AS (SELECT unnest(range(1, abs((SELECT c FROM n)) + 1)) AS i),
    numbered AS (SELECT task, row_number() OVER (ORDER BY {U(9, 'subject', 'task')}, subject, task) - 1 AS pick FROM low),
    genders AS (SELECT gender, row_number() OVER (ORDER BY {U(9, 'subject', 'task')}, subject, task) - 1 AS pick FROM low),
    subs AS (SELECT s, row_number() OVER (ORDER BY {U(9, 's')}, s) - 1 AS pick FROM (SELECT DISTINCT CAST(subject AS VARCHAR) AS s FROM low))
    SELECT 'SYNTH_LOW_' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 4, '0') ELSE CAST(i AS VARCHAR) END || '_FROM_' || s AS subject, task, gender, """ + ", ".join(
    f"round((SELECT min({f}) FROM low) + {U(f'9-{f}', 'i')} * (SELECT max({f}) - min({f}) FROM low), 7) AS {f}" for f in FEATURES)
    + f""", round(5.0::DOUBLE + {U('9-hours', 'i')} * 1.9::DOUBLE, 7) AS hours FROM ids
    JOIN numbered ON numbered.pick = floor({U('9-task', 'i')} * (SELECT count(*) FROM low))
    JOIN genders ON genders.pick = floor({U('9-gender', 'i')} * (SELECT count(*) FROM low))
    JOIN subs ON subs.pick = floor({U('9-subject', 'i')} * (SELECT count(*) FROM subs))"""))
def _(t):
    minority = F.col("hours") > 7
    n = y.rows_to_generate(t.obs, minority)
    made = y.augment_uniform(t.obs, minority, FEATURES, n, 9, ["subject", "task"])
    return rounded(made, [*FEATURES, "hours"])


@query("y6_balance_counts", sql("obs", """SELECT count(*) AS rows, count(*) FILTER (WHERE hours > 7) AS minority_rows,
    count(*) FILTER (WHERE NOT hours > 7) AS majority_rows,
    count(*) FILTER (WHERE NOT hours > 7) - count(*) FILTER (WHERE hours > 7) AS to_generate FROM obs"""))
def _(t):
    return y.balance_counts(t.obs, F.col("hours") > 7)


# ---- folds -------------------------------------------------------------------------------------

@query("v1_kfold", f"SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {U(42, 'o_orderkey')}, o_orderkey) - 1) % 5 + 1 AS INTEGER) AS fold FROM orders")
def _(t):
    return v.kfold(t.orders.select("o_orderkey"), 5, 42, ["o_orderkey"])


@query("v2_stratified_kfold", f"""SELECT o_orderkey, o_orderpriority, CAST((row_number() OVER (PARTITION BY o_orderpriority
    ORDER BY {U(42, 'o_orderkey')}, o_orderkey) - 1) % 5 + 1 AS INTEGER) AS fold FROM orders""")
def _(t):
    return v.stratified_kfold(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", 5, 42, ["o_orderkey"])


@query("v3_safe_k", """SELECT min(n) AS smallest, CAST(CASE WHEN min(n) < 2 THEN 0 ELSE least(min(n), 60) END AS BIGINT) AS k
    FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)""")
def _(t):
    return v.safe_k(t.labels, "toxic", 60)


GROUPED = f"""WITH sizes AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
    big AS (SELECT least(count(*) FILTER (WHERE n * 5 > (SELECT sum(n) FROM sizes)), 4) AS h FROM sizes),
    ranked AS (SELECT user_id, h, row_number() OVER (ORDER BY n DESC, {U(0, 'user_id')}, user_id) AS r FROM sizes, big),
    dealt AS (SELECT user_id, CASE WHEN r <= h THEN r WHEN ((r - 1 - h) // (5 - h)) % 2 = 0 THEN h + (r - 1 - h) % (5 - h) + 1
      ELSE h + (5 - h) - 1 - (r - 1 - h) % (5 - h) + 1 END AS fold FROM ranked)
    SELECT event_id, user_id, CAST(fold AS INTEGER) AS fold FROM events JOIN dealt USING (user_id)"""


@query("v4_group_kfold", GROUPED)
def _(t):
    return v.group_kfold(t.events.select("event_id", "user_id"), "user_id", 5)


@query("v5_leave_one_group_out", sql("obs", "SELECT subject, task, CAST(dense_rank() OVER (ORDER BY subject) AS INTEGER) AS fold FROM obs"))
def _(t):
    return v.leave_one_group_out(t.obs.select("subject", "task"), "subject")


@query("v6_group_holdout", f"""WITH g AS (SELECT user_id, row_number() OVER (ORDER BY {U(42, 'user_id')}, user_id) <=
    ceil(count(*) OVER () * 0.2) AS is_test FROM (SELECT DISTINCT user_id FROM events))
    SELECT event_id, user_id, is_test FROM events JOIN g USING (user_id)""")
def _(t):
    return v.group_holdout(t.events.select("event_id", "user_id"), "user_id", 0.2, 42)


@query("v7_stratified_holdout", f"""SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY
    {U(42, 'o_orderkey')}, o_orderkey) <= round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS is_test FROM orders""")
def _(t):
    return v.stratified_holdout(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", 0.2, 42, ["o_orderkey"])


@query("v8_nested_folds", f"""WITH o AS (SELECT doc_id, toxic, (row_number() OVER (PARTITION BY toxic ORDER BY {U(42, 'doc_id')}, doc_id) - 1)
      % 5 + 1 AS own FROM labels),
    train AS (SELECT doc_id, toxic, outer_fold FROM o, range(1, 6) g(outer_fold) WHERE own <> outer_fold)
    SELECT doc_id, toxic, CAST(outer_fold AS INTEGER) AS outer_fold, CAST((row_number() OVER (PARTITION BY outer_fold, toxic
      ORDER BY {U(43, 'doc_id')}, doc_id) - 1) % 4 + 1 AS INTEGER) AS inner_fold FROM train""")
def _(t):
    return v.nested_folds(t.labels.select("doc_id", "toxic"), "toxic", 5, 4, 42, ["doc_id"])


@query("v9_leakage_check", f"""SELECT o_custkey, count(DISTINCT fold) AS folds FROM (SELECT o_custkey, (row_number() OVER
    (ORDER BY {U(42, 'o_orderkey')}, o_orderkey) - 1) % 5 AS fold FROM orders) GROUP BY 1 HAVING count(DISTINCT fold) > 1""")
def _(t):
    """Customers that a row-wise split puts in several folds."""
    return v.leakage_check(v.kfold(t.orders.select("o_custkey", "o_orderkey"), 5, 42, ["o_orderkey"]), "fold", "o_custkey")


@query("v9_leakage_check_grouped", f"SELECT user_id, count(DISTINCT fold) AS folds FROM ({GROUPED}) GROUP BY 1 HAVING count(DISTINCT fold) > 1")
def _(t):
    return v.leakage_check(v.group_kfold(t.events.select("event_id", "user_id"), "user_id", 5), "fold", "user_id")


# ---- baselines and preparation -----------------------------------------------------------------

@query("m1_dummy_mean_cv", sql("pred", """SELECT subject, task, fold, round(((SELECT sum(hours) FROM pred) - sum(hours) OVER f)
    / ((SELECT count(hours) FROM pred) - count(hours) OVER f), 7) AS predicted FROM pred WINDOW f AS (PARTITION BY fold)"""))
def _(t):
    rows = t.pred.select("subject", "task", "fold", "hours")
    return rounded(b.dummy_mean_cv(rows, "fold", "hours").drop("hours"), ["predicted"])


@query("m2_dummy_majority_cv", sql("pred", """WITH n AS (SELECT fold, actual_label, count(*) AS c FROM pred GROUP BY 1, 2),
    rest AS (SELECT f.fold, n.actual_label, sum(c) AS c FROM (SELECT DISTINCT fold FROM pred) f JOIN n ON n.fold <> f.fold GROUP BY 1, 2),
    best AS (SELECT fold, actual_label AS predicted_label FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY c DESC, actual_label) AS r
      FROM rest) WHERE r = 1)
    SELECT subject, task, fold, actual_label, b.predicted_label FROM pred JOIN best b USING (fold)"""))
def _(t):
    return b.dummy_majority_cv(t.pred.select("subject", "task", "fold", "actual_label"), "fold", "actual_label")


@query("m3_standardize", sql("pred", """WITH s AS (SELECT fold, count(*) AS n, sum(qty) AS s, sum(qty * qty) AS q, sum(tax) AS st,
      sum(tax * tax) AS qt FROM pred GROUP BY 1),
    o AS (SELECT a.fold, sum(b.n) AS n, sum(b.s) AS s, sum(b.q) AS q, sum(b.st) AS st, sum(b.qt) AS qt FROM s a JOIN s b ON a.fold <> b.fold GROUP BY 1)
    SELECT subject, task, round((qty - s / n) / sqrt(q / n - (s / n) * (s / n)), 6) AS qty,
      round((tax - st / n) / sqrt(qt / n - (st / n) * (st / n)), 6) AS tax FROM pred JOIN o USING (fold)"""))
def _(t):
    z = b.standardize(t.pred.select("subject", "task", "fold", "qty", "tax"), ["qty", "tax"], "fold")
    return rounded(z.drop("fold"), ["qty", "tax"], 6)


@query("m4_impute_median", sql("gaps", """SELECT subject, task, round(coalesce(price, (SELECT median(price) FROM gaps)), 7) AS price,
    round(coalesce(tax, (SELECT median(tax) FROM gaps)), 7) AS tax FROM gaps"""))
def _(t):
    return rounded(b.impute_median(t.gaps.select("subject", "task", "price", "tax"), ["price", "tax"]), ["price", "tax"])


FOLDED = f"folded AS (SELECT *, CAST(floor({U('fold', 'subject')} * 5) + 1 AS INTEGER) AS fold FROM gaps)"


@query("m4_impute_median_by_fold", sql("gaps", f"""WITH {FOLDED}, m AS (SELECT f.fold, median(price) AS price, median(tax) AS tax FROM
    (SELECT DISTINCT fold FROM folded) f JOIN folded g ON g.fold <> f.fold GROUP BY 1) SELECT subject, task, round(coalesce(g.price, m.price), 7)
    AS price, round(coalesce(g.tax, m.tax), 7) AS tax FROM folded g JOIN m USING (fold)"""))
def _(t):
    from ..functions.scalars import uniform
    folded = t.gaps.withColumn("fold", (F.floor(uniform("fold", F.col("subject")) * 5) + 1).cast("int"))
    out = b.impute_median(folded.select("subject", "task", "fold", "price", "tax"), ["price", "tax"], "fold")
    return rounded(out.drop("fold"), ["price", "tax"])


@query("m5_one_hot", "SELECT o_orderkey, " + ", ".join(
    f"CAST(o_orderpriority = '{k}' AS INTEGER) AS \"o_orderpriority_{k}\"" for k in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
    + " FROM orders")
def _(t):
    return b.one_hot(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority").drop("o_orderpriority")


@query("m6_class_weights", """SELECT doc_id, toxic, round((SELECT count(*) FROM labels) / (2.0 * count(*) OVER (PARTITION BY toxic)), 7) AS weight
    FROM labels""")
def _(t):
    return rounded(b.class_weights(t.labels.select("doc_id", "toxic"), "toxic"), ["weight"])


RIDGE = """WITH s AS (SELECT fold, count(*) AS n, sum(qty) AS a, sum(tax) AS b, sum(hours) AS y, sum(qty * qty) AS aa, sum(tax * tax) AS bb,
      sum(qty * tax) AS ab, sum(qty * hours) AS ay, sum(tax * hours) AS b_y FROM pred GROUP BY 1),
    o AS (SELECT l.fold, sum(r.n) AS n, sum(r.a) AS a, sum(r.b) AS b, sum(r.y) AS y, sum(r.aa) AS aa, sum(r.bb) AS bb, sum(r.ab) AS ab,
      sum(r.ay) AS ay, sum(r.b_y) AS b_y FROM s l JOIN s r ON l.fold <> r.fold GROUP BY 1),
    c AS (SELECT fold, n, a / n AS ma, b / n AS mb, y / n AS my, sqrt(aa / n - (a / n) * (a / n)) AS sa, sqrt(bb / n - (b / n) * (b / n)) AS sb,
      ab - a * b / n AS cab, ay - a * y / n AS cay, b_y - b * y / n AS cby FROM o),
    z AS (SELECT *, cab / (sa * sb) AS g, cay / sa AS ga, cby / sb AS gb, n + 10.0 AS d FROM c),
    w AS (SELECT *, (d * ga - g * gb) / (d * d - g * g) AS wa, (d * gb - g * ga) / (d * d - g * g) AS wb FROM z)
    SELECT subject, task, round(my + wa * (qty - ma) / sa + wb * (tax - mb) / sb, 6) AS predicted FROM pred JOIN w USING (fold)"""


@query("m11_ridge", sql("pred", RIDGE))
def _(t):
    rows = t.pred.select("subject", "task", "fold", "qty", "tax", "hours")
    return rounded(lin.ridge(rows, ["qty", "tax"], "hours", 10.0, "fold").select("subject", "task", "predicted"), ["predicted"], 6)


def _inner(t):
    from ..functions.scalars import uniform
    inner = (F.floor(uniform("inner", F.col("subject")) * 3) + 1).cast("int")
    return t.pred.withColumn("inner", inner).select("subject", "task", "fold", "inner", "hours", *FEATURES)


@query("m11_ridge_path_one_penalty", sql("pred", RIDGE))
def _(t):
    """With one penalty to choose from, the path is the plain ridge."""
    rows = t.pred.select("subject", "task", "fold", "qty", "tax", "hours")
    out = lin.ridge_path(rows, ["qty", "tax"], "hours", "fold", alphas=[10.0])
    return rounded(out.select("subject", "task", "predicted"), ["predicted"], 6)


OUT_OF_FOLD_LINE = """s AS (SELECT l.fold, regr_slope(r.hours, r.qty) AS b, regr_intercept(r.hours, r.qty) AS a
    FROM (SELECT DISTINCT fold FROM {t}) l JOIN {t} r ON l.fold <> r.fold GROUP BY 1)"""


@query("m13_pls_one_feature", sql("pred", "WITH " + OUT_OF_FOLD_LINE.format(t="pred")
                                  + " SELECT subject, task, round(a + b * qty, 6) AS predicted FROM pred JOIN s USING (fold)"))
def _(t):
    """With one feature the first component is the least-squares line."""
    rows = _inner(t).select("subject", "task", "fold", "inner", "hours", "qty")
    out = lin.pls_regression(rows, ["qty"], "hours", "fold", "inner")
    return rounded(out.select("subject", "task", "predicted"), ["predicted"], 6)


@query("m11_ridge_path")
def _(t):
    """Ridge with the penalty chosen by leave-one-out error in each train set."""
    return lin.ridge_path(_inner(t), FEATURES, "hours", "fold")


@query("m12_elastic_net_search")
def _(t):
    return lin.elastic_net_search(_inner(t), FEATURES, "hours", "fold", "inner")


@query("m13_pls_regression")
def _(t):
    return lin.pls_regression(_inner(t), FEATURES, "hours", "fold", "inner")


# ---- evaluation --------------------------------------------------------------------------------

ERRORS = """count(*) AS n, round(sqrt(avg((actual - predicted) * (actual - predicted))), 7) AS rmse,
    round(avg(abs(actual - predicted)), 7) AS mae,
    round(1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(actual)), 7) AS r2"""


@query("e1_regression_metrics", sql("pred", f"SELECT {ERRORS} FROM pred"))
def _(t):
    return rounded(e.regression_metrics(t.pred), ["rmse", "mae", "r2"])


BINARY = """count(*) AS n, round(avg(CAST(actual_label = predicted_label AS INT)), 7) AS accuracy,
    round(coalesce(count(*) FILTER (WHERE actual_label = 'Short' AND predicted_label = 'Short') / nullif(count(*) FILTER (WHERE predicted_label = 'Short'), 0), 0), 7) AS precision,
    round(coalesce(count(*) FILTER (WHERE actual_label = 'Short' AND predicted_label = 'Short') / nullif(count(*) FILTER (WHERE actual_label = 'Short'), 0), 0), 7) AS recall,
    round(coalesce(2 * count(*) FILTER (WHERE actual_label = 'Short' AND predicted_label = 'Short')
      / nullif(count(*) FILTER (WHERE predicted_label = 'Short') + count(*) FILTER (WHERE actual_label = 'Short'), 0), 0), 7) AS f1"""
SHARES = ["accuracy", "precision", "recall", "f1"]


@query("e2_fold_metrics", sql("pred", f"SELECT fold, {BINARY} FROM pred GROUP BY fold"))
def _(t):
    return rounded(e.fold_metrics(t.pred, "Short"), SHARES)


@query("e2_fold_errors", sql("pred", f"SELECT fold, {ERRORS} FROM pred GROUP BY fold"))
def _(t):
    return rounded(e.regression_metrics(t.pred, ["fold"]), ["rmse", "mae", "r2"])


@query("e3_null_baseline", sql("pred", """SELECT round(stddev_pop(actual), 7) AS null_rmse,
    round(sqrt(avg((actual - predicted) * (actual - predicted))), 7) AS rmse,
    round(stddev_pop(actual) - sqrt(avg((actual - predicted) * (actual - predicted))), 7) AS gain FROM pred"""))
def _(t):
    return rounded(e.null_baseline(t.pred), ["null_rmse", "rmse", "gain"])


@query("e4_prediction_range", sql("pred", """SELECT task, round(covar_samp(actual, predicted) / nullif(stddev_samp(actual)
    * stddev_samp(predicted), 0), 7) AS pearson_r, min(predicted) AS prediction_min, max(predicted) AS prediction_max FROM pred GROUP BY 1"""))
def _(t):
    return rounded(e.prediction_range(t.pred, ["task"]), ["pearson_r"])


@query("e5_binary_metrics", sql("pred", f"SELECT task, {BINARY} FROM pred GROUP BY task"))
def _(t):
    return rounded(e.binary_metrics(t.pred, "Short", ["task"]), SHARES)


REPORT = """WITH l AS (SELECT unnest(['Short', 'Normal', 'Long', 'Never']) AS label),
    c AS (SELECT label, count(*) FILTER (WHERE actual_label = label AND predicted_label = label) AS h,
      count(*) FILTER (WHERE predicted_label = label) AS s, count(*) FILTER (WHERE actual_label = label) AS a FROM l, pred GROUP BY 1),
    r AS (SELECT label, coalesce(h / nullif(s, 0), 0) AS p, coalesce(h / nullif(a, 0), 0) AS c, coalesce(2 * h / nullif(s + a, 0), 0) AS f, a FROM c),
    every AS (SELECT label, p, c, f, a FROM r UNION ALL SELECT 'accuracy', x, x, x, n FROM (SELECT avg(CAST(actual_label = predicted_label AS INT)) AS x,
      count(*) AS n FROM pred) UNION ALL SELECT 'macro avg', avg(p), avg(c), avg(f), sum(a) FROM r
      UNION ALL SELECT 'weighted avg', sum(p * a) / sum(a), sum(c * a) / sum(a), sum(f * a) / sum(a), sum(a) FROM r)
    SELECT label, round(p, 7) AS precision, round(c, 7) AS recall, round(f, 7) AS f1, CAST(a AS BIGINT) AS support FROM every"""


@query("e6_classification_report", sql("pred", REPORT))
def _(t):
    return rounded(e.classification_report(t.pred, [*LABELS, "Never"]), ["precision", "recall", "f1"])


@query("e7_confusion_matrix", sql("pred", """SELECT label AS actual, """ + ", ".join(
    f"count(*) FILTER (WHERE actual_label = label AND predicted_label = '{k}') AS pred_{k}" for k in [*LABELS, "Never"])
    + " FROM (SELECT unnest(['Short', 'Normal', 'Long', 'Never']) AS label), pred GROUP BY 1"))
def _(t):
    return e.confusion_matrix(t.pred, [*LABELS, "Never"])


def vote_sql(src: str, key: str, mass: dict[str, str], carry: str) -> str:
    """Votes per class with score sums, winner by votes, mass, label."""
    counts = ", ".join(f"count(*) FILTER (WHERE predicted_label = '{k}') AS \"votes_{k}\"" for k in LABELS)
    sums = ", ".join(f"round(sum({mass[k]}), 4) AS mass_{k}" for k in LABELS)
    return f"SELECT {key}, {counts}, {sums}, {carry} FROM {src} GROUP BY {key}"


def winner_sql() -> str:
    rows = ", ".join(f"{{'v': -\"votes_{k}\", 'm': -mass_{k}, 'label': '{k}'}}" for k in LABELS)
    return f"(list_sort([{rows}])[1]).label"


@query("e8_majority_vote", sql("pred", f"""WITH v AS ({vote_sql('pred', 'subject', SCORES, 'min(actual_label) AS actual_label, count(*) AS num_stimuli')})
    SELECT subject, "votes_Short", "votes_Normal", "votes_Long", actual_label, num_stimuli, {winner_sql()} AS predicted_label FROM v"""))
def _(t):
    others = [F.min("actual_label").alias("actual_label"), F.count(F.lit(1)).alias("num_stimuli")]
    return e.majority_vote(t.pred, ["subject"], LABELS, scores=SCORES, others=others)


WINDOW_PRED = """wp AS (SELECT o_custkey AS subject, o_orderpriority AS task, l_linenumber, l_partkey,
    CASE WHEN c_acctbal < 7000 THEN 'LowSleep' ELSE 'HigherSleep' END AS actual_label,
    CASE WHEN l_quantity < 25 THEN 'LowSleep' ELSE 'HigherSleep' END AS predicted_label,
    CAST(round(l_tax * 100) AS BIGINT) AS p_low, CAST(8 - round(l_tax * 100) AS BIGINT) AS p_high
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey)"""


def _window_pred(t):
    lines = t.lineitem.select("l_orderkey", "l_quantity", "l_tax")
    heads = t.orders.select("o_orderkey", F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("task"))
    cust = t.customer.select(F.col("c_custkey").alias("subject"),
                             F.when(F.col("c_acctbal") < 7000, "LowSleep").otherwise("HigherSleep").alias("actual_label"))
    low = F.round(F.col("l_tax") * 100).cast("long")
    return lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, "subject").select(
        "subject", "task", "actual_label", F.when(F.col("l_quantity") < 25, "LowSleep").otherwise("HigherSleep").alias("predicted_label"),
        low.alias("p_low"), (8 - low).alias("p_high"))


SLEEP = ["LowSleep", "HigherSleep"]
STAGES = f"""WITH {WINDOW_PRED}, a AS (SELECT subject, task, min(actual_label) AS actual_label, count(*) AS num_windows,
      count(*) FILTER (WHERE predicted_label = 'LowSleep') AS lo, count(*) FILTER (WHERE predicted_label = 'HigherSleep') AS hi,
      sum(p_low) AS ml, sum(p_high) AS mh FROM wp GROUP BY 1, 2),
    seg AS (SELECT *, CASE WHEN lo > hi OR (lo = hi AND ml > mh) THEN 'LowSleep' ELSE 'HigherSleep' END AS predicted_label FROM a),
    s AS (SELECT subject, min(actual_label) AS actual_label, count(*) AS num_stimuli, CAST(sum(num_windows) AS BIGINT) AS num_windows,
      count(*) FILTER (WHERE predicted_label = 'LowSleep') AS "votes_LowSleep",
      count(*) FILTER (WHERE predicted_label = 'HigherSleep') AS "votes_HigherSleep", sum(lo) AS ml, sum(hi) AS mh FROM seg GROUP BY 1)"""


@query("e9_two_stage_vote", f"""{STAGES} SELECT subject, actual_label, num_stimuli, num_windows, "votes_LowSleep", "votes_HigherSleep",
    CASE WHEN "votes_LowSleep" > "votes_HigherSleep" OR ("votes_LowSleep" = "votes_HigherSleep" AND ml > mh) THEN 'LowSleep'
    ELSE 'HigherSleep' END AS predicted_label FROM s""")
def _(t):
    _, subjects = e.two_stage_vote(_window_pred(t), ["subject", "task"], ["subject"], SLEEP,
                                   {"LowSleep": "p_low", "HigherSleep": "p_high"})
    return subjects


@query("e9_segment_stage", f"""{STAGES} SELECT subject, task, actual_label, num_windows, lo AS "votes_LowSleep", hi AS "votes_HigherSleep",
    predicted_label FROM seg""")
def _(t):
    segments, _ = e.two_stage_vote(_window_pred(t), ["subject", "task"], ["subject"], SLEEP,
                                   {"LowSleep": "p_low", "HigherSleep": "p_high"})
    return segments


@query("e10_subject_aggregate", sql("pred", """SELECT subject, round(avg(predicted), 7) AS mean_prediction, round(median(predicted), 7) AS median_prediction,
    min(actual) AS actual, count(*) AS num_stimuli FROM pred GROUP BY 1"""))
def _(t):
    return rounded(e.subject_aggregate(t.pred), ["mean_prediction", "median_prediction"])


@query("e11_outcome_table", sql("pred", "SELECT subject, task, actual_label, predicted_label, actual_label = predicted_label AS correct FROM pred"))
def _(t):
    return e.outcome_table(t.pred.select("subject", "task", "actual_label", "predicted_label"))


@query("a38_prediction_crosstab", sql("pred", "SELECT task, actual_label, predicted_label, count(*) AS count FROM pred GROUP BY 1, 2, 3"))
def _(t):
    return e.prediction_crosstab(t.pred)


@query("a38_prediction_by_task", sql("pred", "SELECT task, " + ", ".join(
    f"count(*) FILTER (WHERE predicted_label = '{k}') AS \"{k}\"" for k in LABELS) + " FROM pred GROUP BY 1"))
def _(t):
    return e.prediction_by_task(t.pred, LABELS)


@query("w7_vote_rank", sql("pred", """WITH v AS (SELECT subject, predicted_label, count(*) AS votes, round(sum(p_short), 4) AS mass FROM pred GROUP BY 1, 2)
    SELECT subject, predicted_label, votes, mass FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY votes DESC, mass DESC, predicted_label)
    AS r FROM v) WHERE r = 1"""))
def _(t):
    votes = t.pred.groupBy("subject", "predicted_label").agg(F.count(F.lit(1)).alias("votes"), F.round(F.sum("p_short"), 4).alias("mass"))
    return e.vote_rank(votes, ["subject"], "predicted_label", "votes", "mass")


MODELS = """two AS (SELECT 'rule' AS model, subject, task, actual, predicted FROM pred UNION ALL
    SELECT 'four' AS model, subject, task, actual, 4.0 AS predicted FROM pred)"""


def _two(t):
    rows = t.pred.select("subject", "task", "actual", "predicted")
    return rows.withColumn("model", F.lit("rule")).unionByName(
        rows.withColumn("predicted", F.lit(4.0)).withColumn("model", F.lit("four")))


@query("t6_pick_best", sql("pred", f"""WITH {MODELS}, best AS (SELECT model FROM two GROUP BY 1 ORDER BY
    round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)), 7) DESC, round(sqrt(avg((actual - predicted) ** 2)), 7), model LIMIT 1)
    SELECT model, subject, task, actual, CAST(predicted AS DOUBLE) AS predicted FROM two WHERE model IN (SELECT model FROM best)"""))
def _(t):
    both = _two(t)
    metrics = rounded(e.regression_metrics(both, ["model"]), ["r2", "rmse"])
    return e.pick_best(metrics, both, ["model"], ["r2"], ["rmse"])


THRESHOLDS = [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50]
NESTED = f"""nested AS (SELECT doc_id, outer_fold, toxic, score FROM scored, range(1, 6) g(outer_fold)
      WHERE CAST(floor({U('outer', 'doc_id')} * 5) + 1 AS INTEGER) <> outer_fold),
    cs AS (SELECT *, unnest([0.5, 1.0, 2.0]) AS c FROM nested),
    st AS (SELECT outer_fold, toxic, c, least(score * c, 1) AS s FROM cs),
    cells AS (SELECT outer_fold, c, threshold, count(*) FILTER (WHERE s >= threshold AND toxic = 1) AS tp,
      count(*) FILTER (WHERE s >= threshold) AS said, count(*) FILTER (WHERE toxic = 1) AS there,
      count(*) FILTER (WHERE (s >= threshold) = (toxic = 1)) AS correct, count(*) AS n
      FROM st, (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold) GROUP BY 1, 2, 3),
    tab AS (SELECT outer_fold, c::DOUBLE AS c, threshold, coalesce(2 * tp / nullif(said + there, 0), 0) AS f1, coalesce(tp / nullif(said, 0), 0) AS precision,
      coalesce(tp / nullif(there, 0), 0) AS recall, correct / n AS accuracy FROM cells)"""


def _nested(t):
    from ..functions.scalars import uniform
    own = (F.floor(uniform("outer", F.col("doc_id")) * 5) + 1).cast("int")
    outer = F.explode(F.array(*[F.lit(i) for i in range(1, 6)]))
    rows = t.scored.select("doc_id", "toxic", "score", own.alias("own")).withColumn("outer_fold", outer).where("own <> outer_fold")
    scores = rows.withColumn("c", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))))
    return scores.select("outer_fold", "c", (F.col("toxic") == 1).alias("is_positive"),
                         F.least(F.col("score") * F.col("c"), F.lit(1.0)).alias("score"))


@query("m22_threshold_table", sql("scored", f"""WITH {NESTED} SELECT CAST(outer_fold AS INTEGER) AS outer_fold, c, threshold, round(f1, 7) AS f1,
    round(precision, 7) AS precision, round(recall, 7) AS recall, round(accuracy, 7) AS accuracy FROM tab"""))
def _(t):
    return rounded(e.threshold_table(_nested(t), THRESHOLDS, ["outer_fold", "c"]), SHARES)


@query("m22_tune_threshold", sql("scored", f"""WITH {NESTED} SELECT CAST(outer_fold AS INTEGER) AS outer_fold, c, threshold, round(f1, 7) AS f1,
    round(precision, 7) AS precision, round(recall, 7) AS recall, round(accuracy, 7) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY
    outer_fold ORDER BY f1 DESC, recall DESC, accuracy DESC, c, threshold) AS r FROM tab) WHERE r = 1"""))
def _(t):
    return rounded(e.tune_threshold(_nested(t), THRESHOLDS, ["outer_fold", "c"], ["outer_fold"]), SHARES)


@query("x6_label_counts", sql("pred", "SELECT actual_label, count(*) AS n FROM pred GROUP BY 1"))
def _(t):
    return t.obs.groupBy(bin_label(F.col("hours")).alias("actual_label")).agg(F.count(F.lit(1)).alias("n")).where("actual_label IS NOT NULL")
