"""Learned models, clusters and the flows built on them, on the given tables."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..functions.scalars import bin_label, uniform
from ..operators import agglomerate as ag
from ..operators import baselines as b
from ..operators import groups as g
from ..operators import models as m
from ..operators.evaluate import binary_metrics, regression_metrics, subject_aggregate
from ..operators.folds import group_kfold, kfold
from ..operators.kernel import rbf_classifier_cv, rbf_regressor_cv
from ..operators.kmeans import assign as nearest_centre
from ..operators.kmeans import best_of_starts
from ..operators.logistic import logistic_cv
from ..operators.scale import materialise
from ..operators.tiles import euclidean_silhouette
from ..sources.writers import load_model, save_model
from .proxies import BASELINE, FAMILIES, FEATURES, LABELS, U, rounded, sql
from .registry import query
from .signal import signal_verdict
from .tuning import PENALTIES, THRESHOLDS, nested_tuning
from .views import build_views, compare_views
from .voting import vote_cv

TREES, DEPTH, ROUNDS = 10, 5, 5  # small, for run time; every operator takes the full settings


def _folded(t, k: int = 3):
    rows = t.subj.select("subject", "hours", *FEATURES)
    return kfold(rows, k, 42, ["subject"])


def _toxic(t, k: int = 3):
    fold = (F.floor(uniform("fold", F.col("doc_id")) * k) + 1).cast("int")
    rows = t.scored.select("doc_id", F.col("toxic").cast("double").alias("toxic"), "len", "words",
                           F.col("quality").cast("double").alias("quality"), fold.alias("fold"))
    return materialise(rows)


DOC = ["len", "words", "quality"]


def _as_regression(p):
    return rounded(regression_metrics(p.select(F.col("hours").alias("actual"), F.col("prediction").alias("predicted"))),
                   ["rmse", "mae", "r2"], 6)


def _as_classes(p):
    out = p.select(F.col("toxic").cast("int").alias("actual_label"), F.col("prediction").cast("int").alias("predicted_label"))
    return rounded(binary_metrics(out, 1), ["accuracy", "precision", "recall", "f1"], 6)


# Learned numbers have no SQL; what must hold of any fit does: every row is predicted once, by folds that share no
# subject, within the range of the labels or with probabilities that add up to one.

def _once(p, key: str, wrong):
    return p.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"), F.count_if(wrong).alias("wrong"))


HOURS_ONCE = sql("subj", "SELECT count(*) AS rows, count(DISTINCT subject) AS keys, CAST(0 AS BIGINT) AS wrong FROM subj")
TOXIC_ONCE = sql("scored", "SELECT count(*) AS rows, count(DISTINCT doc_id) AS keys, CAST(0 AS BIGINT) AS wrong FROM scored")


def _within(t, p, column: str = "prediction"):
    low, high = t.subj.agg(F.min("hours"), F.max("hours")).first()
    return _once(p, "subject", ~F.col(column).between(low - 1e-9, high + 1e-9))


def _proper(p):
    probability = vector_to_array("probability")
    total = F.aggregate(probability, F.lit(0.0), lambda a, x: a + x)
    fits = (F.abs(total - 1) < 1e-9) & F.forall(probability, lambda x: x.between(0, 1)) & F.col("prediction").isin(0.0, 1.0)
    return _once(p, "doc_id", ~fits)


@query("m7_rf_regressor_rows", HOURS_ONCE)
def _(t):
    return _within(t, m.cross_val_predict(m.rf_regressor(FEATURES, "hours", TREES, 3, depth=DEPTH), _folded(t), "fold"))


@query("m8_rf_classifier_rows", TOXIC_ONCE)
def _(t):
    est = m.rf_classifier(DOC, "toxic", TREES, depth=DEPTH)
    return _proper(m.cross_val_predict(est, _toxic(t), "fold", prepare=m.weigh_train("toxic")))


@query("m10_gbt_classifier_rows", TOXIC_ONCE)
def _(t):
    return _proper(m.cross_val_predict(m.gbt_classifier(DOC, "toxic", ROUNDS), b.class_weights(_toxic(t), "toxic"), "fold"))


@query("m14_logistic_balanced_rows", TOXIC_ONCE)
def _(t):
    est = lambda train: m.logistic_balanced(train, DOC, "toxic", 1.0)
    return _proper(m.cross_val_predict(est, _toxic(t), "fold", prepare=m.weigh_train("toxic")))


CELL = "len >= 1500"
ONE_CELL = f"""x AS (SELECT doc_id, toxic, CAST({CELL} AS INTEGER) AS b, CAST(floor({U('fold', 'doc_id')} * 3) + 1 AS INTEGER) AS fold FROM scored),
    f AS (SELECT l.fold, l.b, count(*) FILTER (toxic = 1 AND r.b = l.b) / count(*) FILTER (toxic = 1)::DOUBLE AS p,
      count(*) FILTER (toxic = 0 AND r.b = l.b) / count(*) FILTER (toxic = 0)::DOUBLE AS q
      FROM (SELECT DISTINCT fold, b FROM x) l JOIN x r ON l.fold <> r.fold GROUP BY 1, 2)"""


@query("m14_logistic_of_one_cell", sql("scored", f"WITH {ONE_CELL} SELECT doc_id, fold, round(p / (p + q), 5) AS score FROM x JOIN f USING (fold, b)"))
def _(t):
    """Without a penalty, the probability in each cell of one 0/1 feature is the balanced share of label 1 in the other folds."""
    rows = materialise(_toxic(t).withColumn("b", F.expr(CELL).cast("double")))
    return logistic_cv(rows, ["b"], "toxic", "fold", c=1e9).select("doc_id", "fold", F.round("score", 5).alias("score"))


@query("m14_logistic_one_row_out")
def _(t):
    """As many folds as documents, in the same scans."""
    rows = materialise(_toxic(t).drop("fold").withColumn("fold", F.col("doc_id")))
    return logistic_cv(rows, DOC, "toxic", "fold").select("doc_id", F.round("score", 6).alias("score"))


def _line():
    return Pipeline(stages=[m.assemble(["qty"]), LinearRegression(labelCol="hours", solver="normal")])


FOLDED = f"""folded AS (SELECT *, CAST((row_number() OVER (ORDER BY {U(42, 'subject')}, subject) - 1) % 3 + 1 AS INTEGER) AS fold FROM subj),
    line AS (SELECT l.fold, regr_slope(r.hours, r.qty) AS b, regr_intercept(r.hours, r.qty) AS a, avg(r.hours) AS mean
      FROM (SELECT DISTINCT fold FROM folded) l JOIN folded r ON l.fold <> r.fold GROUP BY 1)"""


@query("m19_cross_val_predict_line", sql("subj", f"WITH {FOLDED} SELECT subject, fold, round(a + b * qty, 6) AS predicted FROM folded JOIN line USING (fold)"))
def _(t):
    """Out-of-fold predictions of a least-squares line."""
    p = m.cross_val_predict(_line(), _folded(t), "fold")
    return p.select("subject", "fold", F.round("prediction", 6).alias("predicted"))


@query("m20_compare_line", sql("subj", f"""WITH {FOLDED}, p AS (SELECT hours AS actual, unnest(['Line', 'DummyMean']) AS model,
      unnest([a + b * qty, mean]) AS predicted FROM folded JOIN line USING (fold))
    SELECT model, count(*) AS n, round(sqrt(avg((actual - predicted) ** 2)), 6) AS rmse, round(avg(abs(actual - predicted)), 6) AS mae,
      round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)), 6) AS r2 FROM p GROUP BY 1"""))
def _(t):
    out = m.compare_regressors({"Line": _line()}, materialise(_folded(t)), "hours", "fold")
    return rounded(out.select("model", "n", "rmse", "mae", "r2"), ["rmse", "mae", "r2"], 6)


CELLS_OF_HOURS = "c AS (SELECT l.fold, l.b, avg(r.hours) AS p FROM (SELECT DISTINCT fold, qty >= 25 AS b FROM folded) l JOIN folded r ON l.fold <> r.fold AND l.b = (r.qty >= 25) GROUP BY 1, 2)"
HOURS_BY_CELL = sql("subj", f"WITH {FOLDED}, {CELLS_OF_HOURS} SELECT subject, fold, round(p, 6) AS predicted FROM folded f JOIN c USING (fold) WHERE c.b = (f.qty >= 25)")


def _hours_by_cell(t, est):
    p = m.cross_val_predict(est, _folded(t).withColumn("b", (F.col("qty") >= 25).cast("double")), "fold")
    return p.select("subject", "fold", F.round("prediction", 6).alias("predicted"))


@query("m7_forest_of_one_tree", HOURS_BY_CELL)
def _(t):
    """One tree on one 0/1 feature answers with the mean of the other folds' rows in the same cell."""
    return _hours_by_cell(t, m.rf_regressor(["b"], "hours", 1, depth=1, bootstrap=False))


@query("m9_boosting_of_one_round", HOURS_BY_CELL)
def _(t):
    """So does the first round of boosting, which sees all rows."""
    return _hours_by_cell(t, m.gbt_regressor(["b"], "hours", 1, depth=1, frac=1.0))


@query("m8_forest_of_one_tree", sql("scored", f"WITH {ONE_CELL} SELECT doc_id, fold, round(p / (p + q), 6) AS score FROM x JOIN f USING (fold, b)"))
def _(t):
    """One tree on one 0/1 feature answers with the balanced share of label 1 among the other folds' rows in the same cell."""
    rows = _toxic(t).withColumn("b", F.expr(CELL).cast("double"))
    p = m.cross_val_predict(m.rf_classifier(["b"], "toxic", 1, depth=1, bootstrap=False), rows, "fold", prepare=m.weigh_train("toxic"))
    return m.positive_probability(p).select("doc_id", "fold", F.round("score", 6).alias("score"))


@query("m10_boosting_of_one_round", sql("scored", f"""WITH {ONE_CELL}, w AS (SELECT count(*) / (2.0::DOUBLE * count(*) FILTER (toxic = 1)) AS up,
      count(*) / (2.0::DOUBLE * count(*) FILTER (toxic = 0)) AS down FROM x),
    v AS (SELECT l.fold, l.b, sum(CASE WHEN toxic = 1 THEN up ELSE -down END) AS v FROM (SELECT DISTINCT fold, b FROM x) l JOIN x r ON l.fold <> r.fold AND l.b = r.b, w GROUP BY 1, 2)
    SELECT doc_id, fold, CAST(v > 0 AS INTEGER) AS predicted FROM x JOIN v USING (fold, b)"""))
def _(t):
    """The first round votes by the weighted labels of the other folds' rows in the same cell; weights from all rows."""
    rows = b.class_weights(_toxic(t), "toxic").withColumn("b", F.expr(CELL).cast("double"))
    p = m.cross_val_predict(m.gbt_classifier(["b"], "toxic", 1, depth=1, frac=1.0), rows, "fold")
    return p.select("doc_id", "fold", F.col("prediction").cast("int").alias("predicted"))


ONE_FEATURE = """s AS (SELECT l.fold, avg(r.hours) AS my, avg(r.qty) AS mx, stddev_pop(r.qty) AS sx, covar_pop(r.qty, r.hours) / stddev_pop(r.qty) AS g,
      1 + 0.005 * stddev_samp(r.hours) / stddev_pop(r.hours) AS c FROM (SELECT DISTINCT fold FROM folded) l JOIN folded r ON l.fold <> r.fold GROUP BY 1)"""


@query("m12_elastic_net_one_feature", sql("subj", f"""WITH {FOLDED}, {ONE_FEATURE} SELECT subject, round(my + sign(g) * greatest(abs(g) - 0.005, 0)
    / c * (qty - mx) / sx, 5) AS predicted FROM folded JOIN s USING (fold)"""))
def _(t):
    """With one feature the slope is the soft-thresholded covariance."""
    est = lambda train: m.elastic_net(train, ["qty"], "hours", 0.01, 0.5)
    p = m.cross_val_predict(est, _folded(t), "fold")
    return p.select("subject", F.round("prediction", 5).alias("predicted"))


@query("m23_final_importances", "SELECT 'hours' AS model, CAST(4 AS BIGINT) AS features, 1.0::DOUBLE AS total FROM (SELECT count(*) FROM orders) UNION ALL SELECT 'category', 4, 1.0")
def _(t):
    """The importances of either final model add up to one over all features."""
    stages = _final(t).stages
    rows = [(kind, len(w), round(float(sum(w)), 9)) for kind, s in (("hours", stages[1]), ("category", stages[2]))
            for w in [s.featureImportances.toArray()]]
    return t.spark.createDataFrame(rows, "model string, features long, total double")


@query("m24_predict_batch_rows", HOURS_ONCE)
def _(t):
    out = m.predict_batch(_final(t), t.subj.select("subject", *FEATURES))
    return _once(out, "subject", ~F.col("predicted_category").isin(*LABELS) | F.col("predicted_label").isNull() | F.col("predicted_hours").isNull())


@query("s11_saved_model_agrees", HOURS_ONCE)
def _(t):
    """Rows on which the saved and the fitted model differ: none."""
    from .files import new_folder
    model, path, rows = _final(t), new_folder(t.spark, "model"), t.subj.select("subject", *FEATURES)
    save_model(model, path)
    both = m.predict_batch(model, rows).select("subject", "predicted_hours", "predicted_category").join(
        m.predict_batch(load_model(path), rows).select("subject", F.col("predicted_hours").alias("h"), F.col("predicted_category").alias("c")), "subject")
    return _once(both, "subject", (F.col("predicted_hours") != F.col("h")) | (F.col("predicted_category") != F.col("c")))


CLUSTERS = sql("subj", "SELECT count(*) AS rows, count(DISTINCT subject) AS keys, CAST(0 AS BIGINT) AS wrong, CAST(3 AS BIGINT) AS clusters FROM subj")


def _clustered(out):
    """Every subject in one of three clusters, and none nearer to the others' centres on the whole than to its own."""
    wide = out.withColumn("x", vector_to_array("features"))
    centres = wide.groupBy("cluster").agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(len(FEATURES))]).alias("centre"))
    cost = lambda c: F.aggregate(F.zip_with("x", c, lambda a, b_: (a - b_) * (a - b_)), F.lit(0.0), lambda s, v: s + v)
    mean = wide.agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(len(FEATURES))]).alias("mean"))
    sums = wide.join(F.broadcast(centres), "cluster").join(F.broadcast(mean), F.lit(True)).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("subject").alias("keys"),
        (F.sum(cost("centre")) >= F.sum(cost("mean"))).cast("long").alias("wrong"), F.count_distinct("cluster").alias("clusters"))
    return sums


@query("m25_kmeans_rows", CLUSTERS)
def _(t):
    return _clustered(m.kmeans(t.subj.select("subject", "hours", *FEATURES), FEATURES, 3))


@query("m25_kmeans_of_one_feature", sql("subj", """WITH r AS (SELECT qty, (qty - avg(qty) OVER ()) / stddev_samp(qty) OVER () AS x FROM subj),
    u AS (SELECT x, count(*) OVER w AS n, sum(x) OVER w AS s, count(*) OVER () AS all_n, sum(x) OVER () AS all_s, sum(x * x) OVER () AS q
      FROM r WINDOW w AS (ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    c AS (SELECT q - s * s / n - CASE WHEN n < all_n THEN (all_s - s) ** 2 / (all_n - n) ELSE 0 END AS cost, n, all_n FROM u)
    SELECT round(min(cost), 5) AS cost, max(greatest(n, all_n - n)) FILTER (cost <= (SELECT min(cost) FROM c) + 1e-9) AS larger FROM c"""))
def _(t):
    """The best split of one feature in two, which sums in order of the feature give exactly."""
    points = materialise(ag.standard_points(t.subj, ["qty"]))
    centres, cost = best_of_starts(points, 2, tol=0.0)
    sizes = nearest_centre(points, centres).groupBy("cluster").count()
    return sizes.agg(F.round(F.lit(cost), 5).alias("cost"), F.max("count").alias("larger"))


@query("m26_hierarchical_rows", CLUSTERS)
def _(t):
    return _clustered(m.hierarchical_clusters(t.subj.select("subject", "hours", *FEATURES), FEATURES, 3))


WARD_Z = """z AS (SELECT subject, """ + ", ".join(f"({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER () AS {f}" for f in FEATURES) + " FROM subj)"


@query("m26_ward_tree", sql("subj", f"""WITH {WARD_Z}, d AS (SELECT DISTINCT qty, price, disc, tax FROM z),
    near AS (SELECT min(sqrt((a.qty - b.qty) ** 2 + (a.price - b.price) ** 2 + (a.disc - b.disc) ** 2 + (a.tax - b.tax) ** 2)) AS least
      FROM z a JOIN z b ON a.subject < b.subject)
    SELECT (SELECT count(*) FROM d) - 1 AS merges, (SELECT count(*) FROM z) AS top_size, round((SELECT least FROM near), 6) AS lowest,
      round((SELECT sum(qty ** 2 + price ** 2 + disc ** 2 + tax ** 2) FROM z), 4) AS total"""))
def _(t):
    """Of Ward's tree: its merges, what the last one holds, the height of the first one (the least distance of two subjects), and
    the cost that all merges and the leaves add up to, which is the whole sum of squares."""
    points = materialise(ag.standard_points(t.subj, FEATURES))
    tree = ag.ward_tree(points)
    return ag.merge_table(tree, points).agg(
        F.count(F.lit(1)).alias("merges"), F.max("size").alias("top_size"), F.round(F.min("height"), 6).alias("lowest"),
        F.round(F.sum(F.col("height") * F.col("height")) / 2 + F.lit(tree.lost), 4).alias("total"))


@query("m26_ward_merges")
def _(t):
    """The merge table of Ward's tree over the subjects."""
    points = materialise(ag.standard_points(t.subj, FEATURES))
    return rounded(ag.merge_table(ag.ward_tree(points), points), ["height"], 6)


@query("m27_pca_of_two", sql("subj", """WITH z AS (SELECT subject, (qty - avg(qty) OVER ()) / stddev_samp(qty) OVER () AS a,
      (price - avg(price) OVER ()) / stddev_samp(price) OVER () AS b, sign(corr(qty, price) OVER ()) AS s FROM subj)
    SELECT subject, round((a + s * b) ** 2 / 2, 6) AS first, round((a - s * b) ** 2 / 2, 6) AS second FROM z"""))
def _(t):
    """The components of two features are their sum and difference; squares do away with the signs."""
    pcs = m.pca(t.subj.select("subject", *FEATURES), ["qty", "price"], 2)
    return pcs.select("subject", F.round(F.pow("pc1", F.lit(2)), 6).alias("first"), F.round(F.pow("pc2", F.lit(2)), 6).alias("second"))


@query("m7_rf_regressor")
def _(t):
    return _as_regression(m.cross_val_predict(m.rf_regressor(FEATURES, "hours", TREES, 3, depth=DEPTH), _folded(t), "fold"))


@query("m8_rf_classifier")
def _(t):
    est = m.rf_classifier(DOC, "toxic", TREES, depth=DEPTH)
    return _as_classes(m.cross_val_predict(est, _toxic(t), "fold", prepare=m.weigh_train("toxic")))


@query("m9_gbt_regressor")
def _(t):
    return _as_regression(m.cross_val_predict(m.gbt_regressor(FEATURES, "hours", ROUNDS), _folded(t), "fold"))


@query("m10_gbt_classifier")
def _(t):
    """Weights from all rows, as one of the two modes; the other is weigh_train."""
    rows = b.class_weights(_toxic(t), "toxic")
    return _as_classes(m.cross_val_predict(m.gbt_classifier(DOC, "toxic", ROUNDS), rows, "fold"))


@query("m12_elastic_net")
def _(t):
    est = lambda train: m.elastic_net(train, FEATURES, "hours", 0.1, 0.5)
    p = m.cross_val_predict(est, _folded(t), "fold")
    return p.select("subject", "fold", "hours", F.round("prediction", 6).alias("predicted"))


@query("m14_logistic_balanced")
def _(t):
    return logistic_cv(_toxic(t), DOC, "toxic", "fold").select("doc_id", "fold", "toxic", F.round("score", 6).alias("score"))


def _gaps(fold_gaps):
    """What must hold of a settled support vector machine: its objective is the dual one, whose variables balance, to a thousandth of it."""
    wrong = (F.abs("gap") > 0.001 * F.col("objective")) | (F.abs("balance") > 0.001 * F.col("objective"))
    return fold_gaps.agg(F.count(F.lit(1)).alias("folds"), F.count_if(wrong).alias("wrong"))


@query("m15_rbf_margin_classifier")
def _(t):
    """Out-of-fold margins of a balanced support vector classifier on Nyström features of all labelled documents."""
    rows, _ = rbf_classifier_cv(b.standardize(_toxic(t), DOC, "fold"), DOC, "toxic", "fold")
    return _as_classes(rows)


@query("m15_rbf_margin_classifier_gaps", sql("scored", "SELECT CAST(3 AS BIGINT) AS folds, count(*) FILTER (toxic IS NULL) AS wrong FROM scored"))
def _(t):
    return _gaps(rbf_classifier_cv(b.standardize(_toxic(t), DOC, "fold"), DOC, "toxic", "fold")[1])


@query("m16_rbf_regressor")
def _(t):
    """Out-of-fold support vector regression of the subjects' label on Nyström features."""
    rows, _ = rbf_regressor_cv(b.standardize(_folded(t), FEATURES, "fold"), FEATURES, "hours", "fold")
    return _as_regression(rows)


@query("m16_rbf_regressor_gaps", sql("subj", "SELECT CAST(3 AS BIGINT) AS folds, count(*) FILTER (hours IS NULL) AS wrong FROM subj"))
def _(t):
    return _gaps(rbf_regressor_cv(b.standardize(_folded(t), FEATURES, "fold"), FEATURES, "hours", "fold")[1])


@query("m17_top_features")
def _(t):
    chosen = m.top_features(t.subj, FEATURES, "hours", 2, TREES, DEPTH)
    return t.subj.select("subject", "hours", *sorted(chosen)).unpivot(["subject", "hours"], sorted(chosen), "feature", "value")


@query("m18_importance_table")
def _(t):
    return m.importance_table(m.rf_regressor(FEATURES, "hours", TREES, depth=DEPTH).fit(t.subj), FEATURES)


@query("m19_cross_val_predict")
def _(t):
    p = m.cross_val_predict(m.rf_regressor(FEATURES, "hours", TREES, depth=DEPTH), _folded(t), "fold")
    return p.select("subject", "fold", "hours", "prediction")


@query("m20_compare_regressors")
def _(t):
    models = {"RandomForest": m.rf_regressor(FEATURES, "hours", TREES, depth=DEPTH),
              "ElasticNet": lambda train: m.elastic_net(train, FEATURES, "hours")}
    return rounded(m.compare_regressors(models, materialise(_folded(t)), "hours", "fold"), ["rmse", "mae", "r2"], 4)


@query("m20_compare_classifiers")
def _(t):
    rows = b.class_weights(_toxic(t), "toxic")
    models = {"RandomForest": m.rf_classifier(DOC, "toxic", TREES, depth=DEPTH),
              "LogRegBalanced": lambda train: m.logistic_balanced(train, DOC, "toxic")}
    return rounded(m.compare_classifiers(models, rows, "toxic", "fold"), ["accuracy", "precision", "recall", "f1"], 4)


@query("m21_compare_views")
def _(t):
    views = build_views(t.gaps, FEATURES, [BASELINE, "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], FAMILIES, BASELINE,
                        ["raw_summary", "task_wide_relative"])
    inner = (F.floor(uniform("inner", F.col("subject")) * 3) + 1).cast("int")
    targets = kfold(t.subj.select("subject", "hours"), 3, 42, ["subject"]).withColumn("inner", inner)
    metrics, _ = compare_views(views, targets, ["DummyMean", "RidgeCV", "PLSRegression"])
    return rounded(metrics, ["rmse", "mae", "r2", "pearson_r", "prediction_min", "prediction_max"], 4)


def _final(t):
    rows = t.subj.withColumn("category", bin_label(F.col("hours"))).where(F.col("category").isNotNull())
    return m.train_final(rows, FEATURES, "hours", "category", TREES, DEPTH)


@query("m23_train_final")
def _(t):
    """Importances of the final regressor and classifier, fitted on all rows."""
    stages = _final(t).stages
    parts = [(kind, f, float(w)) for kind, s in (("hours", stages[1]), ("category", stages[2]))
             for f, w in zip(FEATURES, s.featureImportances.toArray())]
    return t.spark.createDataFrame(parts, "model string, feature string, importance double")


@query("m24_predict_batch")
def _(t):
    out = m.predict_batch(_final(t), t.subj.select("subject", *FEATURES))
    return out.select("subject", F.round("predicted_hours", 6).alias("predicted_hours"), "predicted_category", "predicted_label")


@query("s11_save_and_load_model")
def _(t):
    from ..operators.scale import shared_dir
    path = f"{shared_dir(t.spark)}/model-{t.spark.sparkContext.applicationId}"
    save_model(_final(t), path)
    out = m.predict_batch(load_model(path), t.subj.select("subject", *FEATURES))
    return out.select("subject", "predicted_category")


@query("m25_kmeans")
def _(t):
    clusters = m.kmeans(t.subj.select("subject", "hours", *FEATURES), FEATURES, 3)
    return g.cluster_summary(clusters, "cluster")


@query("m26_hierarchical_clusters")
def _(t):
    clusters = m.hierarchical_clusters(t.subj.select("subject", "hours", *FEATURES), FEATURES, 3)
    return g.cluster_summary(clusters, "cluster")


@query("m27_pca_lengths", sql("subj", """WITH z AS (SELECT subject, """ + ", ".join(
    f"({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER () AS {f}" for f in FEATURES) + """ FROM subj)
    SELECT subject, round(qty * qty + price * price + disc * disc + tax * tax, 6) AS squared_length FROM z"""))
def _(t):
    """All components together keep the length of every standardised row."""
    pcs = m.pca(t.subj.select("subject", *FEATURES), FEATURES, 4)
    length = sum((F.col(f"pc{i}") * F.col(f"pc{i}") for i in range(1, 5)), F.lit(0.0))
    return pcs.select("subject", F.round(length, 6).alias("squared_length"))


@query("m27_pca_components")
def _(t):
    pcs = m.pca(t.subj.select("subject", *FEATURES), FEATURES, 2)
    return pcs.select("subject", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("m28_silhouette", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.e, b.e) ** 2) AS s, count(*) AS n
      FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
    own AS (SELECT vec_id, s / n AS a FROM d WHERE label = other),
    near AS (SELECT vec_id, min(s / n) AS b FROM (SELECT d.vec_id, d.other, s, n FROM d WHERE label <> other) GROUP BY 1)
    SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM own JOIN near USING (vec_id)""")
def _(t):
    rows = t.embeddings.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return rounded(m.silhouette(rows, "label"), ["silhouette"], 6)


@query("m28_silhouette_euclidean", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.e, b.e)) AS s, count(*) AS n
      FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
    own AS (SELECT vec_id, s / n AS a FROM d WHERE label = other),
    near AS (SELECT vec_id, min(s / n) AS b FROM d WHERE label <> other GROUP BY 1)
    SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM near LEFT JOIN own USING (vec_id)""")
def _(t):
    """The same by Euclidean distance, from sums of distances by tiles."""
    return rounded(euclidean_silhouette(t.embeddings, "label", "embedding"), ["silhouette"], 6)


@query("e12_signal_verdict")
def _(t):
    return rounded(signal_verdict(t.subj, FEATURES, k=3, trees=TREES, depth=DEPTH), ["accuracy", "macro_f1"], 4)


def _votes(t):
    rows = t.obs.withColumn("actual_label", bin_label(F.col("hours"))).where(F.col("actual_label").isNotNull())
    folded = group_kfold(rows.select("subject", "task", "actual_label", *FEATURES), "subject", 3)
    return vote_cv(folded, FEATURES, LABELS, trees=TREES, depth=DEPTH)


@query("flow_nested_tuning", f"""WITH docs AS (SELECT doc_id, toxic FROM documents JOIN labels USING (doc_id)),
    o AS (SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY {U(42, 'doc_id')}, doc_id) - 1) % 5 + 1 AS INTEGER) AS outer_fold FROM docs)
    SELECT outer_fold, count(*) AS rows, count(DISTINCT doc_id) AS keys, CAST(sum(toxic) AS BIGINT) AS positives,
      CAST(1 AS BIGINT) AS settings, CAST(0 AS BIGINT) AS wrong FROM o GROUP BY 1""")
def _(t):
    """Per outer fold: its test rows, each predicted once, by one setting of the grid and the threshold that goes with it."""
    out = nested_tuning(_toxic(t).drop("fold"), DOC, "toxic", ["doc_id"]).predictions
    fits = F.col("c").isin(*PENALTIES) & F.col("threshold").isin(*THRESHOLDS) & F.col("score").between(0, 1)
    return out.groupBy("outer_fold").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("keys"), F.sum("toxic").cast("long").alias("positives"),
        F.count_distinct("c", "threshold").alias("settings"), F.count_if(~fits).alias("wrong"))


@query("flow_vote_cv")
def _(t):
    return _votes(t).subjects


@query("flow_vote_cv_report")
def _(t):
    return rounded(_votes(t).report, ["precision", "recall", "f1"], 6)


@query("flow_segment_regression")
def _(t):
    """Out-of-fold segment predictions, averaged per subject."""
    folded = group_kfold(t.obs.select("subject", "task", "hours", *FEATURES), "subject", 3)
    p = m.cross_val_predict(m.gbt_regressor(FEATURES, "hours", ROUNDS), folded, "fold")
    return subject_aggregate(p.select("subject", F.col("hours").alias("actual"), F.col("prediction").alias("predicted")))
