"""Readers and writers on files made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.evaluate import regression_metrics
from ..operators.scale import materialise
from ..operators.subjects import profile
from ..sources import readers as r
from ..sources import writers as w
from ..sources.heads import listed
from .files import chunk, copy_compressed, new_folder, write_titled
from .proxies import rounded, sql
from .registry import query

COLUMNS = ["Timestamp", "MarkerIndex", "EEG.Interpolated", "CQ.Overall", "CQ.AF3", "POW.AF3.Theta"]


def _recordings(t, name: str = "recordings") -> str:
    """Folders <export>/subject=<id>/chunk=<n>, one file each, of two exports that differ in order and further columns.

    A missing feature is written as NaN or as text.
    """
    rec = t.marked.withColumn("chunk", chunk(t.marked, "subject", "event_id"))
    theta = F.when(F.col("f1").isNotNull(), F.col("f1").cast("string")).when(F.col("value") < 10, "NaN").otherwise("bad")
    cells = dict(zip(COLUMNS, [F.col("ts"), F.col("marker"), F.col("interpolated"), F.col("overall"), F.col("ch_a"), theta]))
    cells |= {"EEG.Counter": F.col("event_id"), "EEG.AF3": F.lit(4200)}
    root = new_folder(t.spark, name)
    orders = {"plain": [COLUMNS[0], "EEG.Counter", *COLUMNS[1:3], "EEG.AF3", *COLUMNS[3:]], "turned": [*COLUMNS[::-1], "EEG.AF3"]}
    for i, (export, names) in enumerate(orders.items()):
        write_titled(rec.where(F.col("subject") % 2 == i), f"{root}/{export}", ["subject", "chunk"], ",".join(names),
                     [cells[n] for n in names])
    return f"{root}/*"


SUBJECT_DIR = r"subject=([^/]+)/"


def _per_subject(rec):
    return rec.groupBy("subject").agg(
        F.count(F.lit(1)).alias("rows"), F.count("MarkerIndex").alias("markers"), F.count("POW_AF3_Theta").alias("known"),
        F.round(F.sum("POW_AF3_Theta"), 4).alias("total"), F.min("Timestamp").cast("long").alias("first"),
        F.count_if(F.col("EEG_Interpolated") == 1).alias("interpolated"))


PER_SUBJECT = """SELECT CAST(subject AS VARCHAR) AS subject, count(*) AS rows, count(marker) AS markers, count(f1) AS known, round(sum(f1), 4) AS total,
    min(ts) AS first, count(*) FILTER (WHERE interpolated = 1) AS interpolated FROM marked GROUP BY 1"""


@query("s1_read_recordings", sql("marked", PER_SUBJECT))
def _(t):
    root = _recordings(t)
    return _per_subject(r.read_recordings(t.spark, f"{root}/*/*/*.txt", COLUMNS, SUBJECT_DIR))


@query("s2_read_markers", sql("marker_lines", "SELECT CAST(subject AS VARCHAR) AS subject, marker_id, task, count(*) AS lines FROM marker_lines GROUP BY 1, 2, 3"))
def _(t):
    path = new_folder(t.spark, "markers")
    lines = t.marker_lines.select("subject", "marker_id", F.col("task").alias("type"))
    w.write_table(lines, path, "csv", ["subject"])
    read = r.read_markers(t.spark, f"{path}/*/*.csv", SUBJECT_DIR)
    return read.groupBy("subject", "marker_id", "task").agg(F.count(F.lit(1)).alias("lines"))


@query("s3_read_metadata", sql("meta", "SELECT CAST(subject AS VARCHAR) AS subject, round(hours, 5) AS hours, gender FROM meta WHERE hours >= 0"))
def _(t):
    """Subjects with a negative label are written without an id, which drops them on reading."""
    meta = t.meta.withColumn("slot", F.pmod(F.xxhash64("subject"), F.lit(4)).cast("int"))
    key = F.when(F.col("hours") >= 0, F.col("subject").cast("string"))
    comma = F.replace(F.col("hours").cast("decimal(20, 5)").cast("string"), F.lit("."), F.lit(","))
    path = write_titled(meta, new_folder(t.spark, "metadata"), ["slot"], "ID;Average Sleep Hours per Night;Gender",
                        [key, comma, F.col("gender")], ";")
    return r.read_metadata(t.spark, f"{path}/*/*.txt")


@query("s4_read_lookup", "SELECT DISTINCT lower(trim(p_name)) AS task, p_type AS description, p_brand AS cognitive_domain FROM part WHERE lower(p_name) NOT IN ('red ring', 'hot gear')")
def _(t):
    path = new_folder(t.spark, "stimuli")
    rows = t.part.select(F.concat(F.lit("  "), F.upper("p_name")).alias("original_stimuli_name"),
                         F.col("p_type").alias("description"), F.col("p_brand").alias("cognitive_domain")).distinct()
    w.write_table(rows, path, "csv")
    return r.read_lookup(t.spark, f"{path}/*.csv", exclude=("red ring", "hot gear")).select("task", "description", "cognitive_domain")


@query("s5_subject_from_path", "SELECT CAST(user_id AS VARCHAR) AS subject, count(*) AS rows FROM events GROUP BY 1")
def _(t):
    path = new_folder(t.spark, "folders")
    w.write_table(t.events.select("event_id", "user_id"), path, "parquet", ["user_id"])
    root = r.resolve_root(t.spark, f"{path}-absent", path)
    rows = t.spark.read.option("recursiveFileLookup", True).parquet(root)
    return rows.select(r.subject_from_path(r"user_id=([^/]+)/").alias("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("rows"))


def _by_manifest(t):
    """A folder with a space, and customers without events whose file does not exist."""
    root = _recordings(t, "all recordings")
    files = listed(t.spark, f"{root}/*/*/*.txt").select(F.regexp_replace("file", "%20", " ").alias("Data_File"))
    known = files.select(F.regexp_extract("Data_File", SUBJECT_DIR, 1).alias("Subject_ID"), "Data_File")
    absent = (t.meta.join(t.events.select(F.col("user_id").alias("subject")).distinct(), "subject", "left_anti")
              .select(F.col("subject").cast("string").alias("Subject_ID"),
                      F.concat(F.lit(root.removesuffix("/*") + "/absent/"), F.col("subject")).alias("Data_File")))
    return r.read_by_manifest(t.spark, materialise(known.unionByName(absent)), COLUMNS)


WITHOUT_EVENTS = "SELECT CAST(c_custkey AS VARCHAR) AS subject FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"


@query("s6_read_by_manifest", sql("marked", PER_SUBJECT))
def _(t):
    return _per_subject(_by_manifest(t)[0])


@query("s6_manifest_without_file", WITHOUT_EVENTS)
def _(t):
    return _by_manifest(t)[1].select("subject")


@query("s7_read_tolerant", sql("marked", """SELECT subject, rows, reason FROM (
    SELECT CAST(subject AS VARCHAR) AS subject, CASE WHEN subject % 10 <> 0 THEN count(*) END AS rows,
      CASE WHEN subject % 10 = 0 THEN 'cut' END AS reason FROM marked GROUP BY subject)
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), CAST(NULL AS BIGINT), 'no file' FROM customer
    WHERE c_custkey NOT IN (SELECT user_id FROM events)"""))
def _(t):
    """Subjects that load, whole; those with a cut file or none, with the reason."""
    whole = f"{_recordings(t, 'whole')}/*/*/*.txt"
    path = copy_compressed(t.spark, whole, new_folder(t.spark, "tolerant"), SUBJECT_DIR, 10)
    expected = t.meta.select(F.col("subject").cast("string").alias("subject"))
    loaded, skipped = r.read_tolerant(t.spark, f"{path}/*/*.gz", expected, COLUMNS, pattern=SUBJECT_DIR)
    counts = loaded.groupBy("subject").agg(F.count(F.lit(1)).alias("rows")).withColumn("reason", F.lit(None).cast("string"))
    reason = F.when(F.col("reason") == "no file", "no file").otherwise("cut")
    return counts.unionByName(skipped.select("subject", F.lit(None).cast("long").alias("rows"), reason.alias("reason")))


@query("s8_read_features", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    return r.read_features(t.spark, f"{t.dir}/customer.parquet").select("c_custkey", "c_acctbal", "c_mktsegment")


@query("s9_write_table", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(t):
    path = new_folder(t.spark, "orders")
    w.write_table(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), path, "csv")
    back = r.read_features(t.spark, path, "csv", "o_orderkey long, o_totalprice double, o_orderpriority string")
    return back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s10_write_metrics", sql("pred", """WITH m AS (SELECT fold, count(*)::DOUBLE AS n, sqrt(avg((actual - predicted) ** 2)) AS rmse,
    avg(abs(actual - predicted)) AS mae, 1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) AS r2 FROM pred GROUP BY 1)
    SELECT fold, metric, round(value, 7) AS value FROM (SELECT fold, unnest(['n', 'rmse', 'mae', 'r2']) AS metric, unnest([n, rmse, mae, r2]) AS value FROM m)"""))
def _(t):
    path = new_folder(t.spark, "metrics")
    w.write_metrics(regression_metrics(t.pred, ["fold"]), path, ["fold"])
    return rounded(t.spark.read.parquet(path), ["value"])


TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
         "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
         "l_shipdate": "timestamp_ntz"}


@query("s12_profile", " UNION ALL ".join(
    f"SELECT '{k}' AS column_name, '{v}' AS type, count(*) AS rows, count({k}) AS non_null FROM lineitem" for k, v in TYPES.items()))
def _(t):
    return profile(t.lineitem)
