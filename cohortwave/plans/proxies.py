"""The cohort tables made from the TPC-H-like tables, in Spark and as SQL for the checks.

``rec``      events as a recording: one subject per user, two features, quality columns, markers
``obs``      line items as a segment table: subject = customer, task = order priority,
             features = root mean squares, as band powers are
``subj``     subject means of ``obs``
``pred``     ``obs`` with the predictions of a fixed rule

Prepared tables are written once per session, as the steps of a study hand them on.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bin_label, uniform
from ..operators.quality import QualitySpec, quality_mask
from ..operators.scale import materialise, row_numbers
from ..operators.segments import last_wins_lookup, pair_markers, segment_join, valid_segments, window_index

FEATURES = ["qty", "price", "disc", "tax"]
LABELS = ["Short", "Normal", "Long"]
BASELINE = "1-URGENT"
FAMILIES = [(BASELINE, "baseline"), ("2-", "high"), ("3-", "mid"), ("4-", "mid")]
SPEC = QualitySpec("subject", "interpolated", "overall", ["ch_a", "ch_b"], 0.2, 1.0)

_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def rounded(df: DataFrame, cols, digits: int = 7) -> DataFrame:
    """Sums of doubles differ in their last digits between engines; results are compared rounded."""
    return df.withColumns({k: F.round(k, digits) for k in cols})


GRID = 2 ** 36


def on_grid(x: Column) -> Column:
    """To a multiple of 2^-36: equal values stay equal whatever the order of a sum, and unlike a
    decimal grid it has no points halfway between the decimals results are rounded to."""
    return F.floor(x * F.lit(float(GRID)) + 0.5) / F.lit(float(GRID))


def grid(x: str) -> str:
    return f"floor({x} * {GRID}::DOUBLE + 0.5) / {GRID}::DOUBLE"


def micros(ts):
    return F.unix_micros(ts.cast("timestamp"))


class Tables:
    """The given tables of one folder and the cohort tables made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _once(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _WRITTEN:
            _WRITTEN[key] = materialise(build())
        return _WRITTEN[key]

    @cached_property
    def rec(self) -> DataFrame:
        e = self.events
        value = F.col("value")
        return e.select(
            F.col("user_id").alias("subject"), "event_id", micros(F.col("ts")).alias("ts"), "event_type", "value",
            F.get_json_object("props", "$.k").cast("double").alias("k"),
        ).select(
            "*", F.when(value >= 25, value).alias("f1"), F.col("k").alias("f2"),
            (F.col("event_type") == "error").cast("int").alias("interpolated"), F.col("k").alias("overall"),
            F.floor(F.col("k") / 20).cast("double").alias("ch_a"),
            F.when(value >= 1, F.least(F.floor(value / 5), F.lit(4)).cast("double")).alias("ch_b"),
        )

    @property
    def marked(self) -> DataFrame:
        """``rec`` with markers: a user's k-th signup starts marker k, the k-th purchase ends it."""
        def build():
            kind = F.col("event_type").isin("signup", "purchase")
            sign = F.when(F.col("event_type") == "signup", 1).otherwise(-1)
            edges = row_numbers(self.rec.where(kind), ["subject", "event_type"], ["ts", "event_id"], "marker")
            return edges.withColumn("marker", F.col("marker") * sign).unionByName(
                self.rec.where(~kind).withColumn("marker", F.lit(None).cast("long")))

        return self._once("marked", build)

    @property
    def checked(self) -> DataFrame:
        return self._once("checked", lambda: quality_mask(self.marked, SPEC))

    @property
    def clean(self) -> DataFrame:
        return self.checked.where("ok").drop("ok")

    @property
    def marker_lines(self) -> DataFrame:
        """Marker file lines; an end line names the same marker again, so ids repeat."""
        m = F.abs("marker")
        return self.marked.where(F.col("marker").isNotNull()).select(
            "subject", m.alias("marker_id"), "ts", "event_id",
            F.concat(F.when(F.col("marker") > 0, " Task").otherwise("task"), (m % 5).cast("string")).alias("task"))

    @property
    def markers(self) -> DataFrame:
        return last_wins_lookup(self.marker_lines, ["subject", "marker_id"], "task", ["ts", "event_id"])

    @property
    def allowed(self) -> DataFrame:
        """The reference tasks: those of the marker files but the last one."""
        return self.marker_lines.select(F.lower(F.trim("task")).alias("task")).distinct().where("task <> 'task4'")

    @property
    def pairs(self) -> DataFrame:
        return pair_markers(self.clean)

    @property
    def windows(self) -> DataFrame:
        """Clean rows inside valid segments, numbered per segment, with the task."""
        def build():
            cut = segment_join(self.clean, valid_segments(self.pairs))
            numbered = window_index(cut, ["subject", "marker_id"], ["ts", "event_id"])
            return numbered.join(self.markers, ["subject", "marker_id"], "inner")

        return self._once("windows", build)

    @cached_property
    def meta(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("subject"),
                                    (F.col("c_acctbal") / 1000).alias("hours"), F.col("c_mktsegment").alias("gender"))

    @property
    def obs(self) -> DataFrame:
        def build():
            # line items are summed per order before the join, on the key the join needs
            cols = {"qty": F.col("l_quantity"), "price": F.col("l_extendedprice") / 1000,
                    "disc": F.col("l_discount"), "tax": F.col("l_tax")}
            per_order = self.lineitem.groupBy("l_orderkey").agg(
                F.count(F.lit(1)).alias("n"), *[F.sum(c * c).alias(f) for f, c in cols.items()])
            orders = self.orders.select("o_orderkey", F.col("o_custkey").alias("subject"),
                                        F.col("o_orderpriority").alias("task"))
            joined = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            means = joined.groupBy("subject", "task").agg(
                *[on_grid(F.sqrt(F.sum(f) / F.sum("n"))).alias(f) for f in cols], F.sum("n").alias("n_rows"))
            return means.join(self.meta, "subject")

        return self._once("obs", build)

    @property
    def gaps(self) -> DataFrame:
        """``obs`` with missing values."""
        return self.obs.withColumns({"tax": F.when(F.col("qty") <= 35, F.col("tax")),
                                     "price": F.when(F.col("hours") >= 0, F.col("price"))})

    @property
    def subj(self) -> DataFrame:
        def build():
            means = [F.round(F.avg(f), 6).alias(f) for f in FEATURES]
            return self.obs.groupBy("subject").agg(
                *means, F.min("hours").alias("hours"), F.min("gender").alias("gender"),
                F.count(F.lit(1)).alias("n_tasks"))

        return self._once("subj", build)

    @property
    def pred(self) -> DataFrame:
        """A fixed rule's predictions for every row with a class."""
        q = F.col("qty")
        return self.obs.withColumns({
            "actual_label": bin_label(F.col("hours")),
            "predicted_label": F.when(q < 22, "Short").when(q < 28, "Normal").otherwise("Long"),
            "p_short": F.round(F.col("tax") * 8, 4), "p_normal": F.round(F.col("disc") * 6, 4),
            "p_long": F.round(F.lit(1.0) - F.col("tax") * 8, 4),
            "actual": F.col("hours"), "predicted": F.round(q / 5, 4),
            "fold": (F.floor(uniform("fold", F.col("subject")) * 5) + 1).cast("int"),
        }).where(F.col("actual_label").isNotNull())

    @property
    def scored(self) -> DataFrame:
        """Labelled documents with a length score for the rarer class."""
        return self.documents.join(self.labels, "doc_id").select(
            "doc_id", "toxic", "quality", "lang",
            F.round(1 / (1 + F.col("n_chars") / 2000), 6).alias("score"), F.col("n_chars").cast("double").alias("len"),
            F.size(F.split("text", " ")).cast("double").alias("words"))


def U(seed, *keys: str) -> str:
    """The seeded draw as SQL."""
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"


CTES = {
    "rec": """rec AS (SELECT *, CASE WHEN value >= 25 THEN value END AS f1, k AS f2,
        CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS interpolated, k AS overall, floor(k / 20) AS ch_a,
        CASE WHEN value >= 1 THEN least(floor(value / 5), 4) END AS ch_b
        FROM (SELECT user_id AS subject, event_id, epoch_us(ts) AS ts, event_type, value,
              CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events))""",
    "marked": """marked AS (SELECT *, CASE event_type
        WHEN 'signup' THEN row_number() OVER (PARTITION BY subject, event_type ORDER BY ts, event_id)
        WHEN 'purchase' THEN -row_number() OVER (PARTITION BY subject, event_type ORDER BY ts, event_id) END AS marker
        FROM rec)""",
    "checked": """checked AS (SELECT *, (interpolated = 0
        AND overall >= CASE WHEN max(overall) OVER (PARTITION BY subject) <= 1 THEN 0.2 ELSE 20 END
        AND coalesce(ch_a >= 1, false) AND coalesce(ch_b >= 1, false)) AS ok FROM marked)""",
    "clean": "clean AS (SELECT * FROM checked WHERE ok)",
    "marker_lines": """marker_lines AS (SELECT subject, abs(marker) AS marker_id, ts, event_id,
        (CASE WHEN marker > 0 THEN ' Task' ELSE 'task' END) || (abs(marker) % 5) AS task
        FROM marked WHERE marker IS NOT NULL)""",
    "markers": """markers AS (SELECT subject, marker_id, task FROM (SELECT *, row_number() OVER
        (PARTITION BY subject, marker_id ORDER BY ts DESC, event_id DESC) AS r FROM marker_lines) WHERE r = 1)""",
    "allowed": """allowed AS (SELECT DISTINCT lower(trim(task)) AS task FROM marker_lines
        WHERE lower(trim(task)) <> 'task4')""",
    "pairs": """pairs AS (SELECT subject, abs(marker) AS marker_id,
        count(*) FILTER (WHERE marker > 0) AS start_rows, count(*) FILTER (WHERE marker < 0) AS end_rows,
        min(ts) FILTER (WHERE marker > 0) AS t_start, min(ts) FILTER (WHERE marker < 0) AS t_end
        FROM clean WHERE marker IS NOT NULL GROUP BY 1, 2)""",
    "windows": """windows AS (SELECT c.*, p.marker_id, p.t_start, p.t_end, p.start_rows, p.end_rows, m.task,
        row_number() OVER (PARTITION BY p.subject, p.marker_id ORDER BY c.ts, c.event_id) AS window_index
        FROM clean c JOIN pairs p ON c.subject = p.subject AND c.ts BETWEEN p.t_start AND p.t_end
        JOIN markers m ON m.subject = p.subject AND m.marker_id = p.marker_id WHERE p.t_end > p.t_start)""",
    "meta": """meta AS (SELECT c_custkey AS subject, c_acctbal / 1000 AS hours, c_mktsegment AS gender FROM customer)""",
    "obs": f"""obs AS (SELECT o_custkey AS subject, o_orderpriority AS task, {grid('sqrt(avg(l_quantity * l_quantity))')} AS qty,
        {grid('sqrt(avg((l_extendedprice / 1000) * (l_extendedprice / 1000)))')} AS price,
        {grid('sqrt(avg(l_discount * l_discount))')} AS disc, {grid('sqrt(avg(l_tax * l_tax))')} AS tax,
        count(*) AS n_rows, any_value(c_acctbal) / 1000 AS hours, any_value(c_mktsegment) AS gender
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        GROUP BY o_custkey, o_orderpriority)""",
    "gaps": """gaps AS (SELECT * REPLACE (CASE WHEN qty <= 35 THEN tax END AS tax,
        CASE WHEN hours >= 0 THEN price END AS price) FROM obs)""",
    "subj": """subj AS (SELECT subject, round(avg(qty), 6) AS qty, round(avg(price), 6) AS price,
        round(avg(disc), 6) AS disc, round(avg(tax), 6) AS tax, min(hours) AS hours, min(gender) AS gender,
        count(*) AS n_tasks FROM obs GROUP BY subject)""",
    "pred": f"""pred AS (SELECT * FROM (SELECT *, CASE WHEN hours >= 0 AND hours < 6 THEN 'Short'
        WHEN hours >= 6 AND hours < 8 THEN 'Normal' WHEN hours >= 8 AND hours < 99 THEN 'Long' END AS actual_label,
        CASE WHEN qty < 22 THEN 'Short' WHEN qty < 28 THEN 'Normal' ELSE 'Long' END AS predicted_label,
        round(tax * 8, 4) AS p_short, round(disc * 6, 4) AS p_normal, round(1 - tax * 8, 4) AS p_long,
        hours AS actual, round(qty / 5, 4) AS predicted,
        CAST(floor({U('fold', 'subject')} * 5) + 1 AS INTEGER) AS fold FROM obs) WHERE actual_label IS NOT NULL)""",
    "scored": """scored AS (SELECT doc_id, toxic, quality, lang, round(1 / (1 + n_chars / 2000.0), 6) AS score,
        CAST(n_chars AS DOUBLE) AS len, CAST(len(string_split(text, ' ')) AS DOUBLE) AS words
        FROM documents JOIN labels USING (doc_id))""",
}
NEEDS = {
    "marked": ["rec"], "checked": ["rec", "marked"], "clean": ["rec", "marked", "checked"],
    "marker_lines": ["rec", "marked"], "markers": ["rec", "marked", "marker_lines"],
    "allowed": ["rec", "marked", "marker_lines"], "pairs": ["rec", "marked", "checked", "clean"],
    "windows": ["rec", "marked", "checked", "clean", "marker_lines", "markers", "pairs"],
    "gaps": ["obs"], "subj": ["obs"], "pred": ["obs"],
}


def sql(tables: str, body: str) -> str:
    """``body`` over the named cohort tables."""
    wanted: list[str] = []
    for name in tables.split():
        for t in [*NEEDS.get(name, []), name]:
            if t not in wanted:
                wanted.append(t)
    body = body.strip()
    ctes = [CTES[t] for t in wanted]
    if body[:5].upper() == "WITH ":
        ctes.append(body[5:])
        return "WITH " + ",\n".join(ctes[:-1] + [ctes[-1]])
    return "WITH " + ",\n".join(ctes) + "\n" + body
