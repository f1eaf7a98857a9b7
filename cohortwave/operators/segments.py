"""Markers -> segments -> windows of a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clean_key, segment_key
from .quantiles import quantile_agg
from .scale import attach, fits_broadcast, row_numbers, settle

SEGMENT_BROADCAST_ROWS = 100_000


def last_wins_lookup(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """One value per key: the one that comes last, as when a dictionary is filled in order."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def allowed_only(df: DataFrame, reference: DataFrame, task: str = "task") -> DataFrame:
    return attach(df.withColumn("_key", clean_key(F.col(task))), _task_keys(reference, task),
                  ["_key"], "left_semi").drop("_key")


def not_allowed(df: DataFrame, reference: DataFrame, task: str = "task") -> DataFrame:
    """The complement, which diagnostics keep; a missing task is not allowed either."""
    keyed = df.withColumn("_key", clean_key(F.col(task)))
    known = _task_keys(reference, task).withColumn("_known", F.lit(True))
    return attach(keyed, known, ["_key"], "left").where(F.col("_known").isNull()).drop("_key", "_known")


def _task_keys(reference: DataFrame, task: str) -> DataFrame:
    return reference.select(clean_key(F.col(task)).alias("_key")).distinct()


def first_event(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "first_value") -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(out))


def pair_markers(df: DataFrame, subject: str = "subject", marker: str = "marker", ts: str = "ts") -> DataFrame:
    """First start (+id) and first end (-id) of each marker among the given rows."""
    m = F.col(marker)
    return (
        df.where(m.isNotNull() & (m != 0))
        .groupBy(subject, F.abs(m).cast("long").alias("marker_id"))
        .agg(
            F.count_if(m > 0).alias("start_rows"),
            F.count_if(m < 0).alias("end_rows"),
            F.min(F.when(m > 0, F.col(ts))).alias("t_start"),
            F.min(F.when(m < 0, F.col(ts))).alias("t_end"),
        )
    )


def valid_segments(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("t_end") > F.col("t_start"))


def segment_join(rec: DataFrame, seg: DataFrame, subject: str = "subject", ts: str = "ts",
                 rows: int = SEGMENT_BROADCAST_ROWS) -> DataFrame:
    """Rows with t_start <= ts <= t_end; overlapping segments share rows.

    Few segments are broadcast and the recording does not move. Many are cut at multiples of
    their mean duration (at most three pieces per segment on average) and joined on
    (subject, time slot), which also spreads a subject that holds most of the rows.
    """
    seg = settle(seg)
    times = {c: _ticks(df, c) for df, names in ((rec, [ts]), (seg, ["t_start", "t_end"])) for c in names}
    inside = F.col(ts).between(F.col("t_start"), F.col("t_end"))
    if fits_broadcast(seg, rows):
        return rec.join(F.broadcast(seg), subject, "inner").where(inside)
    width = seg.agg(F.avg(times["t_end"] - times["t_start"])).first()[0] or 1.0

    def slot(c: str) -> Column:
        return F.floor(times[c] / F.lit(float(width))).cast("long")

    pieces = seg.withColumn("_slot", F.explode(F.sequence(slot("t_start"), slot("t_end"))))
    return (rec.withColumn("_slot", slot(ts)).join(pieces.hint("merge"), [subject, "_slot"], "inner")
            .where(inside).drop("_slot"))


def _ticks(df: DataFrame, column: str) -> Column:
    """A time as a number: numbers stand for themselves, timestamps count microseconds and dates days."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(column)
    raise TypeError(f"{column} is {kind.simpleString()}, which is no time")


def window_index(df: DataFrame, keys: list[str], order: list[str], out: str = "window_index") -> DataFrame:
    """Position inside the segment, given before rows with a missing feature are dropped."""
    return row_numbers(df, keys, order, out)


def with_window_keys(df: DataFrame, task: str = "task", subject: str = "subject",
                     index: str = "window_index") -> DataFrame:
    t, s = F.col(task), F.col(subject)
    return df.withColumns({"segment_id": segment_key(t, s), "window_id": segment_key(t, s, F.col(index))})


def segment_mean(df: DataFrame, keys: list[str], features: list[str], others: list[Column] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(f).alias(f) for f in features], *others)


def segment_median(df: DataFrame, keys: list[str], features: list[str], others: list[Column] = ()) -> DataFrame:
    return quantile_agg(df, keys, {f: (f, 0.5) for f in features}, others)


def first_known(value: str, order: list[str]) -> Column:
    """First non-missing value in a stated order."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))


def segment_meta(df: DataFrame, keys: list[str], firsts: list[str], order: list[str],
                 index: str = "window_index") -> DataFrame:
    return df.groupBy(*keys).agg(*meta_aggregates(firsts, order, index))


def meta_aggregates(firsts: list[str], order: list[str], index: str = "window_index") -> list[Column]:
    return [*[first_known(c, order).alias(c) for c in firsts], F.count(index).alias("num_windows")]


def segment_status(markers: DataFrame, pairs: DataFrame, allowed: DataFrame, rows: DataFrame,
                   subject: str = "subject", task: str = "task", marker: str = "marker_id") -> DataFrame:
    """First failing check of each marker.

    ``markers``: subject, marker id, task; ``pairs``: from pair_markers; ``rows``: per valid
    segment the row count ``segment_rows`` and ``reference_rows`` with a reference value.
    """
    keys = [subject, marker]
    known = _task_keys(allowed, task).withColumn("_allowed", F.lit(True))
    looked_up = (attach(markers.withColumn("_key", clean_key(F.col(task))), known, ["_key"], "left")
                 .join(pairs, keys, "left").join(rows, keys, "left"))
    start, end = F.col("t_start"), F.col("t_end")
    status = (
        F.when(F.col("_allowed").isNull(), "not_allowed_by_reference_tasks")
        .when((F.coalesce(F.col("start_rows"), F.lit(0)) == 0) | (F.coalesce(F.col("end_rows"), F.lit(0)) == 0),
              "missing_start_or_end")
        .when(start.isNull() | end.isNull() | (end <= start), "bad_timestamps")
        .when(F.coalesce(F.col("segment_rows"), F.lit(0)) == 0, "empty_segment")
        .when(F.col("reference_rows") == 0, "all_reference_fft_nan")
        .otherwise("ok")
    )
    s = F.col("status")
    timed = s.isin("bad_timestamps", "empty_segment", "ok")
    counted = s.isin("all_reference_fft_nan", "ok")
    return looked_up.withColumn("status", status).select(
        subject, marker, task, "status",
        F.when(counted, F.col("segment_rows")).alias("segment_rows"),
        F.when(timed, start).alias("t_start"),
        F.when(timed, end).alias("t_end"),
        F.when(s == "ok", end - start).alias("duration_ticks"),
    )


def segment_duration(windows: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    return windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("segment_rows"),
                                      (F.max("t_end") - F.min("t_start")).alias("duration_ticks"))


def kept_counts(status: DataFrame, subjects: DataFrame, subject: str = "subject") -> DataFrame:
    """Kept tasks and windows and skipped markers of every subject, none left out."""
    ok = F.col("status") == "ok"
    counts = status.groupBy(subject).agg(
        F.count_if(ok).alias("kept_tasks"),
        F.coalesce(F.sum(F.when(ok, F.col("segment_rows"))), F.lit(0)).alias("kept_windows"),
        F.count_if(~ok).alias("skipped"),
    )
    return subjects.select(subject).distinct().join(counts, subject, "left").fillna(0)


def downsample_even(df: DataFrame, keys: list[str], order: list[str], n: int, index: str = "window_index",
                    out: str = "window_index_downsampled") -> DataFrame:
    """At most n evenly spaced rows per segment.

    Row r of c (from 0) stays if it is one of ``i * (c - 1) div (n - 1)``, which is tested with
    the only i that can reach it. A segment that is not cut keeps its old index.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    placed = attach(row_numbers(df, keys, order, "_r"), sizes, keys)
    reach = placed.withColumn("_i", F.expr(f"((_r - 1) * {n - 1} + _c - 2) div greatest(_c - 1, 1)"))
    whole = F.col("_c") <= n
    chosen = F.expr(f"(_i * (_c - 1)) div {n - 1} = _r - 1")
    return (reach.where(whole | chosen)
            .withColumn(out, F.when(whole, F.col(index).cast("long")).otherwise(F.col("_i") + 1))
            .drop("_r", "_c", "_i"))
