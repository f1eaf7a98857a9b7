"""Recording -> windows -> segment medians and diagnostics, in one flow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import segment_key
from ..operators.quality import QualitySpec, quality_mask, row_attrition
from ..operators.scale import attach, materialise, settle
from ..operators.segments import (
    allowed_only, meta_aggregates, pair_markers, segment_join, segment_median, segment_status, valid_segments,
    window_index, with_window_keys,
)


@dataclass(frozen=True)
class SegmentTables:
    windows: DataFrame
    medians: DataFrame
    diagnostics: DataFrame


def build_segments(rec: DataFrame, markers: DataFrame, meta: DataFrame, allowed: DataFrame, spec: QualitySpec,
                   features: list[str], reference: str, ts: str = "ts", marker: str = "marker",
                   tie: list[str] = ()) -> SegmentTables:
    """``rec``: subject, ts, marker, quality columns, features; ``markers``: subject, marker_id, task;
    ``meta``: subject, hours, gender; ``allowed``: the reference tasks.

    The quality filter comes first, so a marker on a bad sample does not count. ``rec`` is a stored table: it is
    scanned for the cuts, the marker rows, the rows inside segments and the counts, each time with the columns
    that step needs, and never written as a whole. The rows inside segments are written once: windows, medians
    and diagnostics are read from there.
    """
    checked = quality_mask(rec, spec)
    clean = checked.where("ok").drop("ok")
    markers = settle(attach(markers, meta.select("subject").distinct(), ["subject"], "left_semi"))
    pairs = settle(pair_markers(clean, marker=marker, ts=ts))
    kept = allowed_only(markers, allowed).join(valid_segments(pairs), ["subject", "marker_id"])
    cut = segment_join(clean.select("subject", ts, *tie, *features),
                       kept.select("subject", "marker_id", "task", "t_start", "t_end"), ts=ts)
    inside = materialise(window_index(cut, ["subject", "marker_id"], [ts, *tie]))

    counts = inside.groupBy("subject", "marker_id").agg(F.count(F.lit(1)).alias("segment_rows"),
                                                        F.count(reference).alias("reference_rows"))
    diagnostics = attach(segment_status(markers, pairs, allowed, counts), row_attrition(checked), ["subject"], "left")
    windows = attach(inside.where(F.col(reference).isNotNull()), meta, ["subject"])
    medians = segment_median(windows, ["subject", "task"], features, meta_aggregates(["hours", "gender"], [ts, *tie]))
    return SegmentTables(
        with_window_keys(windows).select("window_id", "segment_id", "subject", "task", "marker_id", "window_index", ts,
                                         *features, "hours", "gender"),
        medians.withColumn("segment_id", segment_key(F.col("task"), F.col("subject"))),
        diagnostics,
    )
