"""Picking, renaming and checking columns by name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The headset's channels, bands and metrics.
CHANNELS = ["AF3", "F7", "F3", "FC5", "T7", "P7", "O1", "O2", "P8", "T8", "FC6", "F4", "F8", "AF4"]
BANDS = ["Theta", "Alpha", "BetaL", "BetaH", "Gamma"]
METRICS = ["Engagement", "Excitement", "Stress", "Relaxation", "Interest", "Focus", "Attention"]
BAND_GROUPS = {"Theta": ["Theta"], "Alpha": ["Alpha"], "Beta": ["BetaL", "BetaH"], "Gamma": ["Gamma"]}
REGIONS = {
    "Frontal": ["AF3", "F7", "F3", "FC5", "FC6", "F4", "F8", "AF4"],
    "Temporal": ["T7", "T8"],
    "Parietal_Occipital": ["P7", "P8", "O1", "O2"],
}


def spark_name(name: str) -> str:
    """Dots mean struct access in Spark, so stored columns use underscores."""
    return name.replace(".", "_")


def power_columns() -> list[str]:
    return [f"POW.{ch}.{band}" for ch in CHANNELS for band in BANDS]


def metric_columns() -> list[str]:
    return [f"PM.{m}.Scaled" for m in METRICS]


def quality_columns() -> list[str]:
    return [f"CQ.{ch}" for ch in CHANNELS]


def feature_columns(df: DataFrame, prefix: str = "", suffix: str = "", contains: str = "") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix) and contains in c]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def rename_pattern(df: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    """Strip a prefix and a suffix from every column name that has them."""
    def short(name: str) -> str:
        return name.removeprefix(prefix).removesuffix(suffix)

    return df.withColumnsRenamed({c: short(c) for c in df.columns if short(c) != c})


def require_columns(df: DataFrame, cols: list[str], drop: Iterable[str] = ()) -> DataFrame:
    """Columns in the asked order, or an error that names the missing ones."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing {len(missing)} columns, first ones: {missing[:3]}")
    gone = set(drop)
    return df.select(*[F.col(f"`{c}`") for c in cols if c not in gone])


def band_columns(columns: Iterable[str], prefix: str = "POW_") -> dict[str, list[str]]:
    """Band group -> the power columns in it, over all channels; empty groups are left out."""
    power = [c for c in columns if c.startswith(prefix)]
    groups = {g: [c for c in power if c.rsplit("_", 1)[-1] in bands] for g, bands in BAND_GROUPS.items()}
    return {g: cols for g, cols in groups.items() if cols}


def channel_columns(columns: Iterable[str], prefix: str = "POW_") -> dict[str, list[str]]:
    columns = list(columns)
    groups = {ch: [c for c in columns if c.startswith(f"{prefix}{ch}_")] for ch in CHANNELS}
    return {g: cols for g, cols in groups.items() if cols}


def feature_catalog(spark, columns: Iterable[str]) -> DataFrame:
    """column, family, channel and band of each dotted feature name."""
    rows = []
    for name in columns:
        parts = name.split(".")
        rows.append((spark_name(name), parts[0], parts[1] if len(parts) > 1 else None,
                     parts[2] if len(parts) > 2 else None))
    return spark.createDataFrame(rows, "column string, family string, channel string, band string")
