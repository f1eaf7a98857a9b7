"""Queries by name, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under ``name``."""
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from .proxies import Tables
            return f(Tables(spark, sf_dir))

        run.__doc__ = f.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register
