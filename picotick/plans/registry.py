"""Registry of the timing queries: name -> (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    """Decorator that files a query under ``name`` with its oracle."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = (f, sql)
        return f

    return add


def _load() -> None:
    """Imports the modules that register queries; here, so that any of them may be imported first."""
    from . import attributions, details, files, matches, modelling, outcomes, peaks, ranks, scans, signals, statistics, tdc_run, training  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["agg_f1_fwhm"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in QUERIES.items() if s}
