"""The queries of the time-series engine and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causeway.plans import data, primitives, runs

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return data.queries() | primitives.queries() | {k: q for k, (q, _) in runs.RUNS.items()}


def oracle_sql() -> dict[str, str]:
    return data.oracle_sql() | primitives.oracle_sql() | {k: s for k, (_, s) in runs.RUNS.items() if s}
