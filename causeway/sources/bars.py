"""Bars from event tables: the canonical schema and its builders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import halo

#: symbol, ts_event (opening), ts_close (when the bar is known), prices, volume, bar_index from 0.
COLUMNS = ("symbol", "ts_event", "ts_close", "open", "high", "low", "close", "volume", "bar_index")


def from_ticks(ticks: DataFrame, unit: str, symbol: str, ts: str, value: str, tie: str, volume: str | None = None, by_bucket: bool = False) -> DataFrame:
    """Bars of a calendar unit. First and last tick are by time, then by ``tie``.

    One partial and one final aggregation; then bars of a symbol are numbered. A
    numbering by one window reads the aggregate once, but sorts a whole symbol in
    a task; ``by_bucket`` numbers month by month instead, for series of which no
    task should hold one.
    """
    bucket = F.date_trunc(unit, F.col(ts).cast("timestamp"))
    order = F.struct(ts, tie)
    grouped = ticks.groupBy(F.col(symbol).alias("symbol"), bucket.alias("ts_event")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.sum(volume or value).alias("volume")
    )
    closed = grouped.withColumn("ts_close", F.col("ts_event") + F.expr(f"INTERVAL 1 {unit.upper()}"))
    numbered = halo.with_bar_index(closed) if by_bucket else closed.withColumn("bar_index", F.expr("CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts_close) - 1 AS BIGINT)"))
    return numbered.select(*COLUMNS)


def events(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Bars of the events table, one symbol an event type."""
    return from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", "value"), unit, "event_type", "ts", "value", "event_id")


def events_sql(unit: str = "hour") -> str:
    """The same bars as a DuckDB query in parentheses."""
    return (
        "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_close) - 1 AS bar_index FROM "
        f"(SELECT event_type AS symbol, date_trunc('{unit}', ts) AS ts_event, date_trunc('{unit}', ts) + INTERVAL 1 {unit} AS ts_close, "
        "arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(value) AS volume "
        "FROM events GROUP BY 1, 2, 3))"
    )
