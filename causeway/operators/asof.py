"""As-of joins: calendars of events and published series, one row a bar.

Bars and the other side are unioned and carried along a window, so the join is
one exchange and a sort, whatever the sizes. Without a key the other side holds
for every symbol: each of its rows is repeated for the symbols that have bars,
whose list is one row that goes to all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _tagged(bars: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of the other side for each symbol."""
    if "symbol" in other.columns:
        return other
    symbols = bars.agg(F.collect_set("symbol").alias("_symbols"))
    return other.join(F.broadcast(symbols)).withColumn("symbol", F.explode("_symbols")).drop("_symbols")


def events(bars: DataFrame, calendar: DataFrame, name: str, known_in_advance: bool = False) -> DataFrame:
    """Adds ``event_<name>_last`` (at or before ts_close) and, if known, ``event_<name>_next`` (after it).

    ``calendar`` has ``ts_event`` and perhaps ``symbol``.
    """
    marks = _tagged(bars, calendar.select(F.col("ts_event").cast("timestamp").alias("_at"), *(["symbol"] if "symbol" in calendar.columns else [])))
    both = bars.withColumn("_at", F.lit(None).cast("timestamp")).withColumn("_when", F.col("ts_close")).withColumn("_kind", F.lit(1))
    both = both.unionByName(marks.withColumn("_when", F.col("_at")).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    # An event at the very close counts as past: it sorts before the bar.
    order = Window.partitionBy("symbol").orderBy("_when", "_kind")
    both = both.withColumn(f"event_{name}_last", F.last("_at", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if known_in_advance:
        both = both.withColumn(f"event_{name}_next", F.first("_at", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    return both.where("_kind = 1").drop("_at", "_when", "_kind")


def exogenous(bars: DataFrame, series: DataFrame, name: str, lag_minutes: int = 0) -> DataFrame:
    """Adds ``exogenous_<name>_value`` and ``exogenous_<name>_at`` of the last value published by ts_close.

    ``series`` has ``ts_event``, ``value`` and perhaps ``symbol``; a value is
    published ``lag_minutes`` after its instant. A value that is not finite is
    carried as undefined.
    """
    if lag_minutes < 0:
        raise ValueError("a publication lag cannot be negative")
    clean = F.when(F.abs("value") <= 1.7976931348623157e308, F.col("value").cast("double"))
    seen = series.select(F.struct(F.col("ts_event").cast("timestamp").alias("at"), clean.alias("value")).alias("_seen"), *(["symbol"] if "symbol" in series.columns else []))
    seen = _tagged(bars, seen).withColumn("_when", F.col("_seen.at") + F.expr(f"INTERVAL {lag_minutes} MINUTE")).withColumn("_kind", F.lit(0))
    both = bars.withColumn("_seen", F.lit(None).cast(seen.schema["_seen"].dataType)).withColumn("_when", F.col("ts_close")).withColumn("_kind", F.lit(1))
    both = both.unionByName(seen, allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy("_when", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_now", F.last("_seen", ignorenulls=True).over(order)).where("_kind = 1")
    return both.withColumn(f"exogenous_{name}_value", F.col("_now.value")).withColumn(f"exogenous_{name}_at", F.col("_now.at")).drop("_seen", "_when", "_kind", "_now")
