"""Causal resampling of bars to calendar periods or slices of a declared session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators import sessions
from causeway.operators.sessions import Session

CALENDAR = ("day", "week", "month", "quarter", "year")
SLICES = {"5min": 5, "10min": 10, "15min": 15, "30min": 30, "1h": 60, "2h": 120, "4h": 240}


def resample(bars: DataFrame, period: str, min_bars: int | None = None, close_stamp: str = "period_end", session: Session | None = None) -> DataFrame:
    """Bars of a longer period: first open, largest high, smallest low, last close, summed volume, and ``bars``.

    A calendar bucket is that of ``ts_event`` in UTC, and its bar is known at the
    first instant of the next one. A slice counts from its session's opening and
    ends after its duration or with the session, but not before its last bar.
    ``close_stamp`` last_bar dates a bar by the last one in it. Periods under
    ``min_bars`` bars go. One aggregation with map-side partials.
    """
    if close_stamp not in ("period_end", "last_bar"):
        raise ValueError(f"close_stamp {close_stamp!r}")
    if period in CALENDAR:
        if session is not None:
            raise ValueError("a calendar period takes no session")
        keyed = bars.withColumn("_from", F.date_trunc(period, "ts_event"))
        end = F.expr(f"_from + INTERVAL {'3 MONTH' if period == 'quarter' else f'1 {period.upper()}'}")
        keyed = keyed.withColumn("_end", end)
    elif period in SLICES:
        if session is None:
            raise ValueError("a slice of a session needs the session")
        step = SLICES[period] * 60
        at = sessions.index(bars.withColumn("_close", F.col("ts_close")).withColumn("ts_close", F.col("ts_event")), session)
        at = at.withColumn("ts_close", F.col("_close")).drop("_close", "session_number", "bar_in_session", "minutes_from_open", "is_first", "is_last")
        since = F.expr(f"CAST(floor((unix_micros(ts_event) - unix_micros(session_open)) / {step}000000D) AS BIGINT) * {step}000000")
        keyed = at.withColumn("_from", F.timestamp_micros(F.expr("unix_micros(session_open)") + since))
        keyed = keyed.withColumn("_end", F.least(F.expr(f"_from + INTERVAL {step} SECOND"), F.col("session_close")))
    else:
        raise ValueError(f"unknown period {period!r}")
    out = keyed.groupBy("symbol", F.col("_from").alias("ts_event")).agg(
        F.max("_end").alias("_end"), F.max("ts_close").alias("_last"), F.min_by("open", "ts_close").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts_close").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("bars")
    )
    if min_bars:
        out = out.where(F.col("bars") >= min_bars)
    stamp = F.greatest("_end", "_last") if close_stamp == "period_end" else F.col("_last")
    return out.withColumn("ts_close", stamp).select("symbol", "ts_event", "ts_close", "open", "high", "low", "close", "volume", "bars")


def report(bars: DataFrame, period: str, min_bars: int | None = None, session: Session | None = None) -> DataFrame:
    """(symbol, source_bars, periods, dropped, fewest, most): what a resampling does to each symbol.

    ``periods`` are those that stay, and ``fewest`` and ``most`` the bars of one of them.
    """
    every = resample(bars, period, session=session)
    stays = F.col("bars") >= F.lit(min_bars or 1)
    of_kept = F.when(stays, F.col("bars"))
    return every.groupBy("symbol").agg(F.sum("bars").alias("source_bars"), F.count_if(stays).alias("periods"), F.count_if(~stays).alias("dropped"), F.min(of_kept).alias("fewest"), F.max(of_kept).alias("most"))
