"""Declared trading sessions: which session a bar belongs to, and its place there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Session:
    """Local opening and closing times; a close at or before the opening is on the next day."""

    start: str
    end: str
    timezone: str = "UTC"

    def __post_init__(self):
        for x in (self.start, self.end):
            h, _, m = x.partition(":")
            if not (h.isdigit() and m.isdigit() and int(h) < 24 and int(m) < 60):
                raise ValueError(f"{x!r} is not a time of day, HH:MM")

    @property
    def overnight(self) -> bool:
        return self.end <= self.start


def index(bars: DataFrame, session: Session) -> DataFrame:
    """Adds session_open, session_close, session_number, bar_in_session, minutes_from_open, is_first, is_last.

    There is one session a calendar day of the zone; a bar belongs to the last
    one that opened at or before its close. Numbers are dense over the sessions
    that have bars. ``is_last`` is the first bar at or after the session's
    close, and may be missing. All of it is row arithmetic and windows over the
    symbol, so nothing is joined.
    """
    zone = session.timezone

    def at(day: str, clock: str) -> str:
        h, m = clock.split(":")
        return f"to_utc_timestamp(CAST({day} AS TIMESTAMP) + INTERVAL {int(h)} HOUR + INTERVAL {int(m)} MINUTE, '{zone}')"

    out = bars.withColumn("_day", F.expr(f"CAST(from_utc_timestamp(ts_close, '{zone}') AS DATE)"))
    out = out.withColumn("_day", F.expr(f"CASE WHEN {at('_day', session.start)} <= ts_close THEN _day ELSE date_sub(_day, 1) END"))
    out = out.withColumn("session_open", F.expr(at("_day", session.start)))
    out = out.withColumn("session_close", F.expr(at("date_add(_day, 1)" if session.overnight else "_day", session.end))).drop("_day")
    return out.selectExpr(
        "*",
        "CAST(dense_rank() OVER (PARTITION BY symbol ORDER BY session_open) - 1 AS BIGINT) AS session_number",
        "CAST(row_number() OVER (PARTITION BY symbol, session_open ORDER BY ts_close) - 1 AS BIGINT) AS bar_in_session",
        "(unix_micros(ts_close) - unix_micros(session_open)) / 60000000D AS minutes_from_open",
        "row_number() OVER (PARTITION BY symbol, session_open ORDER BY ts_close) = 1 AS is_first",
        "ts_close >= session_close AND row_number() OVER (PARTITION BY symbol, session_open, ts_close >= session_close ORDER BY ts_close) = 1 AS is_last",
    )


def index_sql(source: str, session: Session) -> str:
    """The same in DuckDB, for sessions in UTC."""
    if session.timezone != "UTC":
        raise ValueError("the SQL form is for UTC")

    def at(day: str, clock: str) -> str:
        h, m = clock.split(":")
        return f"(CAST({day} AS TIMESTAMP) + INTERVAL {int(h)} HOUR + INTERVAL {int(m)} MINUTE)"

    close = at("(day + 1)" if session.overnight else "day", session.end)
    return (
        "(SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY session_open) - 1 AS session_number, "
        "row_number() OVER (PARTITION BY symbol, session_open ORDER BY ts_close) - 1 AS bar_in_session, "
        "date_diff('second', session_open, ts_close) / 60.0 AS minutes_from_open, "
        "row_number() OVER (PARTITION BY symbol, session_open ORDER BY ts_close) = 1 AS is_first, "
        "ts_close >= session_close AND row_number() OVER (PARTITION BY symbol, session_open, ts_close >= session_close ORDER BY ts_close) = 1 AS is_last FROM "
        f"(SELECT *, {at('day', session.start)} AS session_open, {close} AS session_close FROM "
        f"(SELECT *, CASE WHEN {at('CAST(ts_close AS DATE)', session.start)} <= ts_close THEN CAST(ts_close AS DATE) ELSE CAST(ts_close AS DATE) - 1 END AS day FROM {source})))"
    )


def inside(bars: DataFrame) -> DataFrame:
    """Bars that close after the opening and up to the close of their session."""
    return bars.where("session_open < ts_close AND ts_close <= session_close")
