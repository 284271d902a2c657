"""Market files: OHLCV scans, side inputs, instruments, synthetic ticks and the archive of trials."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, TimestampType

from causeway.operators import sessions as _sessions
from causeway.operators import validation
from causeway.operators.resample import resample
from causeway.operators.halo import with_bar_index

# Names under which a timestamp column is known.
TIMESTAMP_NAMES = ("ts_event", "timestamp", "time", "datetime", "ts")
PRICES = ("open", "high", "low", "close", "volume")

# Symbol, root, name, exchange, currency, multiplier, tick size, commission and exchange fee per contract, initial and maintenance margin, class.
INSTRUMENTS = (
    ("ES.v.0", "ES", "S&P 500", "CME", "USD", 50.0, 0.25, 0.85, 1.45, 17000.0, 15500.0, "indices"),
    ("NQ.v.0", "NQ", "Nasdaq 100", "CME", "USD", 20.0, 0.25, 0.85, 1.45, 27000.0, 24500.0, "indices"),
    ("YM.v.0", "YM", "Dow Jones", "CBOT", "USD", 5.0, 1.0, 0.85, 1.45, 11000.0, 10000.0, "indices"),
    ("FDAX.v.0", "FDAX", "DAX 40", "EUREX", "EUR", 25.0, 0.5, 1.0, 0.5, 33000.0, 30000.0, "indices"),
    ("GC.v.0", "GC", "Or", "COMEX", "USD", 100.0, 0.1, 0.85, 1.6, 15000.0, 13500.0, "metaux"),
    ("CL.v.0", "CL", "Petrole WTI", "NYMEX", "USD", 1000.0, 0.01, 0.85, 1.6, 6500.0, 5900.0, "energie"),
    ("6E.v.0", "6E", "EUR/USD", "CME", "USD", 125000.0, 0.00005, 0.85, 1.6, 3000.0, 2700.0, "forex"),
    ("6B.v.0", "6B", "GBP/USD", "CME", "USD", 62500.0, 0.0001, 0.85, 1.6, 2500.0, 2250.0, "forex"),
    ("6J.v.0", "6J", "USD/JPY", "CME", "USD", 12500000.0, 0.0000005, 0.85, 1.6, 4000.0, 3600.0, "forex"),
    ("6A.v.0", "6A", "AUD/USD", "CME", "USD", 100000.0, 0.00005, 0.85, 1.6, 2000.0, 1800.0, "forex"),
)
_INSTRUMENT_COLUMNS = "symbol string, root string, name string, exchange string, currency string, multiplier double, tick_size double, commission double, exchange_fee double, initial_margin double, maintenance_margin double, category string"


class SourceError(ValueError):
    pass


def instruments(spark: SparkSession) -> DataFrame:
    """The instrument dimension: a fixed, small table."""
    return spark.createDataFrame(INSTRUMENTS, _INSTRUMENT_COLUMNS)


def instrument(key: str) -> dict[str, object]:
    """One instrument by symbol or root."""
    names = [c.split()[0] for c in _INSTRUMENT_COLUMNS.split(", ")]
    for row in INSTRUMENTS:
        if key in row[:2]:
            return dict(zip(names, row, strict=True))
    raise SourceError(f"unknown instrument {key!r}")


def data_path(path: str, variable: str = "CAUSEWAY_DATA") -> str:
    """A relative path lies in the folder that the variable names; there is no other place to look."""
    if path.startswith("/") or "://" in path:
        return path
    root = os.environ.get(variable)
    if not root:
        raise SourceError(f"{path!r} is relative and {variable} is not set")
    return f"{root.rstrip('/')}/{path}"


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with Path(path).open("rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def path_sha256(path: str) -> str:
    """Of a file, or of the names and hashes of a folder's files in order."""
    at = Path(path)
    if at.is_file():
        return file_sha256(path)
    whole = hashlib.sha256()
    for f in sorted(x for x in at.rglob("*") if x.is_file()):
        whole.update(f"{f.relative_to(at)} {file_sha256(str(f))}\n".encode())
    return whole.hexdigest()


def _instant(df: DataFrame, column: str) -> F.Column:
    """Nanosecond longs and timestamps with or without zone, read as UTC."""
    kind = df.schema[column].dataType
    if isinstance(kind, LongType):
        return F.timestamp_micros(F.expr(f"`{column}` DIV 1000"))
    return F.col(column) if isinstance(kind, TimestampType) else F.col(column).cast("timestamp")


def timestamp_column(columns: list[str], explicit: str | None = None) -> str:
    """The declared column, or the only one with a known name."""
    if explicit is not None:
        if explicit not in columns:
            raise SourceError(f"no column {explicit!r}")
        return explicit
    found = [c for c in TIMESTAMP_NAMES if c in columns]
    if len(found) != 1:
        raise SourceError(f"{'no' if not found else 'more than one'} timestamp column: {', '.join(found or columns)}")
    return found[0]


def read_ohlcv(spark: SparkSession, path: str, timestamp: str | None = None) -> DataFrame:
    """ts_event and the five values of a Parquet file, unsorted and unjudged."""
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    df = spark.read.parquet(path)
    name = timestamp_column(df.columns, timestamp)
    return df.select(_instant(df, name).alias("ts_event"), *(F.col(c) for c in PRICES if c in df.columns))


def load(spark: SparkSession, path: str, symbol: str, minutes: int = 1, timestamp: str | None = None, limits: validation.Limits | None = None, period: str | None = None, min_bars: int | None = None, session: _sessions.Session | None = None, session_only: bool = False) -> DataFrame:
    """Validated bars of one instrument, resampled and kept to the session if asked."""
    bars = read_ohlcv(spark, data_path(path), timestamp).withColumn("symbol", F.lit(symbol))
    bars = validation.accepted(bars, limits).withColumn("ts_close", F.col("ts_event") + F.expr(f"INTERVAL {minutes} MINUTE"))
    if period:
        bars = resample(bars, period, min_bars, session=session if period not in ("day", "week", "month", "quarter", "year") else None).drop("bars")
    if session and session_only:
        bars = _sessions.inside(_sessions.index(bars, session)).drop("session_open", "session_close", "session_number", "bar_in_session", "minutes_from_open", "is_first", "is_last")
    bars = with_bar_index(bars)
    return _sessions.index(bars, session) if session else bars


def event_calendar(spark: SparkSession, path: str) -> DataFrame:
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    df = spark.read.parquet(data_path(path))
    return df.select(_instant(df, "ts_event").alias("ts_event"))


def exogenous_series(spark: SparkSession, path: str) -> DataFrame:
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    df = spark.read.parquet(data_path(path))
    return df.select(_instant(df, "ts_event").alias("ts_event"), "value")


def ticks(bars: DataFrame, pessimistic: bool = True) -> DataFrame:
    """Four synthetic ticks a bar: open, the two extremes, close.

    They lie just after the opening, at either third and just before the close.
    Pessimistic is adverse to a long position: the low comes first. Each has a
    quarter of the volume, 1 at least.
    """
    first, second = ("low", "high") if pessimistic else ("high", "low")
    begin, end = F.unix_micros("ts_event"), F.unix_micros("ts_close")
    third = F.floor((end - begin) / 3)
    at = (begin + 1, begin + third, begin + 2 * third, end - 1)
    rows = F.array(*(F.struct(F.timestamp_micros(t).alias("ts"), F.col(p).alias("price")) for t, p in zip(at, ("open", first, second, "close"), strict=True)))
    part = F.greatest(F.col("volume") / 4, F.lit(1.0))
    return bars.select("symbol", "bar_index", part.alias("size"), F.posexplode(rows).alias("rank", "tick")).select("symbol", "bar_index", "rank", "tick.ts", "tick.price", "size")


def archive(trials: DataFrame, path: str) -> int:
    """Appends (config, result, ...) to the archive; returns how many were new.

    The same configuration with the same result is a check, not a trial, and is
    refused; with another result it is kept as a divergence.
    """
    spark = trials.sparkSession
    new = trials.dropDuplicates(["config", "result"])
    try:
        known = spark.read.parquet(path).select("config", "result")
    except Exception as e:  # a first archive has no folder yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    if known is not None:
        new = new.join(known, ["config", "result"], "left_anti")
    new = new.persist()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n
