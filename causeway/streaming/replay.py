"""Bars from a stream of ticks, and signals over them as they close."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BARS = "symbol string, ts_event timestamp, ts_close timestamp, open double, high double, low double, close double, volume double"


def bars(ticks: DataFrame, unit: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Bars of a stream of (symbol, ts, tie, value); a bar comes out once no tick of it can come any more.

    Ticks later than ``delay`` behind the newest one are dropped.
    """
    grouped = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", unit).alias("w"))
    order = F.struct("ts", "tie")
    found = grouped.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum("value").alias("volume"))
    return found.select("symbol", F.col("w.start").alias("ts_event"), F.col("w.end").alias("ts_close"), "open", "high", "low", "close", "volume")


def crossings(closed: DataFrame, fast: int, slow: int) -> DataFrame:
    """(symbol, ts_close, close, crossed) of bars in the order of their close.

    Keeps the last ``slow`` + 1 closes of a symbol as state: 1 where the fast
    mean has just risen above the slow one, else 0, undefined before the warmup.
    """
    if not 0 < fast < slow:
        raise ValueError("fast must be below slow")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        out = []
        for b in sorted((r for batch in batches for r in batch.itertuples(index=False)), key=lambda r: r.ts_close):
            past = [*past, b.close][-slow - 1 :]
            crossed = None
            if len(past) > slow:
                mean = lambda n, k, p=past: sum(p[len(p) - k - n : len(p) - k]) / n
                crossed = float(mean(fast, 1) <= mean(slow, 1) and mean(fast, 0) > mean(slow, 0))
            out.append((key[0], b.ts_close, b.close, crossed))
        state.update((past,))
        yield pd.DataFrame(out, columns=["symbol", "ts_close", "close", "crossed"])

    return closed.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts_close timestamp, close double, crossed double", "past array<double>", "append", GroupStateTimeout.NoTimeout)
