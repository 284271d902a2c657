"""Several instruments on the union of their closing instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VALUES = ("open", "high", "low", "close", "volume")


class AlignmentError(ValueError):
    """An instrument lacks a row that the policy demands."""


def panel(bars: DataFrame, policy: str = "drop", max_ffill_bars: int | None = None) -> DataFrame:
    """Adds ``panel_row`` (rank of the instant in the union calendar) and ``is_stale``.

    drop: absent rows stay absent. ffill: rows missing after a symbol's first
    bar repeat its last one for at most ``max_ffill_bars`` calendar rows, marked
    stale. error: refuses a panel with a hole.
    """
    if policy not in ("drop", "ffill", "error"):
        raise ValueError(f"unknown policy {policy!r}")
    instants = bars.select("ts_close").distinct()
    # Few rows a symbol-instant: the calendar alone is ranked, not the bars.
    calendar = instants.withColumn("panel_row", F.expr("CAST(row_number() OVER (ORDER BY ts_close) - 1 AS BIGINT)"))
    if policy == "drop":
        return bars.join(calendar, "ts_close").withColumn("is_stale", F.lit(False))
    placed = bars.select("symbol", "ts_close", *VALUES).join(calendar, "ts_close")
    if policy == "error":
        # Every symbol must have as many bars as the calendar has rows.
        holes = placed.agg((F.count_distinct("symbol") * F.count_distinct("panel_row") - F.count(F.lit(1))).alias("n")).first()["n"]
        if holes:
            raise AlignmentError(f"{holes} rows of the panel have no bar")
        return placed.withColumn("is_stale", F.lit(False))
    # A bar stands for itself and for the empty rows up to the next one, as far as it may: only rows that stay are made.
    following = F.lead("panel_row").over(Window.partitionBy("symbol").orderBy("panel_row"))
    rows = calendar.agg(F.max("panel_row").alias("_rows"))
    until = F.coalesce(F.col("_next"), F.col("_rows") + 1) - 1
    until = until if max_ffill_bars is None else F.least(until, F.col("panel_row") + max_ffill_bars)
    spread = placed.withColumn("_next", following).join(F.broadcast(rows)).withColumn("_row", F.explode(F.sequence("panel_row", until)))
    stamped = spread.select("symbol", F.col("_row").alias("panel_row"), (F.col("_row") > F.col("panel_row")).alias("is_stale"), *VALUES)
    return stamped.join(calendar, "panel_row").select("symbol", "ts_close", "panel_row", "is_stale", *VALUES)


def ranked(df: DataFrame, score: str, n_long: int, n_short: int) -> DataFrame:
    """Cross-sectional picks: +1 for the best, -1 for the last, of each ``panel_row``.

    Ties go by symbol. Rows without a score do not count; an instant with fewer
    than n_long + n_short scores has no picks. Adds ``rank`` and ``direction``.
    """
    order = Window.partitionBy("panel_row").orderBy(F.col(score).desc(), "symbol")
    everyone = Window.partitionBy("panel_row")
    out = df.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(everyone))
    out = out.where(F.col("_n") >= n_long + n_short)
    return out.withColumn("direction", F.when(F.col("rank") <= n_long, 1).when(F.col("rank") > F.col("_n") - n_short, -1).otherwise(0)).drop("_n")


def allocate(df: DataFrame, weight: str, equity: float, gross: float, multiplier: str | float = 1.0) -> DataFrame:
    """Contracts by normalised weights: trunc(equity * gross * share / (close * multiplier)).

    Takes rows with a ``direction``; adds ``share``, ``contracts`` and ``truncated``
    (a wanted position that came to no contract).
    """
    whole = F.sum(F.abs(F.col(weight))).over(Window.partitionBy("panel_row"))
    out = df.where("direction <> 0").withColumn("share", F.when(whole > 0, F.abs(F.col(weight)) / whole))
    m = F.col(multiplier) if isinstance(multiplier, str) else F.lit(float(multiplier))
    out = out.withColumn("contracts", (F.lit(float(equity * gross)) * F.col("share") / (F.col("close") * m)).cast("long") * F.col("direction"))
    return out.withColumn("truncated", F.col("contracts") == 0)


def rebalanced(df: DataFrame, every: int = 1, offset: int = 0) -> DataFrame:
    """Panel rows on which a schedule acts."""
    return df.where((F.col("panel_row") >= offset) & ((F.col("panel_row") - offset) % every == 0))
