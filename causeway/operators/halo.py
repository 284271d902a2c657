"""Splitting long series: windows of bounded length without one task a symbol.

A symbol's bars are numbered in two steps (counts of time buckets, then places
inside each), so that no task needs a whole symbol; a graph evaluates windows
that look back a bounded number of bars over chunks of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.graph import Graph


def with_bar_index(bars: DataFrame, bucket: str = "month") -> DataFrame:
    """``bar_index`` of each symbol from 0, from the sizes of its time buckets."""
    keyed = bars.withColumn("_bucket", F.date_trunc(bucket, "ts_close"))
    sizes = keyed.groupBy("symbol", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("symbol").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("symbol", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("symbol", "_bucket").orderBy("ts_close")) - 1
    return keyed.withColumn("_place", place).join(starts, ["symbol", "_bucket"]).withColumn("bar_index", (F.col("_start") + F.col("_place")).cast("long")).drop("_bucket", "_place", "_start")


def evaluate(bars: DataFrame, build: Callable[[Graph], dict[str, str]], chunk: int = 100_000) -> DataFrame:
    """Columns of a graph over chunks of at least ``chunk`` bars; ``build`` adds them to the graph and returns the outputs."""
    graph = Graph("spark")
    return graph.apply(bars, chunk=chunk, **build(graph))
