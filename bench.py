"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from causeway.operators import nodes, panel, sessions
from causeway.operators.graph import Graph
from causeway.plans import data, runs
from causeway.sources import bars

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

_close = {"type": "price", "field": "close"}
_prim = lambda ref, **p: {"type": "primitive", "ref": ref, "params": p}


_ema = lambda n, x: {"type": "rolling", "stat": "ema", "window": n, "inner": x}
#: A mean of a difference of means of the close, all as rolling nodes.
_macd = _ema(9, {"type": "arith", "op": "-", "left": _ema(12, _close), "right": _ema(26, _close)})
_money = {"type": "arith", "op": "*", "left": _prim("typical_price@1"), "right": {"type": "price", "field": "volume"}}
_so_far = lambda x: {"type": "cumulative", "stat": "sum", "inner": x}
_vwap = {"type": "arith", "op": "/", "left": _so_far(_money), "right": _so_far({"type": "price", "field": "volume"})}


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.index(bars.events(spark, sf_dir, "minute"), data.DAY)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger table: daily bars of every supplier's line items."""
    ticks = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("CAST(l_suppkey AS STRING) AS s", "l_shipdate", "struct(l_orderkey, l_linenumber) AS tie", "l_extendedprice", "l_quantity")
    return bars.from_ticks(ticks, "day", "s", "l_shipdate", "l_extendedprice", "tie", "l_quantity")


def signal(*specs: dict, source=minutes):
    """Bars with one column an expression."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = Graph("spark")
        found = {f"v{i}": nodes.compile_node(g, s) for i, s in enumerate(specs)}
        return g.apply(source(spark, sf_dir), **found)

    return run


_zscore = {"type": "rolling", "stat": "zscore", "window": 120, "inner": {"type": "arith", "op": "-", "left": _prim("sma@1", window=10), "right": _prim("sma@1", window=50)}}
_TWENTY = [_prim(f"{n}@1", window=20) for n in ("sma", "wma", "rsi", "stochastic", "bollinger", "donchian", "atr", "cmo", "roc", "zscore", "stdev", "slope", "vwap", "obv", "mfi", "cmf", "linreg", "chop", "vortex", "hma")]

HEADLINES = {
    "bars_minute": lambda spark, sf_dir: bars.events(spark, sf_dir, "minute"),
    "sma_20": signal(_prim("sma@1", window=20)),
    "ema_20": signal(_prim("ema@1", window=20)),
    "rolling_mean_20": signal({"type": "rolling", "stat": "mean", "window": 20, "inner": _close}),
    "rolling_zscore_120": signal(_zscore),
    "macd_nested": signal(_macd),
    "session_vwap": signal(_vwap),
    "twenty_primitives": signal(*_TWENTY),
    "sma_cross": data.sma_cross,
    "resample_day": data.resampled("day"),
    "panel_ffill": lambda spark, sf_dir: panel.panel(bars.events(spark, sf_dir, "minute"), "ffill", 5),
    "ranking": data.ranking,
    "run_performance": runs.performance,
}


#: The same expressions over the larger table; told beside the headlines, with its number of bars.
LARGE = {
    "sma_20": signal(_prim("sma@1", window=20), source=suppliers),
    "rolling_mean_20": signal({"type": "rolling", "stat": "mean", "window": 20, "inner": _close}, source=suppliers),
    "rolling_zscore_120": signal(_zscore, source=suppliers),
    "macd_nested": signal(_macd, source=suppliers),
}


def timed(spark: SparkSession, queries: dict) -> dict[str, float]:
    out = {}
    for name, query in queries.items():
        began = time.time()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        out[name] = round(time.time() - began, 3)
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    HEADLINES["sma_20"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    times = timed(spark, HEADLINES)
    large = {"bars": suppliers(spark, SF_DIR).count()} | timed(spark, LARGE)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR, "large": large}))


if __name__ == "__main__":
    main()
