"""A query and its SQL for every primitive, with parameters that a month of hourly bars can warm up.

All bars are compared, those without a value too. The SQL is written on its own,
in ``oracles``.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causeway.functions import registry
from causeway.operators.graph import Graph
from causeway.plans import oracles
from causeway.sources import bars

SMALL = {"window": 10, "slow_window": 12, "signal_window": 4, "slow": 14, "fast": 5, "signal": 4, "seed_multiplier": 4, "lookback": 40, "sum_window": 9, "lookback_multiplier": 5}
OUTPUTS = {"bollinger": "percent", "keltner": "lower", "donchian": "width", "macd": "signal", "ppo": "signal", "pvo": "histogram", "trix": "signal", "klinger": "signal", "stoch": "d", "stoch_rsi": "d", "adx": "adx", "aroon": "oscillator", "vortex": "diff", "pivot": "r2", "heikin_ashi": "open", "fisher": "signal"}
OWN = {"kama": {"slow": 30, "fast": 2}, "ultimate": {"fast": 3, "medium": 6, "slow": 12}, "ppo": {"window": 5}, "pvo": {"window": 5}, "apo": {"window": 5}, "adx": {"window": 5}, "adxr": {"window": 5}, "mass_index": {"window": 3, "sum_window": 3}, "trix": {"window": 5}, "tsi": {"window": 5}, "pmo": {"window": 5}, "klinger": {"window": 5}, "t3": {"window": 5}, "hurst": {"window": 24}, "pwma": {"window": 4}}


def parameters(p: registry.Primitive) -> dict[str, object]:
    known = p.defaults
    out = {k: v for k, v in SMALL.items() if k in known and (known[k] is inspect.Parameter.empty or k not in ("window",))}
    if "window" in known:
        out["window"] = SMALL["window"] if p.name != "returns" else 1
    if p.name in OUTPUTS and "output" in known:
        out["output"] = OUTPUTS[p.name]
    return out | {k: v for k, v in OWN.get(p.name, {}).items() if k in known}


def full(p: registry.Primitive, given: dict[str, object]) -> dict[str, object]:
    """The given parameters and the defaults of the others."""
    return {k: v for k, v in p.defaults.items() if v is not inspect.Parameter.empty} | given


def query(p: registry.Primitive, **given) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = Graph("spark")
        x = p.column(graph, **(given or parameters(p)))
        return graph.apply(bars.events(spark, sf_dir), value=x).selectExpr("symbol", "bar_index", "round(value, 6) + 0D AS value")

    return run


def sql(p: registry.Primitive, **given) -> str:
    return oracles.primitive_sql(p.name, full(p, given or parameters(p)), bars.events_sql())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"prim_{p.name}": query(p) for p in registry.everything().values()}


def oracle_sql() -> dict[str, str]:
    return {f"prim_{p.name}": sql(p) for p in registry.everything().values()}
