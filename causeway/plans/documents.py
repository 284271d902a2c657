"""Run documents: strategy and settings as JSON, checked and turned into a plan."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions import registry
from causeway.operators import asof, metrics, nodes, panel, simulation
from causeway.operators.graph import Graph
from causeway.operators.sessions import Session
from causeway.sources import market

class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Strategy:
    """How a document's strategy becomes columns: ``rules`` of its parameters, or ranks across instruments."""

    rules: Callable[[dict], dict[str, dict]]
    #: One portfolio over all instruments, or one run each.
    together: bool = False
    cross_sectional: bool = False


STRATEGIES: dict[str, Strategy] = {}


def strategy(name: str, version: int = 1, together: bool = False, cross_sectional: bool = False):
    """Registers a strategy: a function from parameters to rules."""

    def register(rules):
        key = f"{name}@{version}"
        if key in STRATEGIES:
            raise ConfigError(f"{key} is already registered")
        STRATEGIES[key] = Strategy(rules, together, cross_sectional)
        return rules

    return register


def _closed(section: str, given: dict, known: dict) -> dict:
    """Only known fields; None as a default marks one that may be left out."""
    if unknown := given.keys() - known.keys() - {"note"}:
        raise ConfigError(f"{section} takes no {', '.join(sorted(unknown))}")
    if missing := [k for k, v in known.items() if v is ... and k not in given]:
        raise ConfigError(f"{section} needs {', '.join(missing)}")
    return {k: given.get(k, v) for k, v in known.items()}


DATA = {"root": ..., "path": ..., "timestamp_column": None, "granularity_minutes": 1, "resample": None, "resample_min_bars": None, "session_only": False, "session": None, "alias": None}
EXECUTION = {"fees": ..., "slippage": ..., "lag_bars": 1, "intrabar_priority": "pessimistic", "max_fill_gap_seconds": None, "margin_policy": "reject", "intraday_margin_ratio": None}
DOCUMENT = {"name": "run", "format": None, "initial_cash": ..., "data": ..., "execution": ..., "strategy": ..., "definitions": {}, "events": [], "exogenous": [], "risk": {}, "panel": {}, "rebalance": {}, "seed": 0, "stop": None, "liquidate_at_end": False, "risk_free_annual": 0.0}


ALLOCATIONS = ("fixed", "equal_weight", "inverse_volatility", "signal")


def read(*paths: str) -> dict:
    """One document, or a strategy and its settings merged."""
    out: dict = {}
    for p in paths:
        part = json.loads(Path(p).read_text())
        if both := out.keys() & part.keys() - {"note", "name"}:
            raise ConfigError(f"both documents have {', '.join(sorted(both))}")
        out |= part
    return out


def check(document: dict) -> dict:
    """The document with its defaults and its definitions expanded; ConfigError or SpecError otherwise."""
    doc = _closed("document", document, DOCUMENT)
    if not doc["initial_cash"] > 0:
        raise ConfigError("initial_cash must be positive")
    if not isinstance(doc["data"], list) or not doc["data"]:
        raise ConfigError("data must be a list of at least one source")
    doc["data"] = [_closed("data", d, DATA) for d in doc["data"]]
    names = [d["alias"] or market.instrument(d["root"])["symbol"] for d in doc["data"]]
    if len(set(names)) < len(names):
        raise ConfigError("two sources have one name")
    doc["execution"] = _closed("execution", doc["execution"], EXECUTION)
    chosen = _closed("strategy", doc["strategy"], {"ref": ..., "params": {}})
    if chosen["ref"] not in STRATEGIES:
        raise ConfigError(f"unknown strategy {chosen['ref']!r}")
    params = nodes.expand(chosen["params"], doc["definitions"])
    used = json.dumps(doc["strategy"])
    if idle := [n for n in doc["definitions"] if f'"$ref": "{n}"' not in used and f'"$ref": "{n}"' not in json.dumps(doc["definitions"])]:
        raise ConfigError(f"definitions that nothing uses: {', '.join(idle)}")
    for name, rule in params.get("rules", {}).items():
        if name not in simulation.RULES:
            raise ConfigError(f"unknown rule {name!r}")
        nodes.compile_node(Graph(), rule)
    if "score" in params:
        nodes.compile_node(Graph(), params["score"])
    if params.get("allocation", "equal_weight") not in ALLOCATIONS:
        raise ConfigError(f"allocation must be one of {', '.join(ALLOCATIONS)}, not {params['allocation']!r}")
    doc["strategy"] = {"ref": chosen["ref"], "params": params}
    return doc


def config_hash(document: dict) -> str:
    """Of the checked document without its notes."""

    def bare(x):
        if isinstance(x, dict):
            return {k: bare(v) for k, v in x.items() if k != "note"}
        return [bare(v) for v in x] if isinstance(x, list) else x

    return hashlib.sha256(json.dumps(bare(check(document)), sort_keys=True).encode()).hexdigest()


def sources(spark: SparkSession, doc: dict) -> DataFrame:
    """The bars of all sources with their side inputs."""
    out = None
    for d in doc["data"]:
        s = d["session"]
        one = market.load(spark, d["path"], d["alias"] or market.instrument(d["root"])["symbol"], d["granularity_minutes"], d["timestamp_column"], None, d["resample"], d["resample_min_bars"], Session(s["start"], s["end"], s["timezone"]) if s else None, d["session_only"])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    for e in doc["events"]:
        out = asof.events(out, market.event_calendar(spark, e["path"]), e["name"], e.get("known_in_advance", False))
    for x in doc["exogenous"]:
        lag = 0 if x.get("horodatee_a_la_publication") else x.get("publication_lag_minutes", 0)
        out = asof.exogenous(out, market.exogenous_series(spark, x["path"]), x["name"], lag)
    return out


def settings(doc: dict, root: str) -> simulation.Run:
    """The simulation's settings for one instrument."""
    spec, e, sizing = market.instrument(root), doc["execution"], doc["risk"].get("sizing", {})
    fees, slip = e["fees"], e["slippage"]
    own = fees.get("per_contract")
    per = own if own is not None else spec["commission"] + spec["exchange_fee"]
    costs = simulation.Costs(
        fee_per_contract=per if fees["kind"] == "per_contract" else 0.0, fee_flat=per if fees["kind"] == "flat" else 0.0,
        slippage_ticks=slip.get("ticks", 0.0) if slip["kind"] == "tick" else 0.0, slippage_bps=slip.get("bps", 0.0) if slip["kind"] == "bps" else 0.0,
    )
    modes = {"equity_fraction": "equity_fraction", "risk_fraction": "per_equity", "vol_target": "column", "signal": "column"}
    return simulation.Run(
        doc["initial_cash"], quantity=sizing.get("contracts") or doc["strategy"]["params"].get("quantity", 1), multiplier=spec["multiplier"], tick_size=spec["tick_size"], lag_bars=e["lag_bars"], pessimistic=e["intrabar_priority"] == "pessimistic",
        initial_margin=spec["initial_margin"], reject_on_margin=e["margin_policy"] == "reject", margin_ratio=e["intraday_margin_ratio"] or 1.0, max_fill_gap_seconds=e["max_fill_gap_seconds"], max_gross_contracts=doc["risk"].get("max_gross_contracts"), liquidate_at_end=doc["liquidate_at_end"],
        sizing=modes.get(sizing.get("kind"), "none"), fraction=sizing.get("fraction") or 0.0, max_contracts=sizing.get("max_contracts"), category=spec["category"], pyramiding=doc["strategy"]["params"].get("pyramiding", False), costs=costs,
    )


for _name, _together in (("rules", False), ("panel_rules", False), ("multi_rules", True)):
    strategy(_name, together=_together)(lambda params: params.get("rules", {}))
strategy("flat")(lambda params: {})
strategy("buy_and_hold")(lambda params: {"entry_long": {"type": "constant", "value": 1}})
for _name in ("ranking", "cross_sectional_momentum"):
    strategy(_name, together=True, cross_sectional=True)(lambda params: {})


@strategy("sma_crossover")
def _crossover(params: dict) -> dict[str, dict]:
    mean = lambda n: {"type": "primitive", "ref": "sma@1", "params": {"window": n}}
    sides = {"fast": mean(params.get("fast", 20)), "slow": mean(params.get("slow", 50))}
    far = {"type": "arith", "op": "*", "left": {"type": "constant", "value": params.get("atr_multiple", 2.0)}, "right": {"type": "primitive", "ref": "atr@1", "params": {"window": params.get("atr_window", 14)}}}
    return {"entry_long": {"type": "crosses_above", **sides}, "exit_long": {"type": "crosses_below", **sides}, "stop_loss": {"type": "arith", "op": "-", "left": {"type": "price"}, "right": far}}


def _rules(doc: dict) -> dict[str, dict]:
    return STRATEGIES[doc["strategy"]["ref"]].rules(doc["strategy"]["params"])


def _reads_state(spec) -> bool:
    if isinstance(spec, dict):
        return str(spec.get("type", "")).partition("@")[0] in ("position", "account") or any(map(_reads_state, spec.values()))
    return isinstance(spec, list) and any(map(_reads_state, spec))


def split(graph: Graph, spec: dict, parts: dict[str, str]) -> dict:
    """Replaces what does not read the position or the account by columns ``part_<n>``.

    Windows of bars over the position's own past are kept by the simulation;
    those of sessions or of other instruments have no form there and are refused.
    """
    if not _reads_state(spec):
        name = f"part_{len(parts)}"
        parts[name] = nodes.compile_node(graph, spec)
        return {"type": "column", "name": name}
    kind = spec["type"].partition("@")[0]
    if kind in ("position", "account"):
        return spec
    plain = kind in ("compare", "arith", "all_of", "any_of", "not", "if_then_else", "math", "min_of", "max_of")
    if not plain and (kind not in simulation.LOOKS_BACK or spec.get("across")):
        raise ConfigError(f"{kind} cannot look back at the position or the account")
    deeper = lambda v: split(graph, v, parts) if isinstance(v, dict) else [split(graph, x, parts) for x in v] if isinstance(v, list) else v
    return {k: deeper(v) if k != "note" else v for k, v in spec.items()}


def _size(graph: Graph, doc: dict) -> str | None:
    """Contracts, or contracts per unit of equity before the multiplier, of the sizing rules that read bars."""
    z = doc["risk"].get("sizing", {})
    if z.get("kind") == "risk_fraction":
        atr = registry.get("atr").column(graph, window=z.get("atr_window", 14))
        return graph.let(f"CASE WHEN {atr} > 0 THEN {float(z['fraction'])} / ({float(z.get('atr_multiple', 2.0))} * {atr}) END")
    if z.get("kind") == "vol_target":
        v = registry.get("volatility").column(graph, window=z.get("vol_window", 20), log=True)
        return graph.let(f"CASE WHEN {v} > 0 THEN {float(z.get('contracts') or 1)} * least({float(z.get('vol_max_multiple', 4.0))}D, {float(z['vol_target'])} / {v}) END")
    return nodes.compile_node(graph, z["signal"]) if z.get("kind") == "signal" else None


def signals(spark: SparkSession, doc: dict) -> tuple[DataFrame, dict[str, dict]]:
    """Bars with the rules' columns, and what is left of rules that read the position or the account.

    A panel strategy is one run; otherwise each instrument is one.
    """
    graph, parts, rest, columns = Graph(), {}, {}, {}
    for name, rule in _rules(doc).items():
        if _reads_state(rule):
            rest[name] = split(graph, rule, parts)
        else:
            columns[name] = nodes.compile_node(graph, rule)
    size = _size(graph, doc)
    out = graph.apply(sources(spark, doc), **columns, **parts, **({"size": size} if size else {}))
    if size and doc["risk"]["sizing"]["kind"] == "risk_fraction":
        each = market.instruments(spark).select("symbol", "multiplier")
        out = out.join(each, "symbol", "left").withColumn("size", F.col("size") / F.coalesce("multiplier", F.lit(1.0))).drop("multiplier")
    panel_run = STRATEGIES[doc["strategy"]["ref"]].together
    return out.withColumn("run_id", F.lit(doc["name"]) if panel_run else F.col("symbol")), rest


def board(spark: SparkSession, doc: dict) -> DataFrame:
    """The panel of the cross-sectional strategies, with ``score``, ``w`` and, where a rebalancing is due, ``direction``."""
    params, graph = doc["strategy"]["params"], Graph()
    price = lambda k: {"type": "price", "lag": k}
    default = {"type": "arith", "op": "-", "left": {"type": "arith", "op": "/", "left": price(params.get("skip", 21)), "right": price(params.get("lookback", 252))}, "right": {"type": "constant", "value": 1}}
    x = nodes.compile_node(graph, params.get("score", default))
    how = params.get("allocation", "equal_weight")
    if how == "inverse_volatility":
        w = graph.let(f"1E0 / nullif({registry.get('volatility').column(graph, window=params.get('vol_window', 20), log=True)}, 0E0)")
    elif how == "fixed":
        cases = " ".join(f"WHEN '{str(k).replace(chr(39), chr(39) * 2)}' THEN {float(v)!r}D" for k, v in params.get("weights", {}).items())
        w = graph.let(f"CASE symbol {cases} ELSE 0D END" if cases else "1E0")
    else:
        w = x if how == "signal" else graph.let("1E0")
    scored = graph.apply(sources(spark, doc), score=x, w=w)
    extra = scored.select("symbol", "ts_close", "score", "w", "bar_index")
    bars_ = panel.panel(scored, doc["panel"].get("align_policy", "drop"), doc["panel"].get("max_ffill_bars"))
    bars_ = bars_.select("symbol", "ts_close", "panel_row", "is_stale", *panel.VALUES).join(extra, ["symbol", "ts_close"], "left")
    ranks = panel.rebalanced(panel.ranked(bars_, "score", params.get("n_long", 1), params.get("n_short", 0)), doc["rebalance"].get("n", 1), doc["rebalance"].get("offset", 0))
    return bars_.join(ranks.select("symbol", "ts_close", "rank", "direction"), ["symbol", "ts_close"], "left")


def targets(spark: SparkSession, doc: dict) -> DataFrame:
    """Real bars with ``target_share``: the signed share of equity that each ranked instrument is to have after a rebalancing."""
    everyone = Window.partitionBy("panel_row")
    rows = board(spark, doc)
    weight = F.when(F.col("direction") != 0, F.abs("w"))
    whole = F.sum(weight).over(everyone)
    gross = float(doc["strategy"]["params"].get("gross", 1.0))
    share = F.when(F.col("direction") == 0, F.lit(0.0)).when(whole > 0, F.lit(gross) * F.col("direction") * F.abs("w") / whole)
    rows = rows.withColumn(simulation.TARGET, F.when(F.col("direction").isNotNull(), share)).where("NOT is_stale")
    return rows.withColumn("run_id", F.lit(doc["name"]))


def picks(spark: SparkSession, doc: dict) -> DataFrame:
    """Ranked and allocated positions at the initial equity, by panel row."""
    due = board(spark, doc).where("direction IS NOT NULL")
    dimension = market.instruments(spark).select("symbol", "multiplier")
    return panel.allocate(due.join(dimension, "symbol", "left"), "w", doc["initial_cash"], doc["strategy"]["params"].get("gross", 1.0), "multiplier")


def run(spark: SparkSession, document: dict) -> dict[str, DataFrame]:
    """equity, fills, trades, counts, performance, activity and exposure of a document's runs; picks of a cross-sectional one."""
    doc = check(document)
    across = STRATEGIES[doc["strategy"]["ref"]].cross_sectional
    rows, rest = (targets(spark, doc), {}) if across else signals(spark, doc)
    if doc["stop"]:
        rows = rows.where(F.col("bar_index") < doc["stop"])
    runs = {d["alias"] or market.instrument(d["root"])["symbol"]: settings(doc, d["root"]) for d in doc["data"]}
    caps = simulation.Limits(**{k: v for k, v in doc["risk"].get("limits", {}).items() if k != "note"})
    # One pass makes all outputs; they are read several times.
    told = simulation.simulate_all(rows, runs, caps, rest, STRATEGIES[doc["strategy"]["ref"]].together).persist()
    out = {kind: simulation.output(told, kind) for kind in simulation.OUTPUTS}
    out |= {"performance": metrics.performance(out["equity"], doc["risk_free_annual"]), "activity": metrics.activity(out["trades"]), "exposure": metrics.exposure(out["equity"], out["fills"])}
    return out | ({"picks": picks(spark, doc)} if across else {})


def walk_forward(spark: SparkSession, document: dict, train: int, test: int) -> dict[str, DataFrame]:
    """Folds of a document whose instruments run each on their own: (folds, summary, equity)."""
    doc = check(document)
    if STRATEGIES[doc["strategy"]["ref"]].together:
        raise ConfigError("walk-forward takes strategies that run each instrument on its own")
    rows, rest = signals(spark, doc)
    runs = {d["alias"] or market.instrument(d["root"])["symbol"]: settings(doc, d["root"]) for d in doc["data"]}
    told = simulation.simulate_all(metrics.folded(rows, train, test), runs, None, rest).persist()
    equity = simulation.output(told, "equity")
    folds = metrics.fold_returns(equity, doc["initial_cash"])
    return {"folds": folds, "summary": metrics.walk_forward_summary(folds, equity, doc["initial_cash"]), "equity": equity}


def variants(document: dict, grid: dict[str, list]) -> list[dict]:
    """The document once for each combination of strategy parameters."""
    out = []
    for values in itertools.product(*grid.values()):
        given = dict(zip(grid, values, strict=True))
        out.append(document | {"name": ",".join(f"{k}={v}" for k, v in given.items()), "strategy": document["strategy"] | {"params": document["strategy"].get("params", {}) | given}})
    return out


def overfitting(spark: SparkSession, documents: list[dict], blocks: int, ignore_inactive: bool = False) -> DataFrame:
    """(split, winner, out_rank, logit) of a choice among documents that differ in parameters; each is one configuration.

    All see the same bars: returns count where every configuration has one.
    """
    if len(documents) < 2:
        raise ConfigError("there is nothing to choose from")
    series = None
    for d in documents:
        equity = run(spark, d)["equity"]
        step = F.lag("equity").over(Window.partitionBy("run_id").orderBy("ts"))
        one = equity.withColumn("_b", step).where("_b > 0").select(F.lit(check(d)["name"]).alias("config"), F.col("ts").alias("position"), (F.col("equity") / F.col("_b") - 1).alias("ret"))
        series = one if series is None else series.unionByName(one)
    return metrics.overfitting(metrics.block_grid(series, blocks, ignore_inactive), blocks)
