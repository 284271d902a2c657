"""Files, documents, streams and long series."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway import __main__ as cli
from causeway.functions import registry
from causeway.operators import halo, validation
from causeway.operators.graph import Graph
from causeway.plans import controls, documents, report
from causeway.sources import bars, market
from causeway.streaming import replay

SF = "/root/testdata/sf0.001"


def ohlcv(n, start="2020-01-01", step="1min", seed=1):
    r = np.random.default_rng(seed)
    close = 4000 + np.cumsum(r.normal(0, 2, n)).round(2)
    opened = np.concatenate((close[:1], close[:-1]))
    return pd.DataFrame({"ts_event": pd.date_range(start, periods=n, freq=step, tz="UTC"), "open": opened, "high": np.maximum(opened, close) + 1, "low": np.minimum(opened, close) - 1, "close": close, "volume": r.integers(1, 900, n).astype(float)})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("market")
    frame = ohlcv(400)
    frame.to_parquet(at / "nanos.parquet", coerce_timestamps=None, version="2.6")
    frame.rename(columns={"ts_event": "time"}).to_parquet(at / "es.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    frame.assign(time=frame["ts_event"]).to_parquet(at / "two.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    frame.assign(high=frame["low"] - 1).to_parquet(at / "broken.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    return at


def document(path, **more):
    close = {"type": "price"}
    rules = {"entry_long": {"type": "compare", "op": ">", "left": close, "right": {"$ref": "mean"}}, "exit_long": {"type": "compare", "op": "<", "left": close, "right": {"$ref": "mean"}}}
    base = {"name": "t", "initial_cash": 500_000.0, "data": [{"root": "ES", "path": str(path)}], "execution": {"fees": {"kind": "per_contract"}, "slippage": {"kind": "tick", "ticks": 1.0}}, "strategy": {"ref": "rules@1", "params": {"quantity": 1, "rules": rules}}, "definitions": {"mean": {"type": "primitive", "ref": "sma@1", "params": {"window": 20}}}}
    return base | more


def test_nanoseconds_and_names(spark, folder):
    a, b = (market.read_ohlcv(spark, str(folder / f)) for f in ("nanos.parquet", "es.parquet"))
    assert a.orderBy("ts_event").collect() == b.orderBy("ts_event").collect()
    with pytest.raises(market.SourceError):
        market.read_ohlcv(spark, str(folder / "two.parquet"))
    assert market.read_ohlcv(spark, str(folder / "two.parquet"), "time").count() == 400
    with pytest.raises(validation.DataValidationError):
        market.load(spark, str(folder / "broken.parquet"), "X")
    with pytest.raises(market.SourceError):
        market.data_path("relative.parquet", "NOT_SET_ANYWHERE")


def test_document_runs(spark, folder):
    doc = document(folder / "es.parquet", liquidate_at_end=True)
    out = documents.run(spark, doc)
    equity = [r["equity"] for r in out["equity"].orderBy("bar_index").collect()]
    trades = out["trades"].collect()
    assert len(equity) == 400 and trades
    assert equity[-1] == pytest.approx(500_000 + sum(t["gross_pnl"] - t["fees"] for t in trades))
    assert out["activity"].first()["trades"] == len(trades)


def test_documents_are_closed(folder):
    doc = document(folder / "es.parquet")
    assert documents.config_hash(doc) == documents.config_hash(document(folder / "es.parquet", seed=0))
    for bad in ({"initial_cash": 0}, {"data": []}, {"strategy": {"ref": "none@1"}}, {"more": 1}, {"definitions": {"mean": {"type": "price"}, "idle": {"type": "price"}}}):
        with pytest.raises(ValueError):
            documents.check(doc | bad)


def test_ranking_document(spark, folder):
    doc = document(folder / "es.parquet", definitions={}, strategy={"ref": "ranking@1", "params": {"score": {"type": "primitive", "ref": "roc@1", "params": {"window": 5}}, "n_long": 1, "n_short": 1}})
    doc["data"] = [{"root": r, "path": str(folder / "es.parquet")} for r in ("ES", "NQ", "CL")]
    got = documents.run(spark, doc)["picks"]
    assert {r["direction"] for r in got.collect()} == {1, -1} and got.where("panel_row < 5").count() == 0


def plain_targets(frames, score, every, capital, worth, fee, tick):
    """A ranking of two instruments, the better one held, as a plain loop: equity by bar."""
    cash, held, paid, orders, curve = capital, dict.fromkeys(frames, 0), dict.fromkeys(frames, 0.0), {}, []
    n = len(next(iter(frames.values())))
    for i in range(n):
        for s in sorted(frames):
            o, h, low = (frames[s][k].iloc[i] for k in ("open", "high", "low"))
            if d := orders.pop(s, 0):
                side = 1 if d > 0 else -1
                price = min(max(o + side * tick[s], low), h)
                cash -= fee[s] * abs(d)
                if held[s] * side < 0:  # the loop only closes whole positions or opens them
                    cash += held[s] * worth[s] * (price - paid[s])
                    held[s], d = 0, d + held[s] if abs(d) > abs(held[s]) else 0
                if d:
                    paid[s] = (paid[s] * held[s] + price * d) / (held[s] + d)
                    held[s] += d
        close = {s: frames[s]["close"].iloc[i] for s in frames}
        equity = cash + sum(held[s] * worth[s] * (close[s] - paid[s]) for s in frames)
        curve.append(equity)
        marks = {s: score(frames[s]["close"], i) for s in frames}
        if i % every == 0 and None not in marks.values():
            best = min(frames, key=lambda s: (-marks[s], s))
            for s in frames:
                want = int(equity * 0.9 / (close[s] * worth[s])) if s == best else 0
                if want != held[s]:
                    assert want == 0 or held[s] == 0 or want > held[s], "the loop knows no partial exits"
                    orders[s] = want - held[s]
    return curve


def test_a_ranking_is_filled(spark, tmp_path):
    frames = {}
    for k, root in enumerate(("ES", "NQ")):
        frame = ohlcv(240, seed=40 + k)
        frame.to_parquet(tmp_path / f"{root}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        frames[f"{root}.v.0"] = frame
    score = lambda c, i: None if i < 5 else 100 * (c.iloc[i] / c.iloc[i - 5] - 1)
    doc = document("", definitions={}, initial_cash=300_000.0, strategy={"ref": "ranking@1", "params": {"score": {"type": "primitive", "ref": "roc@1", "params": {"window": 5}}, "n_long": 1, "n_short": 0, "gross": 0.9}}, rebalance={"n": 7})
    doc["data"] = [{"root": r, "path": str(tmp_path / f"{r}.parquet")} for r in ("ES", "NQ")]
    doc["execution"]["margin_policy"] = "warn"
    out = documents.run(spark, doc)
    got = [r["equity"] for r in out["equity"].orderBy("ts").collect()]
    spec = {s: market.instrument(s) for s in frames}
    want = plain_targets(frames, score, 7, 300_000.0, {s: x["multiplier"] for s, x in spec.items()}, {s: x["commission"] + x["exchange_fee"] for s, x in spec.items()}, {s: x["tick_size"] for s, x in spec.items()})
    assert got == pytest.approx(want) and out["fills"].count() > 10
    fixed = doc | {"strategy": {"ref": "ranking@1", "params": doc["strategy"]["params"] | {"allocation": "fixed", "weights": {"ES.v.0": 1.0, "NQ.v.0": 3.0}, "n_long": 2}}}
    shares = documents.targets(spark, documents.check(fixed)).where("target_share > 0").select("symbol", "target_share").distinct().collect()
    assert {r["symbol"]: round(r["target_share"], 9) for r in shares} == {"ES.v.0": 0.225, "NQ.v.0": 0.675}
    with pytest.raises(documents.ConfigError):
        documents.check(doc | {"strategy": {"ref": "ranking@1", "params": {"allocation": "none"}}})


def test_reports_folds_and_findings(spark, folder, tmp_path, capsys):
    doc = document(folder / "es.parquet")
    told = report.report(spark, doc)
    assert told["fingerprint"] == report.fingerprint(documents.run(spark, doc)) != report.fingerprint(documents.run(spark, doc | {"initial_cash": 500_001.0}))
    assert len(told["manifest"]["data"][str(folder / "es.parquet")]) == 64 and told["performance"][0]["points"] == 1
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc))
    report.write(told, str(tmp_path / "report.json"))
    assert cli.main(["verify", str(tmp_path / "report.json"), str(path)]) == 0
    assert cli.main(["walkforward", str(path), "--train", "100", "--test", "60"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()[2:]]
    assert [x["points"] for x in lines[:-1]] == [60] * 5 and lines[-1]["folds"] == 5
    folds = [1 + x["total_return"] for x in lines[:-1]]
    assert lines[-1]["compounded"] == pytest.approx(np.prod(folds) - 1)
    late = {"type": "session", "field": "is_last"}
    rules = {"entry_long": {"type": "compare", "op": "==", "left": {"type": "session", "field": "minutes_from_open"}, "right": {"type": "constant", "value": 0}}, "exit_long": {"type": "any_of", "operands": [late, {"type": "rolling", "stat": "rank", "window": 5, "inner": {"type": "price"}}]}}
    odd = doc | {"definitions": {}, "strategy": {"ref": "rules@1", "params": {"rules": rules}}, "risk": {"sizing": {"kind": "vol_target", "vol_target": 0.1}}}
    odd["data"] = [doc["data"][0] | {"session": {"start": "00:00", "end": "07:00", "timezone": "UTC"}}]
    checked = documents.check(odd)
    codes = [x.code for x in controls.findings(checked, documents.sources(spark, checked))]
    assert codes == ["no_last_bar", "never_minute_zero", "fill_overnight", "volatility_per_bar", "session_runs_on", "rank_in_time"]
    assert controls.findings(documents.check(doc)) == []
    path.write_text(json.dumps(odd))
    assert cli.main(["check", str(path)]) == 2
    grid = documents.variants(doc | {"strategy": {"ref": "sma_crossover@1", "params": {}}, "definitions": {}}, {"fast": [3, 5], "slow": [10, 15]})
    splits = documents.overfitting(spark, grid, 4, ignore_inactive=True)
    assert splits.count() == 6 and len(grid) == 4
    assert documents.run(spark, doc | {"definitions": {}, "strategy": {"ref": "flat@1", "params": {}}})["fills"].count() == 0
    assert cli.main(["example"]) == 0 and documents.check(json.loads(capsys.readouterr().out[-1:] and json.dumps(cli.example())))
    with pytest.raises(documents.ConfigError):
        documents.strategy("flat")(lambda params: {})


def test_command_line(folder, capsys, tmp_path):
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(document(folder / "es.parquet")))
    assert cli.main(["check", str(path)]) == 0 and len(capsys.readouterr().out.strip()) == 64
    path.write_text("{}")
    assert cli.main(["check", str(path)]) == 1
    assert cli.main(["schema"]) == 0 and len(json.loads(capsys.readouterr().out)["$defs"]["node"]["oneOf"]) == 27
    assert len(cli.catalogue()["primitives"]) == 136


def test_halo_is_the_plain_window(spark):
    df = bars.events(spark, SF)
    build = lambda g: {"v": g.let(g.avg(g.avg("close", 5), 7)), "e": registry.get("ema").column(g, window=4)}
    g = Graph()
    plain = g.apply(df, **build(g)).select("symbol", "bar_index", "v", "e")
    for chunk in (50, 13, 9):
        split = halo.evaluate(df, build, chunk).select("symbol", "bar_index", "v", "e")
        assert sorted(map(str, split.where("bar_index >= 20").collect())) == sorted(map(str, plain.where("bar_index >= 20").collect()))
    again = halo.with_bar_index(df.drop("bar_index"), "day")
    assert sorted(again.select("symbol", "ts_close", "bar_index").collect()) == sorted(df.select("symbol", "ts_close", "bar_index").collect())


def test_ticks(spark):
    df = bars.events(spark, SF)
    t = market.ticks(df)
    assert t.count() == 4 * df.count()
    back = t.groupBy("symbol", "bar_index").agg(F.min_by("price", "rank").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "rank").alias("close"))
    assert sorted(back.collect()) == sorted(df.select("symbol", "bar_index", "open", "high", "low", "close").collect())


def test_archive(spark, tmp_path):
    path = str(tmp_path / "trials")
    rows = spark.createDataFrame([("c1", "r1", 0.5), ("c2", "r2", 0.1), ("c2", "r2", 0.1)], "config string, result string, sharpe double")
    assert market.archive(rows, path) == 2 and market.archive(rows, path) == 0
    assert market.archive(spark.createDataFrame([("c1", "other", 0.4)], rows.schema), path) == 1


def test_stream_replays_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), "value")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = replay.bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), delay="30 days")
    query = stream.writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = {(r["symbol"], r["ts_close"]): r["close"] for r in bars.events(spark, SF).collect()}
    got = spark.table("bars_out").collect()
    assert all(batch[r["symbol"], r["ts_close"]] == r["close"] for r in got)
    closed = bars.events(spark, SF).select("symbol", "ts_event", "ts_close", "open", "high", "low", "close", "volume")
    closed.repartition(1).write.parquet(str(tmp_path / "closed"))
    signals = replay.crossings(spark.readStream.schema(closed.schema).parquet(str(tmp_path / "closed")), 5, 20)
    query = signals.writeStream.format("memory").queryName("crossed_out").outputMode("append").option("checkpointLocation", str(tmp_path / "at2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    from causeway.plans import data

    want = {(r["symbol"], r["bar_index"]): r["crossed"] for r in data.sma_cross(spark, SF).collect()}
    index = {(r["symbol"], r["ts_close"]): r["bar_index"] for r in bars.events(spark, SF).collect()}
    found = {(r["symbol"], index[r["symbol"], r["ts_close"]]): r["crossed"] for r in spark.table("crossed_out").collect()}
    assert found == want


def test_rules_that_read_the_position(spark, folder):
    """Out after five bars, whatever the price does."""
    doc = document(folder / "es.parquet", definitions={})
    held = {"type": "compare", "op": ">=", "left": {"type": "position", "field": "bars_held"}, "right": {"type": "constant", "value": 5}}
    doc["strategy"] = {"ref": "rules@1", "params": {"rules": {"entry_long": {"type": "constant", "value": 1}, "exit_long": {"type": "all_of", "operands": [held, {"type": "compare", "op": ">", "left": {"type": "price"}, "right": {"type": "constant", "value": 0}}]}}}}
    trades = documents.run(spark, doc)["trades"].collect()
    assert len(trades) > 50 and {t["closed_bar"] - t["opened_bar"] for t in trades} == {5}
    doc["strategy"]["params"]["rules"]["exit_long"] = {"type": "lag", "bars": 2, "inner": held}
    trades = documents.run(spark, doc)["trades"].collect()
    assert trades and {t["closed_bar"] - t["opened_bar"] for t in trades[:1]} == {7}
    doc["strategy"]["params"]["rules"]["exit_long"] = {"type": "session_lag", "sessions": 1, "inner": held}
    with pytest.raises(documents.ConfigError):
        documents.run(spark, doc)


def test_rules_over_the_positions_past_are_those_over_columns(spark, folder):
    """The stateful evaluation of nodes that look back, against the compiled columns."""
    from causeway.operators import nodes, simulation
    from causeway.plans import data

    df = bars.events(spark, SF).where("symbol = 'click'")
    names = ["lag", "bars_since", "value_when", "crosses_above", "crosses_below", "if_then_else", *(f"rolling_{x}" for x in nodes.STATS), *(k for k in data.DOCUMENTS if k.startswith("rolling_stride_"))]
    graph, parts = Graph(), {}
    held = {"type": "position", "field": "quantity"}
    # The position is 0 at every bar here; adding it makes each leaf a part of the state.
    leaf = lambda x: {"type": "arith", "op": "+", "left": x, "right": held}

    def stateful(x):
        if isinstance(x, list):
            return [stateful(y) for y in x]
        if not isinstance(x, dict):
            return x
        return leaf(x) if x["type"] in ("price", "primitive") else {k: stateful(v) for k, v in x.items()}

    specs = {n: data.DOCUMENTS[n] for n in names}
    columns = {f"want_{n}": nodes.compile_node(graph, x) for n, x in specs.items()}
    rules = {n: documents.split(graph, stateful(x), parts) for n, x in specs.items()}
    rows = [r.asDict() for r in graph.apply(df, **columns, **parts).orderBy("bar_index").collect()]
    pasts, empty = {n: {} for n in names}, {"quantity": 0.0}
    for r in rows:
        for n in names:
            got, want = simulation.evaluate(rules[n], r, empty, {}, pasts[n]), r[f"want_{n}"]
            assert (got is None) == (want is None) and (got is None or got == pytest.approx(float(want), rel=1e-9, abs=1e-9)), (n, r["bar_index"], got, want)


def test_one_portfolio_over_instruments(spark, folder):
    doc = document(folder / "es.parquet", definitions={}, risk={"limits": {"max_positions": 1}, "sizing": {"kind": "vol_target", "vol_target": 0.001, "contracts": 2}})
    doc["data"] = [{"root": r, "path": str(folder / "es.parquet")} for r in ("ES", "NQ")]
    doc["strategy"] = {"ref": "multi_rules@1", "params": {"rules": {"entry_long": {"type": "constant", "value": 1}}}}
    out = documents.run(spark, doc)
    fills = out["fills"].collect()
    assert {f["symbol"] for f in fills} == {"ES.v.0"} and out["equity"].count() == 400
    doc["risk"]["limits"] = {}
    both = documents.run(spark, doc)
    assert {f["symbol"] for f in both["fills"].collect()} == {"ES.v.0", "NQ.v.0"} and both["performance"].count() == 1
