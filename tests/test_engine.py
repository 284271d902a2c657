"""The engine against DuckDB and against plain loops."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import registry
from causeway.operators import asof, metrics, nodes, panel, resample, sessions, simulation, validation
from causeway.operators.graph import Graph, ema_series, wilder_series
from causeway.plans import catalog, data
from causeway.sources import bars

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def walk(spark):
    """One symbol, 150 bars, as a table and as columns."""
    r = np.random.default_rng(42)
    close = 100 + np.cumsum(r.normal(0, 0.5, 150))
    opened = np.concatenate((close[:1], close[:-1]))
    high, low = np.maximum(opened, close) * 1.002, np.minimum(opened, close) * 0.998
    volume = r.integers(500, 1500, 150).astype(float)
    rows = [("A", i, float(o), float(h), float(l), float(c), float(v)) for i, (o, h, l, c, v) in enumerate(zip(opened, high, low, close, volume, strict=True))]
    df = spark.createDataFrame(rows, "symbol string, bar_index long, open double, high double, low double, close double, volume double")
    start = F.timestamp_seconds(F.lit(1_577_836_800) + F.col("bar_index") * 60)
    df = df.withColumn("ts_event", start).withColumn("ts_close", F.timestamp_seconds(F.lit(1_577_836_860) + F.col("bar_index") * 60))
    return df.cache(), {"open": opened, "high": high, "low": low, "close": close, "volume": volume}


def values(df, ref, **params):
    g = Graph()
    x = registry.get(ref).column(g, **params)
    return [r["v"] for r in g.apply(df, v=x).orderBy("bar_index").collect()]


SAMPLE = ["sma_cross", "resample_day", "resample_session_slices", "session_index_overnight", "panel_ffill", "ranking", "allocation", "validation", "node_cumulative_max_sessions", "node_value_when", "node_event_until", "node_exogenous_value", "node_rolling_across", "prim_adx", "prim_ppo", "prim_hurst", "prim_aroon", "drawdowns", "trial_correlation"]


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)

    def plain(row):
        return tuple(round(float(v), 5) if isinstance(v, float) else v for v in row)

    got = sorted(map(plain, df.select(*names).collect()), key=str)
    want = sorted(map(plain, duck.sql(f"SELECT {', '.join(names)} FROM ({catalog.oracle_sql()[name]})").fetchall()), key=str)
    assert got == want and got


def test_every_primitive_is_there():
    assert len(registry.everything()) == 136
    assert len(nodes.kinds()) == 27
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_recursive_means(walk):
    df, x = walk
    for ref, params, linear in [
        ("ema", {"window": 7}, lambda v: ema_series(v, 7)[-1]),
        ("smma", {"window": 6}, lambda v: wilder_series(v, 6)[-1]),
        ("dema", {"window": 5}, lambda v: 2 * ema_series(v, 5)[-1] - ema_series(ema_series(v, 5), 5)[-1]),
    ]:
        n = registry.get(ref).warmup(**params)
        got = values(df, ref, **params)
        assert got[: n - 1] == [None] * (n - 1)
        assert got[n - 1 :] == pytest.approx([linear(x["close"][i - n + 1 : i + 1]) for i in range(n - 1, 150)])


def test_averages_of_a_constant(spark, walk):
    df = walk[0].withColumn("close", F.lit(7.0)).withColumn("high", F.lit(7.0)).withColumn("low", F.lit(7.0)).withColumn("open", F.lit(7.0))
    for name in ("sma", "ema", "wma", "trima", "swma", "pwma", "alma", "smma", "dema", "tema", "t3", "zlema", "hma", "kama", "vwma", "midpoint", "linreg"):
        assert values(df, name, window=6)[-1] == pytest.approx(7.0), name


def test_kama(walk):
    df, x = walk
    got, n = values(df, "kama", window=8), 41
    for i in range(n - 1, 150, 17):
        v = x["close"][i - n + 1 : i + 1]
        want = v[:9].mean()
        for k in range(9, n):
            path = np.abs(np.diff(v[k - 8 : k + 1])).sum()
            ratio = abs(v[k] - v[k - 8]) / path if path else 0.0
            want += (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (v[k] - want)
        assert got[i] == pytest.approx(want)


def test_parabolic_stop(walk):
    df, x = walk
    got, way = values(df, "psar", lookback=40), values(df, "psar", lookback=40, output="direction")
    for i in range(39, 150, 7):
        h, l = x["high"][i - 39 : i + 1], x["low"][i - 39 : i + 1]
        up, stop, best, speed = True, l[0], h[0], 0.02
        for k in range(1, 40):
            stop += speed * (best - stop)
            stop = min(stop, l[k - 1], l[k]) if up else max(stop, h[k - 1], h[k])
            if (l[k] < stop) if up else (h[k] > stop):
                stop, best, speed, up = best, (l[k] if up else h[k]), 0.02, not up
            elif (h[k] > best) if up else (l[k] < best):
                best, speed = (h[k] if up else l[k]), min(speed + 0.02, 0.2)
        assert got[i] == pytest.approx(stop) and way[i] == (1.0 if up else -1.0)


def test_supertrend(walk):
    df, x = walk
    got = values(df, "supertrend", window=5)
    h, l, c = x["high"], x["low"], x["close"]
    tr = np.concatenate(([np.nan], np.maximum.reduce([h[1:] - l[1:], np.abs(h[1:] - c[:-1]), np.abs(l[1:] - c[:-1])])))
    for i in range(40, 150, 11):
        atr = wilder_series(tr[i - 39 : i + 1], 5)
        middle, close = ((h + l) / 2)[i - 35 : i + 1], c[i - 35 : i + 1]
        top, low, up = middle[0] + 3 * atr[0], middle[0] - 3 * atr[0], True
        for k in range(1, 36):
            a, b = middle[k] + 3 * atr[k], middle[k] - 3 * atr[k]
            top = a if a < top or close[k - 1] > top else top
            low = b if b > low or close[k - 1] < low else low
            up = True if close[k] > top else False if close[k] < low else up
        assert got[i] == pytest.approx(low if up else top)


def test_no_value_depends_on_later_bars(spark, walk):
    """Changing the future leaves every primitive's past alone."""
    df, _ = walk
    spoiled = df
    for name in ("open", "high", "low", "close", "volume"):
        spoiled = spoiled.withColumn(name, F.when(F.col("bar_index") > 120, F.col(name) * 3 + 1).otherwise(F.col(name)))
    g, found = Graph(), {}
    from causeway.plans.primitives import parameters

    for p in list(registry.everything().values())[::4]:
        found[p.name] = p.column(g, **parameters(p))
    a, b = (g.apply(d, **found).where("bar_index <= 120").orderBy("bar_index").select(*found).collect() for d in (df, spoiled))
    assert a == b


def test_refusals():
    with pytest.raises(registry.ParameterError):
        registry.get("sma").column(Graph(), window=0)
    with pytest.raises(registry.ParameterError):
        registry.get("sma").column(Graph(), window=5, extra=1)
    with pytest.raises(registry.RegistryError):
        registry.get("sma@9")
    with pytest.raises(registry.RegistryError):
        registry.primitive("sma", "trend")(lambda g: "x")
    price = {"type": "price"}
    for bad in ({"type": "nothing"}, {"type": "price", "more": 1}, {"type": "compare", "op": "=>", "left": price, "right": price}, {"type": "all_of", "operands": []}, {"type": "session", "field": "is_last", "lag": 1}):
        with pytest.raises(nodes.SpecError):
            nodes.compile_node(Graph(), bad)
    for early in ({"type": "lag", "bars": -1, "inner": price}, {"type": "price", "lag": -2}, {"type": "session", "field": "high"}):
        with pytest.raises(nodes.LookAhead):
            nodes.compile_node(Graph(), early)
    with pytest.raises(nodes.SpecError):
        nodes.expand({"$ref": "a"}, {"a": {"type": "not", "inner": {"$ref": "a"}}})
    assert nodes.expand([{"$ref": "a"}], {"a": price}) == [price]


def test_undefined_is_strict(walk):
    df, _ = walk
    none = {"type": "math", "op": "log", "inner": {"type": "constant", "value": -1}}
    one, zero = {"type": "constant", "value": 1}, {"type": "constant", "value": 0}
    cases = {"a": ({"type": "all_of", "operands": [zero, none]}, None), "b": ({"type": "any_of", "operands": [one, none]}, None), "c": ({"type": "not", "inner": none}, None), "d": ({"type": "max_of", "operands": [one, none]}, None), "e": ({"type": "arith", "op": "%", "left": {"type": "constant", "value": -10}, "right": {"type": "constant", "value": 30}}, 20.0), "f": ({"type": "arith", "op": "/", "left": one, "right": zero}, None), "g": ({"type": "any_of", "operands": [zero, one]}, 1.0)}
    g = Graph()
    row = g.apply(df.limit(1), **{k: nodes.compile_node(g, s) for k, (s, _) in cases.items()}).first()
    assert {k: row[k] for k in cases} == {k: v for k, (_, v) in cases.items()}


def test_sessions_follow_daylight_saving(spark):
    rows = spark.sql("SELECT 'A' AS symbol, ts_close FROM VALUES (TIMESTAMP '2024-03-08 14:31:00'), (TIMESTAMP '2024-03-08 21:00:00'), (TIMESTAMP '2024-03-11 13:31:00'), (TIMESTAMP '2024-03-11 20:00:00'), (TIMESTAMP '2024-03-11 13:29:00') AS t(ts_close)")
    got = {str(r["ts_close"])[5:16]: r for r in sessions.index(rows, sessions.Session("09:30", "16:00", "America/New_York")).collect()}
    assert [got[k]["minutes_from_open"] for k in ("03-08 14:31", "03-11 13:31")] == [1.0, 1.0]
    assert got["03-08 21:00"]["is_last"] and got["03-11 20:00"]["is_last"] and not got["03-11 13:31"]["is_last"]
    assert got["03-11 13:29"]["session_number"] == 1 and got["03-11 13:31"]["session_number"] == 2
    with pytest.raises(ValueError):
        sessions.Session("9h30", "16:00")


def test_resample_refusals(walk):
    df, _ = walk
    for bad in ({"period": "5min"}, {"period": "day", "session": data.DAY}, {"period": "fortnight"}, {"period": "day", "close_stamp": "sometime"}):
        with pytest.raises(ValueError):
            resample.resample(df, **bad)


def test_validation(walk):
    df, _ = walk
    assert validation.accepted(df) is df
    broken = df.withColumn("high", F.when(F.col("bar_index") == 3, F.col("low") - 1).otherwise(F.col("high"))).withColumn("volume", F.when(F.col("bar_index") == 5, -1.0).otherwise(F.col("volume")))
    found = {r["rule"]: r["violations"] for r in validation.check(broken).collect()}
    assert found["high_low_ordering"] == 1 and found["volume_valid"] == 1 and found["prices_finite"] == 0
    with pytest.raises(validation.DataValidationError):
        validation.accepted(broken)
    with pytest.raises(validation.DataValidationError):
        validation.check(df.drop("low"))


def test_own_validation_rules_and_masks(walk):
    df = walk[0]
    validation.validation_rule("no_odd_volume", "warning", "count_if(volume % 2 = 1)")
    try:
        got = {r["rule"]: r["violations"] for r in validation.check(df).collect()}
        assert got["no_odd_volume"] == (walk[1]["volume"] % 2 == 1).sum() and got["prices_finite"] == 0
        with pytest.raises(validation.DataValidationError):
            validation.validation_rule("prices_finite", "error", "0")
    finally:
        validation._OWN.clear()
    assert validation.masked(df, "bar_index < 10").count() == 10
    with pytest.raises(validation.DataValidationError):
        validation.masked(df, "bar_index < 0")


def test_asof_at_the_very_close_counts(spark, walk):
    df, _ = walk
    calendar = spark.sql("SELECT TIMESTAMP '2020-01-01 00:05:00' AS ts_event")
    got = asof.events(df, calendar, "e", True).orderBy("bar_index").collect()
    assert got[3]["event_e_last"] is None and got[3]["event_e_next"] is not None
    assert got[4]["event_e_last"] == got[4]["ts_close"] and got[4]["event_e_next"] is None
    series = spark.sql("SELECT TIMESTAMP '2020-01-01 00:05:00' AS ts_event, CAST('NaN' AS DOUBLE) AS value UNION ALL SELECT TIMESTAMP '2020-01-01 00:01:00', 2D")
    late = asof.exogenous(df, series, "s", 3).orderBy("bar_index").collect()
    assert [late[i]["exogenous_s_value"] for i in (2, 3, 6, 7)] == [None, 2.0, 2.0, None]


def test_panel_with_a_hole(spark, walk):
    df, _ = walk
    both = df.unionByName(df.where("bar_index % 10 < 6").withColumn("symbol", F.lit("B")))
    with pytest.raises(panel.AlignmentError):
        panel.panel(both, "error")
    filled = panel.panel(both, "ffill", 2).where("symbol = 'B'")
    assert filled.where("is_stale").count() == 30 and filled.count() == 120


def bar(i, o, h, l, c, **rules):
    return {"bar_index": i, "ts": 60.0 * i, "open": o, "high": h, "low": l, "close": c, **rules}


def test_orders_fill_a_bar_later():
    run = simulation.Run(1000.0, quantity=2, multiplier=10.0)
    found = simulation.fold([bar(0, 10, 11, 9, 10, entry_long=1.0), bar(1, 12, 13, 11, 13, exit_long=1.0), bar(2, 14, 15, 13, 14), bar(3, 14, 15, 13, 14)], run)
    assert [(f["bar_index"], f["side"], f["price"]) for f in found["fills"]] == [(1, 1, 12), (2, -1, 14)]
    assert found["trades"][0]["gross_pnl"] == 40.0 and [e["equity"] for e in found["equity"]] == [1000, 1020, 1040, 1040]


def test_protections_are_pessimistic():
    rows = [bar(0, 10, 10, 10, 10, entry_long=1.0, stop_loss=8.0, take_profit=12.0), bar(1, 10, 10, 10, 10), bar(2, 10, 13, 7, 9)]
    assert simulation.fold(rows, simulation.Run(1000.0))["fills"][-1]["tag"] == "stop_loss"
    assert simulation.fold(rows, simulation.Run(1000.0, pessimistic=False))["fills"][-1]["tag"] == "take_profit"


def test_limits_slippage_and_flips():
    assert simulation.trigger("limit", 1, 9.5, bar(0, 10, 11, 9, 10)) == 9.5 and simulation.trigger("limit", 1, 9.5, bar(0, 9, 11, 8, 10)) == 9
    assert simulation.trigger("stop", 1, 10.5, bar(0, 10, 11, 9, 10)) == 10.5 and simulation.trigger("stop", -1, 8.0, bar(0, 10, 11, 9, 10)) is None
    run = simulation.Run(1000.0, tick_size=5.0, costs=simulation.Costs(fee_per_contract=1.0, slippage_ticks=1.0))
    found = simulation.fold([bar(0, 10, 11, 9, 10, entry_long=1.0), bar(1, 10, 11, 9, 10, exit_long=1.0, entry_short=1.0), bar(2, 10, 11, 9, 10), bar(3, 8, 8, 8, 8)], run)
    assert [f["price"] for f in found["fills"]] == [11, 9, 9] and found["equity"][-1]["contracts"] == -1
    assert found["equity"][-1]["equity"] == 1000 - 3 - 2 + 1
    with pytest.raises(ValueError):
        simulation.Run(1000.0, lag_bars=0)
    refused = simulation.fold([bar(0, 10, 11, 9, 10, entry_long=1.0), bar(1, 10, 11, 9, 10)], simulation.Run(100.0, initial_margin=200.0))
    assert not refused["fills"]


def test_margin_is_refused_warned_or_reduced():
    rows = [bar(0, 10, 11, 9, 10, entry_long=1.0), bar(1, 10, 11, 9, 10)]
    run = lambda **more: simulation.fold(rows, simulation.Run(100.0, initial_margin=150.0, **more))
    assert run()["fills"] == [] and {c["name"]: c["n"] for c in run()["counts"]} == {"margin": 1}
    warned = run(reject_on_margin=False)
    assert len(warned["fills"]) == 1 and {c["name"]: c["n"] for c in warned["counts"]} == {"margin_short": 1, "margin_warned": 1}
    assert len(run(margin_ratio=0.5)["fills"]) == 1 and run(margin_ratio=0.5)["counts"] == []


def test_selection_statistics(spark):
    assert metrics.probabilistic_sharpe(0.1, 0.1, 100, 0.0, 3.0) == pytest.approx(0.5)
    assert metrics.expected_best_sharpe(0.04, 1) == 0.0 and metrics.expected_best_sharpe(0.04, 100) > metrics.expected_best_sharpe(0.04, 10)
    assert metrics.deflated_sharpe(0.2, 0.01, 50, 500, 0.0, 3.0) < metrics.probabilistic_sharpe(0.2, 0.0, 500, 0.0, 3.0)
    grid = [(f"c{c}", b, math.sin(7 * c + b * b)) for c in range(5) for b in range(6)]
    got = metrics.overfitting(spark.createDataFrame(grid, "config string, block int, sharpe double"), 6).collect()
    import itertools

    table = {(c, b): s for c, b, s in grid}
    for r, inside in zip(sorted(got, key=lambda r: r["split"]), itertools.combinations(range(6), 3), strict=True):
        mean = lambda c, bs: sum(table[c, b] for b in bs) / 3
        names = [f"c{c}" for c in range(5)]
        best = max(names, key=lambda c: mean(c, inside))
        out = [b for b in range(6) if b not in inside]
        assert r["winner"] == best and r["out_rank"] == pytest.approx((sum(mean(c, out) < mean(best, out) for c in names) + 1) / 6)
    assert metrics.walk_forward(10, 4, 2) == [(0, 4, 4, 6), (2, 6, 6, 8), (4, 8, 8, 10)]
    assert metrics.walk_forward(10, 4, 3, anchored=True) == [(0, 4, 4, 7), (0, 7, 7, 10)]


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 500 and df.columns == ["symbol", "bar_index", "close", "sma_fast", "sma_slow", "crossed"]
