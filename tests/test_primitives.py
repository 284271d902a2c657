"""Every primitive and node against SQL that is written on its own."""

from __future__ import annotations

import inspect

import duckdb
import pytest

from causeway.functions import registry
from causeway.operators import nodes
from causeway.operators.graph import Graph
from causeway.plans import data, oracles, primitives
from causeway.sources import bars

SF = "/root/testdata/sf0.001"
BANDS, LINES, DOUBLE, TRAIL = ("upper", "middle", "lower", "width", "percent"), ("line", "signal", "histogram"), ("k", "d"), ("value", "direction")
OUTPUTS = {
    "bollinger": BANDS, "keltner": BANDS, "donchian": BANDS, "envelope": BANDS, "acceleration_bands": BANDS, "macd": LINES, "ppo": LINES, "pvo": LINES, "trix": LINES, "klinger": LINES, "fisher": LINES,
    "stoch": DOUBLE, "stoch_rsi": DOUBLE, "adx": ("adx", "plus_di", "minus_di"), "aroon": ("up", "down", "oscillator"), "vortex": ("plus", "minus", "diff"),
    "pivot": ("pp", "r1", "r2", "r3", "s1", "s2", "s3"), "heikin_ashi": ("close", "open", "high", "low"), "psar": TRAIL, "supertrend": TRAIL,
}
OTHER = {"window": 6, "field": "high", "slow_window": 9, "signal_window": 3, "slow": 9, "fast": 4, "signal": 3, "medium": 6, "seed_multiplier": 3, "lookback": 17, "sum_window": 5, "lookback_multiplier": 3, "fast_window": 2, "ddof": 0, "multiplier": 1.5, "lag": 2, "q": 0.3, "bins": 5, "log": True, "smooth_k": 2, "smooth_d": 4, "threshold": 0.01, "percent": 4.0, "offset": 0.6, "sigma": 4.0, "volume_factor": 0.5, "annualise": 252.0, "step": 0.03, "factor": 2.0}


def cases():
    for p in registry.everything().values():
        given = {k: v for k, v in OTHER.items() if k in p.defaults}
        if p.name == "hurst":
            given["window"] = 20
        if p.name == "volatility":
            given.pop("log")
        for output in OUTPUTS.get(p.name, (None,)):
            yield p, given | ({"output": output} if output else {})


CASES = list(cases())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


@pytest.fixture(scope="module")
def hours(spark):
    return bars.events(spark, SF).cache()


def same(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None), (k, got[k], v)
        assert v is None or float(got[k]) == pytest.approx(float(v), rel=1e-6, abs=2e-6), k


@pytest.mark.parametrize("part", range(6))
def test_other_parameters_and_every_output(spark, duck, hours, part):
    mine = CASES[part::6]
    graph = Graph()
    columns = {f"v{i}": p.column(graph, **given) for i, (p, given) in enumerate(mine)}
    rows = graph.apply(hours, **columns).collect()
    for i, (p, given) in enumerate(mine):
        got = {(r["symbol"], r["bar_index"]): r[f"v{i}"] for r in rows}
        want = {(a, b): v for a, b, v in duck.sql(primitives.sql(p, **given)).fetchall()}
        try:
            same(got, want)
        except AssertionError as e:
            raise AssertionError(f"{p.key} {given}: {e}") from e


#: Hours of prices, among them 0, negative ones and none.
ODD_HOURS = [(5.0, 7.0, 3.0, 4.0), (5.0, 0.0, 4.0), (0.0, 6.0, 2.0), (3.0, 8.0, 0.0), (0.0,), (-2.0, 3.0, 4.0), (-4.0, -6.0, -3.0), (None,), (2.0, 0.0, 9.0, 2.0), (-1.0, 0.0, 2.0), (1.0, 5.0, 0.0)]
ODD_GAP = 12


@pytest.mark.parametrize("name", ["garman_klass", "parkinson", "rogers_satchell"])
def test_prices_of_zero_or_less(spark, tmp_path, name):
    """Infinite, undefined and missing values are those of the SQL, each alone in its windows and all together."""
    rows, hour = [], 0
    for gap in (ODD_GAP, 0):
        for odd in ODD_HOURS:
            plain = [(10.0 + k % 3, 12.0 + k % 5, 9.0, 11.0 + k % 2) for k in range(gap)]
            for prices in [*plain, odd]:
                rows += [(len(rows) + i, hour * 3600 + 60 * i, v) for i, v in enumerate(prices)]
                hour += 1
    made = spark.createDataFrame(rows, "event_id long, s long, value double")
    made.selectExpr("event_id", "timestamp_seconds(s)::timestamp_ntz AS ts", "'a' AS event_type", "value").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {(a, b): str(v) for a, b, v in con.sql(primitives.oracle_sql()[f"prim_{name}"]).fetchall()}
    assert len(want) == hour and {"inf", "nan", "None"} < set(want.values())
    assert {(r["symbol"], r["bar_index"]): str(r["value"]) for r in primitives.queries()[f"prim_{name}"](spark, str(tmp_path)).collect()} == want


def test_every_output_is_tried():
    for p in registry.everything().values():
        if "output" in p.defaults and p.name not in OUTPUTS:
            # These take the parameter and have one output whatever it says.
            assert p.name in ("squeeze", "apo", "tsi", "pmo", "coppock", "smi"), p.name
    assert {p.name for p, _ in CASES} == set(oracles.FORMULAS)
    assert all(v is not inspect.Parameter.empty for p, given in CASES for v in primitives.full(p, given).values())


@pytest.mark.parametrize("part", range(4))
def test_documents(spark, duck, part):
    documents = {**data.DOCUMENTS, **{f"nested {k}": v for k, v in data.NESTED.items()}}
    mine = {k: v for i, (k, v) in enumerate(documents.items()) if i % 4 == part and data._needs(v) == "session"}
    graph = Graph()
    columns = {f"v{i}": nodes.compile_node(graph, v) for i, v in enumerate(mine.values())}
    rows = graph.apply(data._source(spark, SF), **columns).collect()
    for i, (name, spec) in enumerate(mine.items()):
        got = {(r["symbol"], r["bar_index"]): r[f"v{i}"] for r in rows}
        want = {(a, b): v for a, b, v in duck.sql(data.node_sql(spec)).fetchall()}
        try:
            same(got, want)
        except AssertionError as e:
            raise AssertionError(f"{name}: {e}") from e
