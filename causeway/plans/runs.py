"""Simulated runs and their analytics as queries."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import metrics, nodes, sessions, simulation
from causeway.operators.graph import Graph
from causeway.plans import data, documents
from causeway.sources import bars

RUN = simulation.Run(100_000.0, quantity=3, multiplier=5.0, costs=simulation.Costs(fee_per_contract=0.85, slippage_ticks=1.0))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving-average rules with a stop and a target, one run a symbol."""
    g = Graph("spark")
    up, down = (nodes.compile_node(g, data.DOCUMENTS[k]) for k in ("crosses_above", "crosses_below"))
    stop = g.let("close * 0.5D")
    done = g.apply(bars.events(spark, sf_dir), entry_long=up, exit_long=down, stop_loss=stop)
    return done.withColumn("run_id", F.col("symbol"))


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.simulate(signals(spark, sf_dir), RUN)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.simulate(signals(spark, sf_dir), RUN, "trades")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places."""
    return df.select(*(F.expr(f"round({f.name}, 6) + 0D").alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema))


# The same runs in DuckDB, bar by bar: a table of states, each made from the one before.
_FEE, _WORTH, _SLIP = "0.85 * 3", "3 * 5.0", "0.01"
_SIGNALS_SQL = (
    f"b AS (SELECT * FROM {bars.events_sql()}), "
    "m AS (SELECT x.symbol, x.bar_index AS i, x.ts_close, x.open, x.high, x.low, x.close, CASE WHEN x.bar_index >= 4 THEN avg(p.close) FILTER (WHERE p.bar_index > x.bar_index - 5) END AS fast, CASE WHEN x.bar_index >= 19 THEN avg(p.close) END AS slow "
    "FROM b x JOIN b p ON p.symbol = x.symbol AND p.bar_index BETWEEN x.bar_index - 19 AND x.bar_index GROUP BY x.symbol, x.bar_index, x.ts_close, x.open, x.high, x.low, x.close), "
    "sig AS (SELECT n.*, coalesce(n.fast > n.slow AND e.fast <= e.slow, FALSE) AS up, coalesce(n.fast < n.slow AND e.fast >= e.slow, FALSE) AS down FROM m n LEFT JOIN m e ON e.symbol = n.symbol AND e.i = n.i - 1), "
)
_WHOLE_SQL = _SIGNALS_SQL + "seq AS (SELECT symbol AS run_id, i AS bar_index, *, close * 0.5 AS stop_at FROM sig), "
# The same with a stop one mean true range of 14 bars below the close.
_STOPPED_SQL = _SIGNALS_SQL + (
    "t AS (SELECT n.symbol, n.i, CASE WHEN e.i IS NOT NULL THEN greatest(n.high - n.low, abs(n.high - e.close), abs(n.low - e.close)) END AS tr FROM sig n LEFT JOIN sig e ON e.symbol = n.symbol AND e.i = n.i - 1), "
    "atr AS (SELECT a.symbol, a.i, CASE WHEN count(p.tr) = 14 THEN avg(p.tr) END AS atr FROM t a JOIN t p ON p.symbol = a.symbol AND p.i BETWEEN a.i - 13 AND a.i GROUP BY 1, 2), "
    "seq AS (SELECT symbol AS run_id, i AS bar_index, sig.*, close - 1.0 * atr AS stop_at FROM sig JOIN atr USING (symbol, i)), "
)
TRAIN, TEST = 200, 100
_FOLDS_SQL = _SIGNALS_SQL + (
    "n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1), "
    f"seq AS (SELECT symbol || '#' || ((i - {TRAIN}) // {TEST}) AS run_id, i AS bar_index, sig.* REPLACE ((i - {TRAIN}) % {TEST} AS i), close * 0.5 AS stop_at FROM sig JOIN n USING (symbol) WHERE i >= {TRAIN} AND {TRAIN} + ((i - {TRAIN}) // {TEST} + 1) * {TEST} <= n), "
)
# q: contracts held; paid: their price; stop and since: their stop and the bar of their fill; go and leave: orders of the bar before; sold: price of contracts that went on this bar.
_STATES_SQL = (
    "st AS (SELECT run_id, symbol, i, bar_index, 0 AS q, 0.0::DOUBLE AS paid, 0.0::DOUBLE AS stop, 0::BIGINT AS since, 100000.0::DOUBLE AS cash, up AS go, FALSE AS leave, stop_at AS go_stop, NULL::DOUBLE AS sold, 0.0::DOUBLE AS sold_paid, 0::BIGINT AS sold_since, NULL::DOUBLE AS bought, NULL::VARCHAR AS why FROM seq WHERE i = 0 "
    "UNION ALL SELECT run_id, symbol, i, bar_index, q3, CASE WHEN buys THEN bought ELSE paid END, CASE WHEN buys THEN go_stop ELSE stop END, CASE WHEN buys THEN bar_index ELSE since END, "
    f"cash + CASE WHEN sold IS NOT NULL THEN {_WORTH} * (sold - paid) - {_FEE} ELSE 0 END - CASE WHEN buys THEN {_FEE} ELSE 0 END, up AND q3 = 0, down AND q3 > 0, stop_at, sold, paid, since, CASE WHEN buys THEN bought END, why "
    "FROM (SELECT *, go AND (q = 0 OR sold IS NOT NULL) AS buys, CASE WHEN go AND (q = 0 OR sold IS NOT NULL) THEN 3 WHEN sold IS NOT NULL THEN 0 ELSE q END AS q3 FROM ("
    f"SELECT s.run_id, s.symbol, x.i, x.bar_index, x.open, x.close, x.stop_at, x.up, x.down, s.q, s.paid, s.stop, s.since, s.cash, s.go, s.go_stop, least(greatest(x.open + {_SLIP}, x.low), x.high) AS bought, "
    f"CASE WHEN s.q > 0 AND x.bar_index > s.since AND x.low <= s.stop THEN least(greatest(least(s.stop, x.open) - {_SLIP}, x.low), x.high) WHEN s.q > 0 AND s.leave THEN least(greatest(x.open - {_SLIP}, x.low), x.high) END AS sold, "
    "CASE WHEN s.q > 0 AND x.bar_index > s.since AND x.low <= s.stop THEN 'stop_loss' ELSE 'exit_long' END AS why "
    "FROM st s JOIN seq x ON x.run_id = s.run_id AND x.i = s.i + 1))), "
    "eq AS (SELECT st.run_id, st.bar_index, epoch_us(x.ts_close) / 1e6 AS ts, cash + q * 5.0 * (x.close - paid) AS equity, cash, q::BIGINT AS contracts FROM st JOIN seq x ON x.run_id = st.run_id AND x.i = st.i), "
    f"tr AS (SELECT run_id, symbol, sold_since AS opened_bar, bar_index AS closed_bar, 1 AS direction, 3::BIGINT AS max_quantity, {_WORTH} * (sold - sold_paid) AS gross_pnl, CAST(2 * {_FEE} AS DOUBLE) AS fees FROM st WHERE sold IS NOT NULL), "
    f"fi AS (SELECT run_id, symbol, bar_index, -1 AS side, 3::BIGINT AS quantity, sold AS price, CAST({_FEE} AS DOUBLE) AS fee, why AS tag FROM st WHERE sold IS NOT NULL UNION ALL SELECT run_id, symbol, bar_index, 1, 3, bought, {_FEE}, 'entry_long' FROM st WHERE bought IS NOT NULL)"
)
_RUN_SQL = f"WITH RECURSIVE {_WHOLE_SQL}{_STATES_SQL}"
_STOPPED_EQUITY_SQL = f"WITH RECURSIVE {_STOPPED_SQL}{_STATES_SQL} SELECT run_id, bar_index, round(equity, 6) + 0.0 AS equity, contracts FROM eq"
_STOPPED_FILLS_SQL = f"WITH RECURSIVE {_STOPPED_SQL}{_STATES_SQL} SELECT run_id, bar_index, side, round(price, 6) + 0.0 AS price, tag FROM fi"
_EQUITY_SQL = f"{_RUN_SQL} SELECT run_id, bar_index, round(ts, 6) + 0.0 AS ts, round(equity, 6) + 0.0 AS equity, round(cash, 6) + 0.0 AS cash, contracts FROM eq"
_TRADES_SQL = f"{_RUN_SQL} SELECT run_id, symbol, opened_bar, closed_bar, direction, max_quantity, round(gross_pnl, 6) + 0.0 AS gross_pnl, round(fees, 6) + 0.0 AS fees FROM tr"
_FILLS_SQL = f"{_RUN_SQL} SELECT run_id, symbol, bar_index, side, quantity, round(price, 6) + 0.0 AS price, round(fee, 6) + 0.0 AS fee, tag FROM fi"
_PERFORMANCE_SQL = (
    f"{_RUN_SQL}, d AS (SELECT run_id, max(ts) AS ts, arg_max(equity, ts) AS equity FROM eq GROUP BY run_id, floor(ts / 86400)), "
    "s AS (SELECT run_id, count(*) AS points, arg_min(equity, ts) AS first, arg_max(equity, ts) AS last, min(equity) AS least, (max(ts) - min(ts)) / 31556952.0 AS years FROM d GROUP BY 1), "
    "r AS (SELECT run_id, equity / before - 1 AS x FROM (SELECT *, lag(equity) OVER (PARTITION BY run_id ORDER BY ts) AS before FROM d) WHERE before > 0), "
    "c AS (SELECT run_id, avg(x) AS m, stddev_samp(x) AS sd, sqrt(avg(power(least(x, 0), 2))) AS down, stddev_pop(x) AS sp FROM r GROUP BY 1), "
    "k AS (SELECT run_id, avg(power((x - m) / sp, 3)) AS skew, avg(power((x - m) / sp, 4)) AS kurtosis FROM r JOIN c USING (run_id) GROUP BY 1) "
    "SELECT run_id, points, round(first, 6) + 0.0 AS first, round(last, 6) + 0.0 AS last, round((points - 1) / years, 6) + 0.0 AS per_year, round(power(last / first, 1 / years) - 1, 6) + 0.0 AS cagr, "
    "round(sd * sqrt((points - 1) / years), 6) + 0.0 AS volatility, round(m / sd * sqrt((points - 1) / years), 6) + 0.0 AS sharpe, round(m / down * sqrt((points - 1) / years), 6) + 0.0 AS sortino, "
    "round(skew, 6) + 0.0 AS skew, round(kurtosis, 6) + 0.0 AS kurtosis, least <= 0 AS ruined FROM s JOIN c USING (run_id) JOIN k USING (run_id)"
)
_ACTIVITY_SQL = (
    f"{_RUN_SQL}, n AS (SELECT run_id, gross_pnl - fees AS net FROM tr) SELECT run_id, count(*) AS trades, round(sum(net), 6) + 0.0 AS net, round(count_if(net > 0) / count(*), 6) + 0.0 AS hit_rate, "
    "round(sum(net) FILTER (WHERE net > 0) / -sum(net) FILTER (WHERE net < 0), 6) + 0.0 AS profit_factor, round(avg(net) FILTER (WHERE net > 0), 6) + 0.0 AS mean_win, round(avg(net) FILTER (WHERE net < 0), 6) + 0.0 AS mean_loss FROM n GROUP BY 1"
)
_INDEX_SQL = sessions.index_sql(bars.events_sql(), data.DAY)
_HOURLY_SQL = (
    f"{_RUN_SQL}, x AS (SELECT symbol AS run_id, bar_index AS opened_bar, minutes_from_open FROM {_INDEX_SQL}) "
    "SELECT run_id, CAST(floor(minutes_from_open / 60) AS BIGINT) AS hour, count(*) AS trades, round(sum(gross_pnl - fees), 6) + 0.0 AS net FROM tr JOIN x USING (run_id, opened_bar) GROUP BY 1, 2"
)
_EXPOSURE_SQL = (
    f"{_RUN_SQL}, e AS (SELECT run_id, avg(CASE WHEN contracts <> 0 THEN 1.0 ELSE 0.0 END) AS exposure, avg(abs(contracts)) AS mean_contracts, avg(equity) AS mean_equity FROM eq GROUP BY 1), f AS (SELECT run_id, sum(fee) AS fees, sum(quantity * price * 5.0) AS notional FROM fi GROUP BY 1) "
    "SELECT run_id, round(exposure, 6) + 0.0 AS exposure, round(mean_contracts, 6) + 0.0 AS mean_contracts, round(fees, 6) + 0.0 AS fees, round(notional / mean_equity, 6) + 0.0 AS turnover FROM e JOIN f USING (run_id)"
)
_OVERNIGHT_SQL = (
    f"{_RUN_SQL}, x AS (SELECT symbol, bar_index, session_number, open, close FROM {_INDEX_SQL}), g AS (SELECT fi.run_id, CASE WHEN t.session_number <> d.session_number THEN abs(t.open - d.close) END AS gap FROM fi JOIN x t ON t.symbol = fi.symbol AND t.bar_index = fi.bar_index JOIN x d ON d.symbol = fi.symbol AND d.bar_index = fi.bar_index - 1) "
    "SELECT run_id, count(*) AS fills, count(gap) AS crossed, round(count(gap) / count(*), 6) + 0.0 AS share, round(coalesce(avg(gap), 0), 6) + 0.0 AS gap_mean, round(coalesce(median(gap), 0), 6) + 0.0 AS gap_median, round(coalesce(max(gap), 0), 6) + 0.0 AS gap_max FROM g GROUP BY 1"
)
_SILENT_SQL = f"SELECT count(*) AS sessions, CAST(count_if(NOT closed) AS BIGINT) AS without, round(count_if(NOT closed) / count(*), 6) + 0.0 AS share FROM (SELECT symbol, session_number, bool_or(is_last) AS closed FROM {_INDEX_SQL} GROUP BY 1, 2)"
_TRADE_FILLS_SQL = (
    f"{_RUN_SQL} SELECT run_id, symbol, opened_bar, closed_bar, tr.direction, bar_index AS fill_bar, side, quantity, round(price, 6) + 0.0 AS price, tag FROM tr JOIN fi USING (run_id, symbol) JOIN (SELECT symbol, i AS opened_bar, ts_close FROM sig) o USING (symbol, opened_bar) "
    "WHERE bar_index >= opened_bar AND bar_index <= closed_bar AND year(ts_close) = 2024"
)
_FORWARD_SQL = f"WITH RECURSIVE {_FOLDS_SQL}{_STATES_SQL} SELECT run_id, round(arg_max(equity, ts) / 100000.0 - 1, 8) + 0.0 AS total_return, count(*) AS points FROM eq GROUP BY 1"
_FORWARD_SUMMARY_SQL = (
    f"WITH RECURSIVE {_FOLDS_SQL}{_STATES_SQL}, f AS (SELECT split_part(run_id, '#', 1) AS symbol, arg_max(equity, ts) / 100000.0 - 1 AS r FROM eq GROUP BY run_id), "
    "p AS (SELECT split_part(run_id, '#', 1) AS symbol, equity / coalesce(lag(equity) OVER (PARTITION BY run_id ORDER BY ts), 100000.0) - 1 AS x FROM eq) "
    "SELECT symbol, count(*) AS folds, round(count_if(r > 0) / count(*), 6) + 0.0 AS positive_share, round(product(1 + r) - 1, 6) + 0.0 AS compounded, round(max(r), 6) + 0.0 AS best, round(min(r), 6) + 0.0 AS worst, "
    "round(CASE WHEN max(r) > 0 THEN max(r) / CASE WHEN sum(r) > 0 THEN sum(r) ELSE sum(r) FILTER (WHERE r > 0) END END, 6) + 0.0 AS concentration, round(any_value(pooled), 6) + 0.0 AS pooled_sharpe "
    "FROM f JOIN (SELECT symbol, avg(x) / stddev_samp(x) AS pooled FROM p GROUP BY 1) USING (symbol) GROUP BY 1"
)


def stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the strategy sma_crossover@1, whose stop is often touched; all outputs."""
    g = Graph("spark")
    rules = documents.STRATEGIES["sma_crossover@1"].rules({"fast": 5, "slow": 20, "atr_multiple": 1.0})
    done = g.apply(bars.events(spark, sf_dir), **{name: nodes.compile_node(g, rule) for name, rule in rules.items()})
    return simulation.simulate_all(done.withColumn("run_id", F.col("symbol")), RUN)


#: Rules that read the position and the account: out after five bars, in only near the peak of equity.
_STATEFUL = {
    "entry_long": {"type": "all_of", "operands": [data.DOCUMENTS["crosses_above"], {"type": "compare", "op": ">", "left": {"type": "account", "field": "drawdown"}, "right": {"type": "constant", "value": -0.03}}]},
    "exit_long": {"type": "compare", "op": ">=", "left": {"type": "position", "field": "bars_held"}, "right": {"type": "constant", "value": 5}},
}
_STATEFUL_SQL = (
    f"WITH RECURSIVE {_SIGNALS_SQL}seq AS (SELECT symbol AS run_id, * FROM sig), "
    "st AS (SELECT run_id, i, 0 AS q, 0.0::DOUBLE AS paid, 0 AS held, 100000.0::DOUBLE AS cash, 100000.0::DOUBLE AS equity, 100000.0::DOUBLE AS peak, up AS go, FALSE AS leave FROM seq WHERE i = 0 "
    "UNION ALL SELECT run_id, i, q, paid, held, cash, equity, peak, coalesce(up AND ready AND equity / peak - 1 > -0.03 AND (q = 0 OR held >= 5), FALSE), q > 0 AND held >= 5 FROM ("
    "SELECT *, greatest(top, equity) AS peak FROM (SELECT *, cash + q * 5.0 * (close - paid) AS equity FROM ("
    f"SELECT run_id, i, close, up, ready, top, CASE WHEN buys THEN 3 WHEN sells THEN 0 ELSE q END AS q, CASE WHEN buys THEN bought ELSE paid END AS paid, CASE WHEN buys THEN 1 WHEN sells OR q = 0 THEN 0 ELSE held + 1 END AS held, cash + CASE WHEN sells THEN {_WORTH} * (sold - paid) - {_FEE} ELSE 0 END - CASE WHEN buys THEN {_FEE} ELSE 0 END AS cash FROM ("
    f"SELECT s.run_id, x.i, x.close, x.up, x.slow IS NOT NULL AS ready, s.peak AS top, s.q, s.paid, s.held, s.cash, s.leave AND s.q > 0 AS sells, s.go AND (s.q = 0 OR s.leave) AS buys, least(greatest(x.open + {_SLIP}, x.low), x.high) AS bought, least(greatest(x.open - {_SLIP}, x.low), x.high) AS sold "
    "FROM st s JOIN seq x ON x.run_id = s.run_id AND x.i = s.i + 1))))) "
    "SELECT run_id, i AS bar_index, round(equity, 6) + 0.0 AS equity, q::BIGINT AS contracts FROM st"
)


def stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, parts = Graph("spark"), {}
    rest = {name: documents.split(g, rule, parts) for name, rule in _STATEFUL.items()}
    rows = g.apply(bars.events(spark, sf_dir), **parts).withColumn("run_id", F.col("symbol"))
    return simulation.simulate(rows, RUN, "equity", None, rest).select("run_id", "bar_index", "equity", "contracts")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.simulate(signals(spark, sf_dir), RUN, "fills")


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = simulation.simulate_all(signals(spark, sf_dir), RUN)
    return metrics.exposure(simulation.output(told, "equity"), simulation.output(told, "fills"), RUN.multiplier)


def overnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overnight_fills(fills(spark, sf_dir), sessions.index(bars.events(spark, sf_dir), data.DAY))


def silent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sessions_without_close(sessions.index(bars.events(spark, sf_dir), data.DAY))


def fills_of_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fills of the long trades that were opened in 2024."""
    told = simulation.simulate_all(signals(spark, sf_dir), RUN)
    chosen = metrics.filtered_trades(simulation.output(told, "trades"), bars.events(spark, sf_dir), 2024, 1)
    return metrics.trade_fills(chosen, simulation.output(told, "fills")).select("run_id", "symbol", "opened_bar", "closed_bar", "direction", "fill_bar", "side", "quantity", "price", "tag")


def model_of_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = simulation.simulate_all(signals(spark, sf_dir), RUN)
    return metrics.trade_model(simulation.output(told, "trades"), simulation.output(told, "fills"))


def calmar(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = equity(spark, sf_dir)
    return metrics.calmar(metrics.performance(curve), metrics.drawdowns(metrics.daily(curve)))


_MODEL_SQL = (
    f"{_RUN_SQL} SELECT run_id, symbol, opened_bar, closed_bar, closed_bar - opened_bar AS holding, round(i.price, 6) + 0.0 AS entry_price, round(o.price, 6) + 0.0 AS exit_price "
    "FROM tr JOIN fi i USING (run_id, symbol) JOIN fi o USING (run_id, symbol) WHERE i.bar_index = opened_bar AND i.side = 1 AND o.bar_index = closed_bar AND o.side = -1"
)
_CALMAR_SQL = (
    f"{_RUN_SQL}, d AS (SELECT run_id, max(ts) AS ts, arg_max(equity, ts) AS equity FROM eq GROUP BY run_id, floor(ts / 86400)), f AS (SELECT *, equity / max(equity) OVER (PARTITION BY run_id ORDER BY ts) - 1 AS fall FROM d) "
    "SELECT run_id, round((power(arg_max(equity, ts) / arg_min(equity, ts), 31556952.0 / (max(ts) - min(ts))) - 1) / -min(fall), 6) + 0.0 AS calmar FROM f GROUP BY 1"
)


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.simulate(metrics.folded(signals(spark, sf_dir), TRAIN, TEST), RUN)


def forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fold_returns(_folds(spark, sf_dir), RUN.initial_cash).selectExpr("run_id", "round(total_return, 8) + 0D AS total_return", "points")


def forward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = _folds(spark, sf_dir)
    return metrics.walk_forward_summary(metrics.fold_returns(curve, RUN.initial_cash), curve, RUN.initial_cash)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly changes of the symbols as configurations, on the hours that all have."""
    g = Graph("spark")
    x = g.let(f"close - {g.lag('close')}")
    rows = g.apply(bars.events(spark, sf_dir), x=x).where("x IS NOT NULL").select(F.col("symbol").alias("config"), F.unix_micros("ts_close").alias("position"), F.col("x").alias("ret"))
    return metrics.block_grid(rows, BLOCKS).selectExpr("config", "CAST(block AS BIGINT) AS block", "round(sharpe, 6) + 0D AS sharpe")


def trial_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the grid as a trial, all of them archived twice."""
    cells = grid(spark, sf_dir).selectExpr("concat(config, '/', block) AS config", "CAST(sharpe AS STRING) AS result", "sharpe")
    return metrics.trial_log(cells.unionByName(cells))


BLOCKS = 6
_GRID_SQL = (
    f"WITH r AS (SELECT symbol AS config, ts_close, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts_close) AS x FROM {bars.events_sql()}), "
    "c AS (SELECT ts_close FROM r WHERE x IS NOT NULL GROUP BY 1 HAVING count(DISTINCT config) = (SELECT count(DISTINCT config) FROM r)), "
    f"k AS (SELECT ts_close, (row_number() OVER (ORDER BY ts_close) - 1) // ((SELECT count(*) FROM c) // {BLOCKS}) AS block FROM c) "
    f"SELECT config, block, round(avg(x) / stddev_samp(x), 6) + 0.0 AS sharpe FROM r JOIN k USING (ts_close) WHERE block < {BLOCKS} GROUP BY 1, 2"
)


def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falls of the close itself, as a curve that SQL can follow."""
    curve = bars.events(spark, sf_dir).select(F.col("symbol").alias("run_id"), (F.unix_micros("ts_close") / 1e6).alias("ts"), F.col("close").alias("equity"))
    return metrics.drawdowns(curve).selectExpr("run_id", "round(max_drawdown, 6) + 0D AS max_drawdown", "peak", "trough", "CAST(longest_underwater AS BIGINT) AS longest_underwater", "CAST(recovery AS BIGINT) AS recovery")


_DRAWDOWN_SQL = (
    f"WITH c AS (SELECT symbol AS run_id, bar_index AS moment, close AS equity, max(close) OVER (PARTITION BY symbol ORDER BY bar_index) AS top FROM {bars.events_sql()}), "
    "f AS (SELECT *, CASE WHEN top > 0 THEN equity / top - 1 ELSE 0.0 END AS fall, max(CASE WHEN equity >= top THEN moment END) OVER (PARTITION BY run_id ORDER BY moment) AS dry FROM c), "
    "w AS (SELECT run_id, min(fall) AS deepest, arg_min(top, (fall, moment)) AS peak, arg_min(equity, (fall, moment)) AS trough, arg_min(moment, (fall, moment)) AS low, max(moment - dry) AS longest FROM f GROUP BY 1), "
    "r AS (SELECT w.run_id, min(moment - low) AS recovery FROM w JOIN c ON c.run_id = w.run_id AND moment >= low AND equity >= peak GROUP BY 1) "
    "SELECT w.run_id, round(deepest, 6) + 0.0 AS max_drawdown, peak, trough, CAST(longest AS BIGINT) AS longest_underwater, CAST(recovery AS BIGINT) AS recovery FROM w LEFT JOIN r ON r.run_id = w.run_id"
)


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.performance(equity(spark, sf_dir))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.activity(trades(spark, sf_dir))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_hour(trades(spark, sf_dir), sessions.index(bars.events(spark, sf_dir), data.DAY))


def buy_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.buy_and_hold(bars.events(spark, sf_dir), RUN).selectExpr("symbol", "round(equity, 6) + 0D AS equity")


_HOLD_SQL = f"SELECT symbol, round(100000.0 + 15.0 * (arg_max(close, bar_index) - max(CASE WHEN bar_index = 1 THEN open END)) - 2.55, 6) + 0.0 AS equity FROM {bars.events_sql()} GROUP BY symbol"

def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over spread of hourly changes, by symbol and sixth of its time; only a remainder of fewer than six bars is left out."""
    g = Graph("spark")
    x = g.let(f"close - {g.lag('close')}")
    done = g.apply(bars.events(spark, sf_dir), x=x).where("bar_index > 0")
    length = done.groupBy("symbol").agg(F.expr(f"count(*) DIV {BLOCKS}").alias("length"))
    done = done.join(length, "symbol").withColumn("block", F.expr("CAST((bar_index - 1) DIV length AS INT)")).where(f"block < {BLOCKS}")
    return done.groupBy(F.col("symbol").alias("config"), "block").agg(F.round(F.avg("x") / F.stddev_samp("x"), 8).alias("sharpe"))


def overfitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overfitting(_grid(spark, sf_dir), BLOCKS).selectExpr("CAST(split AS BIGINT) AS split", "winner", "round(out_rank, 6) AS out_rank", "round(logit, 6) + 0D AS logit")


def _overfitting_sql() -> str:
    splits = ", ".join(f"({i}, {b}, {b in s})" for i, s in enumerate(itertools.combinations(range(BLOCKS), BLOCKS // 2)) for b in range(BLOCKS))
    return (
        f"WITH x AS (SELECT symbol, bar_index, close - lag(close) OVER (PARTITION BY symbol ORDER BY bar_index) AS x FROM {bars.events_sql()}), "
        f"l AS (SELECT symbol, (count(*) - 1) // {BLOCKS} AS length FROM x GROUP BY 1), "
        f"g AS (SELECT symbol AS config, (bar_index - 1) // length AS block, round(avg(x) / stddev_samp(x), 8) AS sharpe FROM x JOIN l USING (symbol) WHERE bar_index > 0 AND (bar_index - 1) // length < {BLOCKS} GROUP BY 1, 2), "
        f"p(split, block, inside) AS (VALUES {splits}), "
        "s AS (SELECT split, config, avg(CASE WHEN inside THEN sharpe END) AS sample, avg(CASE WHEN NOT inside THEN sharpe END) AS rest FROM g JOIN p USING (block) GROUP BY 1, 2), "
        "b AS (SELECT split, arg_min(config, (-sample, config)) AS winner, arg_min(rest, (-sample, config)) AS own, count(*) AS n FROM s GROUP BY 1), "
        "r AS (SELECT split, winner, (count_if(rest < own) + 1) / (n + 1) AS out_rank FROM s JOIN b USING (split) GROUP BY split, winner, n) "
        "SELECT CAST(split AS BIGINT) AS split, winner, round(out_rank, 6) AS out_rank, round(ln(out_rank / (1 - out_rank)), 6) + 0.0 AS logit FROM r"
    )


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars.events(spark, sf_dir).select(F.col("symbol").alias("trial"), F.col("ts_close").alias("day"), F.col("close").alias("ret"))
    return metrics.trial_correlation(rows).selectExpr("a", "b", "n", "round(correlation, 6) + 0D AS correlation")


_CORRELATION_SQL = f"WITH s AS (SELECT symbol, ts_close, close FROM {bars.events_sql()}) SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(covar_pop(a.close, b.close) / (stddev_pop(a.close) * stddev_pop(b.close)), 6) + 0.0 AS correlation FROM s a JOIN s b USING (ts_close) WHERE a.symbol < b.symbol GROUP BY 1, 2 HAVING count(*) >= 30"

RUNS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "run_equity": (lambda spark, sf_dir: rounded(equity(spark, sf_dir)), _EQUITY_SQL),
    "run_trades": (lambda spark, sf_dir: rounded(trades(spark, sf_dir)), _TRADES_SQL),
    "run_performance": (lambda spark, sf_dir: rounded(performance(spark, sf_dir)), _PERFORMANCE_SQL),
    "run_activity": (lambda spark, sf_dir: rounded(activity(spark, sf_dir)), _ACTIVITY_SQL),
    "run_by_hour": (lambda spark, sf_dir: rounded(hourly(spark, sf_dir)), _HOURLY_SQL),
    "run_fills": (lambda spark, sf_dir: rounded(fills(spark, sf_dir)), _FILLS_SQL),
    "run_stopped_equity": (lambda spark, sf_dir: rounded(simulation.output(stopped(spark, sf_dir), "equity").select("run_id", "bar_index", "equity", "contracts")), _STOPPED_EQUITY_SQL),
    "run_stopped_fills": (lambda spark, sf_dir: rounded(simulation.output(stopped(spark, sf_dir), "fills").select("run_id", "bar_index", "side", "price", "tag")), _STOPPED_FILLS_SQL),
    "run_position_and_account": (lambda spark, sf_dir: rounded(stateful(spark, sf_dir)), _STATEFUL_SQL),
    "run_exposure": (lambda spark, sf_dir: rounded(exposure(spark, sf_dir)), _EXPOSURE_SQL),
    "run_trade_fills": (lambda spark, sf_dir: rounded(fills_of_trades(spark, sf_dir)), _TRADE_FILLS_SQL),
    "overnight_fills": (lambda spark, sf_dir: rounded(overnight(spark, sf_dir)), _OVERNIGHT_SQL),
    "sessions_without_close": (lambda spark, sf_dir: rounded(silent_sessions(spark, sf_dir)), _SILENT_SQL),
    "walk_forward": (forward, _FORWARD_SQL),
    "walk_forward_summary": (lambda spark, sf_dir: rounded(forward_summary(spark, sf_dir)), _FORWARD_SUMMARY_SQL),
    "block_grid": (grid, _GRID_SQL),
    "trial_log": (lambda spark, sf_dir: rounded(trial_log(spark, sf_dir)), f"SELECT count(*) AS trials, round(var_samp(sharpe), 6) + 0.0 AS variance, round(max(sharpe), 6) + 0.0 AS best FROM ({_GRID_SQL})"),
    "trade_model": (lambda spark, sf_dir: rounded(model_of_trades(spark, sf_dir)), _MODEL_SQL),
    "run_calmar": (lambda spark, sf_dir: rounded(calmar(spark, sf_dir)), _CALMAR_SQL),
    "run_buy_and_hold": (buy_and_hold, _HOLD_SQL),
    "drawdowns": (drawdown, _DRAWDOWN_SQL),
    "overfitting_splits": (overfitting, _overfitting_sql()),
    "trial_correlation": (correlations, _CORRELATION_SQL),
}
