"""Result analytics over equity curves and trades, and the statistics of selection."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

YEAR = 365.2425 * 86400
EULER = 0.5772156649015329
MOST_SPLITS = 20_000
_NORMAL = NormalDist()


def daily(equity: DataFrame) -> DataFrame:
    """(run_id, day, ts, equity): the last point of each UTC day."""
    day = F.floor(F.col("ts") / 86400).cast("long")
    return equity.groupBy("run_id", day.alias("day")).agg(F.max("ts").alias("ts"), F.max_by("equity", "ts").alias("equity"))


def returns(points: DataFrame) -> DataFrame:
    """Adds ``ret`` against the point before; rows without a positive one go."""
    before = F.lag("equity").over(Window.partitionBy("run_id").orderBy("ts"))
    return points.withColumn("before", before).where("before > 0").withColumn("ret", F.col("equity") / F.col("before") - 1).drop("before")


def drawdowns(equity: DataFrame) -> DataFrame:
    """(run_id, max_drawdown, peak, trough, longest_underwater in points, recovery).

    ``recovery`` is the points from the trough to the first one that is back at
    the peak; null if none is.
    """
    order = Window.partitionBy("run_id").orderBy("ts")
    top = equity.withColumn("top", F.max("equity").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    top = top.withColumn("fall", F.when(F.col("top") > 0, F.col("equity") / F.col("top") - 1).otherwise(F.lit(0.0)))
    top = top.withColumn("at", F.row_number().over(order)).withColumn("dry", F.max(F.when(F.col("equity") >= F.col("top"), F.col("at"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.struct("fall", "at")
    worst = top.groupBy("run_id").agg(F.min("fall").alias("max_drawdown"), F.min_by("top", first).alias("peak"), F.min_by("equity", first).alias("trough"), F.max(F.col("at") - F.col("dry")).alias("longest_underwater"), F.min(first).getField("at").alias("low"))
    back = top.select("run_id", "equity", "at").join(worst, "run_id").where((F.col("at") >= F.col("low")) & (F.col("equity") >= F.col("peak")))
    back = back.groupBy("run_id").agg(F.min(F.col("at") - F.col("low")).alias("recovery"))
    return worst.drop("low").join(back, "run_id", "left")


def performance(equity: DataFrame, risk_free_annual: float = 0.0) -> DataFrame:
    """One row a run: periods a year as measured, growth, volatility, Sharpe, Sortino, skew, kurtosis (not excess).

    The curve is read once: what a run's days have in common comes by a window.
    """
    run = Window.partitionBy("run_id")
    days = daily(equity).withColumn("years", (F.max("ts").over(run) - F.min("ts").over(run)) / YEAR)
    days = days.withColumn("per_year", F.when(F.col("years") > 0, (F.count(F.lit(1)).over(run) - 1) / F.col("years")))
    before = F.lag("equity").over(run.orderBy("ts"))
    days = days.withColumn("ret", F.when(before > 0, F.col("equity") / before - 1))
    days = days.withColumn("x", F.col("ret") - (F.pow(F.lit(1 + risk_free_annual), 1 / F.col("per_year")) - 1))
    below = F.when(F.col("x").isNotNull(), F.pow(F.least("x", F.lit(0.0)), 2))
    both = days.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("points"), F.min_by("equity", "ts").alias("first"), F.max_by("equity", "ts").alias("last"), F.min("equity").alias("least"), F.max("years").alias("years"), F.max("per_year").alias("per_year"),
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("spread"), F.sqrt(F.avg(below)).alias("down"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurtosis"), F.count("x").alias("n"),
    )
    root = F.sqrt("per_year")
    return both.select(
        "run_id", "points", "first", "last", "per_year",
        F.when((F.col("last") > 0) & (F.col("years") > 0), F.pow(F.col("last") / F.col("first"), 1 / F.col("years")) - 1).alias("cagr"),
        (F.col("spread") * root).alias("volatility"),
        F.when(F.col("spread") > 0, F.col("mean") / F.col("spread") * root).alias("sharpe"),
        F.when(F.col("down") > 0, F.col("mean") / F.col("down") * root).alias("sortino"),
        F.when(F.col("n") >= 3, F.coalesce("skew", F.lit(0.0))).otherwise(F.lit(0.0)).alias("skew"),
        F.when(F.col("n") >= 4, F.coalesce("kurtosis", F.lit(3.0))).otherwise(F.lit(3.0)).alias("kurtosis"),
        (F.col("least") <= 0).alias("ruined"),
    )


def activity(trades: DataFrame) -> DataFrame:
    """One row a run over net results; a trade of exactly zero is neither won nor lost."""
    net = F.col("gross_pnl") - F.col("fees")
    won, lost = F.when(net > 0, net), F.when(net < 0, net)
    return trades.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("trades"), F.sum(net).alias("net"), (F.count(won) / F.count(F.lit(1))).alias("hit_rate"),
        F.when(F.count(lost) > 0, F.coalesce(F.sum(won), F.lit(0.0)) / -F.sum(lost)).alias("profit_factor"), F.avg(won).alias("mean_win"), F.avg(lost).alias("mean_loss"),
    )


def by_hour(trades: DataFrame, indexed: DataFrame) -> DataFrame:
    """Trades and net result by whole hours since the opening of the session in which they were opened."""
    at = indexed.select(F.col("symbol").alias("run_id"), F.col("bar_index").alias("opened_bar"), "minutes_from_open")
    both = trades.join(at, ["run_id", "opened_bar"], "left").withColumn("hour", F.floor(F.col("minutes_from_open") / 60).cast("long"))
    return both.groupBy("run_id", "hour").agg(F.count(F.lit(1)).alias("trades"), F.sum(F.col("gross_pnl") - F.col("fees")).alias("net"))


def exposure(equity: DataFrame, fills: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """(run_id, exposure, mean_contracts, fees, turnover): share of points with a position, mean of its size, fees, and traded notional over mean equity."""
    held = equity.groupBy("run_id").agg(F.avg((F.col("contracts") != 0).cast("double")).alias("exposure"), F.avg(F.abs("contracts").cast("double")).alias("mean_contracts"), F.avg("equity").alias("_equity"))
    traded = fills.groupBy("run_id").agg(F.sum("fee").alias("fees"), F.sum(F.col("quantity") * F.col("price") * F.lit(float(multiplier))).alias("_notional"))
    both = held.join(traded, "run_id", "left")
    return both.select("run_id", "exposure", "mean_contracts", F.coalesce("fees", F.lit(0.0)).alias("fees"), F.when(F.col("_equity") > 0, F.coalesce("_notional", F.lit(0.0)) / F.col("_equity")).alias("turnover"))


def overnight_fills(fills: DataFrame, indexed: DataFrame, lag: int = 1) -> DataFrame:
    """(run_id, fills, crossed, share, gap_mean, gap_median, gap_max): fills in another session than the bar, ``lag`` bars before, that decided them.

    The gap is that from the deciding close to the open of the fill's bar, without sign; 0 where no fill crossed.
    """
    bar = indexed.select("symbol", "bar_index", "session_number", "open", "close")
    there = bar.select("symbol", "bar_index", F.col("session_number").alias("_there"), F.col("open").alias("_open"))
    before = bar.select("symbol", (F.col("bar_index") + lag).alias("bar_index"), F.col("session_number").alias("_before"), F.col("close").alias("_close"))
    both = fills.select("run_id", "symbol", "bar_index").join(there, ["symbol", "bar_index"], "left").join(before, ["symbol", "bar_index"], "left")
    gap = F.when(F.col("_there") != F.col("_before"), F.abs(F.col("_open") - F.col("_close")))
    return both.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("fills"), F.count(gap).alias("crossed"), (F.count(gap) / F.count(F.lit(1))).alias("share"),
        *(F.coalesce(f, F.lit(0.0)).alias(f"gap_{n}") for n, f in (("mean", F.avg(gap)), ("median", F.percentile(gap, F.lit(0.5))), ("max", F.max(gap)))),
    )


def sessions_without_close(indexed: DataFrame) -> DataFrame:
    """(sessions, without, share): sessions that end before their declared close, so that no bar is their last."""
    each = indexed.groupBy("symbol", "session_number").agg(F.max("is_last").alias("closed"))
    return each.agg(F.count(F.lit(1)).alias("sessions"), F.count_if(~F.col("closed")).alias("without"), F.avg((~F.col("closed")).cast("double")).alias("share"))


def trade_fills(trades: DataFrame, fills: DataFrame) -> DataFrame:
    """The fills of each trade: its own columns and those of the fill, which lies between its opening and its closing bar."""
    f = fills.select("run_id", "symbol", F.col("bar_index").alias("fill_bar"), "side", "quantity", "price", "fee", "tag")
    return trades.join(f, ["run_id", "symbol"]).where(F.col("fill_bar").between(F.col("opened_bar"), F.col("closed_bar")))


def trade_model(trades: DataFrame, fills: DataFrame) -> DataFrame:
    """What a table of trades shows: each with ``holding`` in bars and the volume-weighted prices of its entries and exits."""
    both = trade_fills(trades, fills)
    into = (F.col("side") == F.col("direction")) & (F.col("fill_bar") < F.col("closed_bar"))
    out_of = (F.col("side") == -F.col("direction")) & (F.col("fill_bar") > F.col("opened_bar"))
    mean = lambda c: F.sum(F.when(c, F.col("quantity") * F.col("price"))) / F.sum(F.when(c, F.col("quantity")))
    each = both.groupBy("run_id", "symbol", "opened_bar", "closed_bar").agg(mean(into).alias("entry_price"), mean(out_of).alias("exit_price"))
    return each.withColumn("holding", F.col("closed_bar") - F.col("opened_bar"))


def calmar(performance_: DataFrame, drawdowns_: DataFrame) -> DataFrame:
    """(run_id, calmar): growth a year over the deepest fall; null without one."""
    both = performance_.select("run_id", "cagr").join(drawdowns_.select("run_id", "max_drawdown"), "run_id")
    return both.select("run_id", F.when(F.col("max_drawdown") < 0, F.col("cagr") / -F.col("max_drawdown")).alias("calmar"))


def filtered_trades(trades: DataFrame, bars: DataFrame, year: int | None = None, direction: int | None = None) -> DataFrame:
    """Trades that were opened in a year (UTC, by the close of their bar) or have a direction, both if both are given."""
    if direction is not None:
        trades = trades.where(F.col("direction") == direction)
    if year is not None:
        opened = bars.where(F.year("ts_close") == year).select("symbol", F.col("bar_index").alias("opened_bar"))
        trades = trades.join(opened, ["symbol", "opened_bar"], "left_semi")
    return trades


def repeated_trials(trials: DataFrame) -> DataFrame:
    """(config, results): configurations archived with more than one result."""
    return trials.groupBy("config").agg(F.countDistinct("result").alias("results")).where("results > 1")


def trial_log(trials: DataFrame) -> DataFrame:
    """(trials, variance, best): trials that differ in configuration or result, the sample variance of their ``sharpe`` and the largest.

    These are what the expected best and the deflated ratio take.
    """
    each = trials.dropDuplicates(["config", "result"])
    return each.agg(F.count(F.lit(1)).alias("trials"), F.var_samp("sharpe").alias("variance"), F.max("sharpe").alias("best"))


def trial_correlation(series: DataFrame, least: int = 30) -> DataFrame:
    """(a, b, n, correlation) of every two trials on their common days; null where one is constant.

    ``series``: (trial, day, ret). Trials are few; days are what grows.
    """
    a, b = series.toDF("a", "day", "x"), series.toDF("b", "day", "y")
    both = a.join(b, "day").where("a < b").groupBy("a", "b")
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    return both.agg(F.count(F.lit(1)).alias("n"), F.when(spread > 1e-300, F.covar_pop("x", "y") / F.nullif(spread, F.lit(0.0))).alias("correlation")).where(F.col("n") >= least)


def probabilistic_sharpe(sharpe: float, benchmark: float, n: int, skew: float, kurtosis: float) -> float | None:
    """Probability that the true ratio per period is above the benchmark; None if its error is undefined."""
    v = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2
    return _NORMAL.cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(v)) if n > 1 and v > 0 else None


def expected_best_sharpe(variance: float, trials: int) -> float:
    """Largest ratio to expect of that many skilless trials."""
    if trials < 2:
        return 0.0
    return math.sqrt(variance) * ((1 - EULER) * _NORMAL.inv_cdf(1 - 1 / trials) + EULER * _NORMAL.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(sharpe: float, variance: float, trials: int, n: int, skew: float, kurtosis: float) -> float | None:
    return probabilistic_sharpe(sharpe, expected_best_sharpe(variance, trials), n, skew, kurtosis)


def overfitting(grid: DataFrame, blocks: int) -> DataFrame:
    """(split, winner, out_rank, logit) over all ways to take half of the blocks as the sample.

    ``grid``: (config, block from 0, sharpe). The best in the sample (ties: by
    name) is ranked among all outside it. The probability of overfitting is the
    share of logits at or below zero.
    """
    if blocks < 2 or blocks % 2:
        raise ValueError("blocks must be even")
    splits = list(itertools.combinations(range(blocks), blocks // 2))
    if len(splits) > MOST_SPLITS:
        raise ValueError(f"{len(splits)} splits are over the {MOST_SPLITS} allowed")
    spark = grid.sparkSession
    table = spark.createDataFrame([(i, b, b in s) for i, s in enumerate(splits) for b in range(blocks)], "split int, block int, inside boolean")
    scored = grid.join(table, "block").groupBy("split", "config").agg(F.avg(F.when(F.col("inside"), F.col("sharpe"))).alias("sample"), F.avg(F.when(~F.col("inside"), F.col("sharpe"))).alias("rest"))
    best = scored.groupBy("split").agg(F.min_by("config", F.struct(-F.col("sample"), "config")).alias("winner"), F.min_by("rest", F.struct(-F.col("sample"), "config")).alias("own"), F.count(F.lit(1)).alias("n"))
    ranked = scored.join(best, "split").groupBy("split", "winner", "n").agg(((F.count_if(F.col("rest") < F.col("own")) + 1) / (F.col("n") + 1)).alias("out_rank"))
    return ranked.select("split", "winner", "out_rank", F.ln(F.col("out_rank") / (1 - F.col("out_rank"))).alias("logit"))


def walk_forward(n: int, train: int, test: int, anchored: bool = False) -> list[tuple[int, int, int, int]]:
    """(train from, train to, test from, test to), ends exclusive; the test windows follow each other."""
    if min(train, test) < 1 or n < train + test:
        raise ValueError("the windows do not fit")
    return [(0 if anchored else s, s + train, s + train, s + train + test) for s in range(0, n - train - test + 1, test)]


def folded(bars: DataFrame, train: int, test: int, anchored: bool = False) -> DataFrame:
    """The bars of every test window, with ``fold`` and a ``run_id`` that starts anew: symbol and fold.

    Windows follow each other in each symbol's own bars; those of training serve
    signals, which were computed before, and a symbol that is too short has none.
    """
    if min(train, test) < 1:
        raise ValueError("the windows must have bars")
    size = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    fold = F.floor((F.col("bar_index") - train) / test).cast("long")
    inside = (F.col("bar_index") >= train) & (train + (fold + 1) * test <= F.col("_n"))
    out = bars.join(size, "symbol").where(inside).withColumn("fold", fold).drop("_n")
    return out.withColumn("run_id", F.concat_ws("#", "symbol", F.col("fold").cast("string")))


def fold_returns(equity: DataFrame, initial: float) -> DataFrame:
    """(run_id, total_return, points) of runs that start at the initial cash."""
    return equity.groupBy("run_id").agg((F.max_by("equity", "ts") / F.lit(float(initial)) - 1).alias("total_return"), F.count(F.lit(1)).alias("points"))


def walk_forward_summary(folds: DataFrame, equity: DataFrame, initial: float) -> DataFrame:
    """(symbol, folds, positive_share, compounded, best, worst, concentration, pooled_sharpe) over the folds of each symbol.

    ``concentration`` is the best fold's share of the sum of all, of the gains if
    the sum is not positive; ``pooled_sharpe`` is per bar, over all returns of all folds.
    """
    symbol = F.substring_index("run_id", "#", 1)
    r = F.col("total_return")
    total, gains = F.sum(r), F.sum(F.when(r > 0, r))
    each = folds.groupBy(symbol.alias("symbol")).agg(
        F.count(F.lit(1)).alias("folds"), F.avg((r > 0).cast("double")).alias("positive_share"), (F.exp(F.sum(F.log1p(r))) - 1).alias("compounded"), F.max(r).alias("best"), F.min(r).alias("worst"),
        F.when((F.abs(total) >= 1e-12) & (F.max(r) > 0), F.max(r) / F.when(total > 0, total).otherwise(gains)).alias("concentration"),
    )
    before = F.coalesce(F.lag("equity").over(Window.partitionBy("run_id").orderBy("ts")), F.lit(float(initial)))
    pooled = equity.withColumn("_b", before).where("_b > 0").groupBy(symbol.alias("symbol")).agg(F.avg(F.col("equity") / F.col("_b") - 1).alias("_m"), F.stddev_samp(F.col("equity") / F.col("_b") - 1).alias("_s"))
    return each.join(pooled.select("symbol", F.when(F.col("_s") > 0, F.col("_m") / F.col("_s")).alias("pooled_sharpe")), "symbol", "left")


def block_grid(returns_: DataFrame, blocks: int, ignore_inactive: bool = False) -> DataFrame:
    """(config, block, sharpe) of configurations' returns (config, position, ret), on the positions that all have.

    The common positions are cut into blocks of equal length, the remainder at
    the end is left out. A configuration without spread in some block is
    refused, or left out if that is asked for.
    """
    if blocks < 2 or blocks % 2:
        raise ValueError("blocks must be even")
    configs = returns_.agg(F.count_distinct("config").alias("_configs"))
    shared = returns_.groupBy("position").agg(F.count_distinct("config").alias("_have")).join(F.broadcast(configs)).where("_have = _configs").select("position")
    span = shared.agg(F.min("position").alias("_low"), F.expr(f"count(*) DIV {blocks}").alias("_length"))
    placed = shared.join(F.broadcast(span)).where("_length > 0")
    placed = placed.withColumn("_at", F.row_number().over(Window.orderBy("position")) - 1).withColumn("block", F.expr("CAST(_at DIV _length AS INT)")).where(f"block < {blocks}")
    cells = returns_.join(placed.select("position", "block"), "position").groupBy("config", "block").agg((F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0))).alias("sharpe"))
    idle = cells.where("sharpe IS NULL").select("config").distinct()
    if ignore_inactive:
        return cells.join(idle, "config", "left_anti")
    if names := sorted(r["config"] for r in idle.limit(100).collect()):
        raise ValueError(f"no spread in some block: {', '.join(map(str, names))}")
    return cells


def concentration(pnls: list[float]) -> float | None:
    """Share of the largest gain in all gains."""
    gains = [p for p in pnls if p > 0]
    return max(gains) / float(np.sum(gains)) if gains else None
