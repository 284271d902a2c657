"""Bar transforms."""

from __future__ import annotations

from causeway.functions.common import MEDIAN, TYPICAL, pick
from causeway.functions.registry import primitive
from causeway.operators.graph import response


@primitive("typical_price", "transforms")
def typical_price(g):
    """Mean of high, low and close."""
    return g.guard(g.let(TYPICAL), 1)


@primitive("median_price", "transforms")
def median_price(g):
    """Mean of high and low."""
    return g.guard(g.let(MEDIAN), 1)


@primitive("weighted_close", "transforms")
def weighted_close(g):
    """Mean with the close counted twice."""
    return g.guard(g.let("(high + low + 2.0 * close) / 4.0"), 1)


@primitive("average_price", "transforms")
def average_price(g):
    """Mean of the four prices."""
    return g.guard(g.let("(open + high + low + close) / 4.0"), 1)


@primitive("bar_range", "transforms")
def bar_range(g):
    """High less low."""
    return g.guard(g.let("high - low"), 1)


@primitive("bar_range_pct", "transforms")
def bar_range_pct(g):
    """Range in percent of the close."""
    return g.guard(g.div("100.0 * (high - low)", "close"), 1)


@primitive("gap", "transforms")
def gap(g):
    """Open against the close before, in percent."""
    before = g.lag("close")
    return g.guard(g.div(f"100.0 * (open - {before})", before), 2)


@primitive("body_ratio", "transforms")
def body_ratio(g):
    """Body as a share of the range."""
    return g.guard(g.div("abs(close - open)", "high - low"), 1)


@primitive("close_location", "transforms")
def close_location(g):
    """Where the close lies in the range, from -1 to 1."""
    return g.guard(g.div("(close - low) - (high - close)", "high - low"), 1)


@primitive("pivot", "transforms")
def pivot(g, output="pp"):
    """Classic pivots of the bar before."""
    h, l, c = g.lag("high"), g.lag("low"), g.lag("close")
    p = g.let(f"({h} + {l} + {c}) / 3.0")
    levels = {"pp": p, "r1": f"2.0 * {p} - {l}", "s1": f"2.0 * {p} - {h}", "r2": f"{p} + ({h} - {l})", "s2": f"{p} - ({h} - {l})", "r3": f"{h} + 2.0 * ({p} - {l})", "s3": f"{l} - 2.0 * ({h} - {p})"}
    return g.guard(pick(output, **{k: lambda v=v: g.let(v) for k, v in levels.items()}), 2)


@primitive("heikin_ashi", "transforms")
def heikin_ashi(g, lookback=50, output="close"):
    """Smoothed candle; the open halves its past at every bar."""
    close = g.let("(open + high + low + close) / 4.0")

    def halving(v):
        """First value: the seed; the others: closes but the last."""
        for i in range(1, len(v)):
            v[0] = (v[0] + v[i]) / 2
        return v[0]

    def opened():
        if lookback == 1:
            return g.let("(open + close) / 2.0")
        w = response(lambda e: halving(e.copy()), lookback)
        seed = g.lag(g.let("(open + close) / 2.0"), lookback - 1)
        return g.let(f"{seed} * {float(w[0])!r} + {g.fir(close, [*w[1:], 0.0])}")

    built = pick(output, close=lambda: close, open=opened, high=lambda: g.let(f"greatest(high, {opened()}, {close})"), low=lambda: g.let(f"least(low, {opened()}, {close})"))
    return g.guard(built, max(lookback, 2))
