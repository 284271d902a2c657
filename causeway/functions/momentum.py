"""Momentum and oscillators."""

from __future__ import annotations

import numpy as np

from causeway.functions.common import MEDIAN, TYPICAL, change, line_output, pick, slope, true_range
from causeway.functions.registry import ParameterError, primitive
from causeway.operators.graph import ema_series, response


@primitive("macd", "momentum")
def macd(g, fast=12, slow=26, signal=9, field="close", seed_multiplier=5, output="line"):
    """Difference of two exponential means, its exponential mean, and what is between."""
    if fast >= slow:
        raise ParameterError("fast must be below slow")
    n = slow * seed_multiplier + signal

    def line(v):
        late = ema_series(v, slow)
        return ema_series(v, fast)[-len(late) :] - late

    parts = {"line": lambda v: line(v)[-1], "signal": lambda v: ema_series(line(v), signal)[-1], "histogram": lambda v: line(v)[-1] - ema_series(line(v), signal)[-1]}
    return g.guard(pick(output, **{k: lambda f=f: g.fir(field, response(f, n)) for k, f in parts.items()}), n, (field, n))


@primitive("cci", "momentum")
def cci(g, window, field="close"):
    """Typical price against its mean, in mean deviations. The field is ignored."""
    t = g.let(TYPICAL)
    m = g.avg(t, window)
    dev = g.let(f"{g.total(g.mapped(g.list(t, window), lambda v, i: f'abs({v} - {m})'))} / {window}")
    return g.guard(g.let(f"CASE WHEN {dev} > 1E-12 THEN ({t} - {m}) / (0.015 * {dev}) END"), window)


@primitive("williams_r", "momentum")
def williams_r(g, window, field="close"):
    """Close within the range, from -100 to 0."""
    h, l = g.max("high", window), g.min("low", window)
    return g.guard(g.div(f"-100.0 * ({h} - close)", f"{h} - {l}"), window)


@primitive("efficiency_ratio", "momentum")
def efficiency_ratio(g, window, field="close"):
    """Net move over path length."""
    return g.guard(g.div(f"abs({field} - {g.lag(field, window)})", g.sum(g.let(f"abs({change(g, field)})"), window)), window + 1)


def _rsi(g, field, window):
    d = change(g, field)
    up, down = g.avg(g.let(f"greatest({d}, {d} * 0.0)"), window), g.avg(g.let(f"greatest(-{d}, {d} * 0.0)"), window)
    return g.div(f"100.0 * {up}", f"{up} + {down}")


@primitive("rsi", "oscillators")
def rsi(g, window, field="close"):
    """Relative strength with simple means; undefined on a flat window."""
    return g.guard(_rsi(g, field, window), window + 1)


@primitive("stochastic", "oscillators")
def stochastic(g, window, field="close"):
    """Place within the high-low range, from 0 to 100."""
    h, l = g.max("high", window), g.min("low", window)
    return g.guard(g.div(f"100.0 * ({field} - {l})", f"{h} - {l}"), window)


@primitive("mom", "oscillators")
def mom(g, window, field="close"):
    """Change over the window."""
    return g.guard(change(g, field, window), window + 1)


@primitive("roc", "oscillators")
def roc(g, window, field="close"):
    """Change in percent."""
    return g.guard(g.div(f"100.0 * {change(g, field, window)}", g.lag(field, window)), window + 1)


@primitive("rocr", "oscillators")
def rocr(g, window, field="close"):
    """Ratio to the value a window ago."""
    return g.guard(g.div(field, g.lag(field, window)), window + 1)


@primitive("bias", "oscillators")
def bias(g, window, field="close"):
    """Distance from the mean in percent of it."""
    m = g.avg(field, window)
    return g.guard(g.div(f"100.0 * ({field} - {m})", m), window, (field, window))


@primitive("psl", "oscillators")
def psl(g, window, field="close"):
    """Share of rising bars in percent."""
    return g.guard(g.let(f"100.0 * {g.sum(g.let(f'CASE WHEN {change(g, field)} > 0 THEN 1.0 ELSE 0.0 END'), window)} / {window}"), window + 1)


@primitive("cmo", "oscillators")
def cmo(g, window, field="close"):
    """Net over total movement, from -100 to 100."""
    d = change(g, field)
    return g.guard(g.div(f"100.0 * {g.sum(d, window)}", g.sum(g.let(f"abs({d})"), window)), window + 1)


@primitive("dpo", "oscillators")
def dpo(g, window, field="close"):
    """A past value against the mean up to it."""
    d = window // 2 + 1
    return g.guard(g.let(f"{g.lag(field, d)} - {g.avg(field, window, d)}"), window + d)


@primitive("qstick", "oscillators")
def qstick(g, window, field="close"):
    """Mean body. The field is ignored."""
    return g.guard(g.avg(g.let("close - open"), window), window)


@primitive("bop", "oscillators")
def bop(g, window):
    """Mean of body over range, over bars that have one."""
    return g.guard(g.avg(g.let("CASE WHEN high > low THEN (close - open) / (high - low) END"), window), window)


@primitive("elder_ray", "oscillators")
def elder_ray(g, window):
    """High and low against the mean close, together."""
    return g.guard(g.let(f"high + low - 2.0 * {g.avg('close', window)}"), window)


@primitive("apo", "oscillators")
def apo(g, window, field="close", slow_window=26, signal_window=9, seed_multiplier=5, output="line"):
    """Difference of two exponential means."""
    n = slow_window * seed_multiplier
    w = response(lambda v: ema_series(v, window)[-1] - ema_series(v, slow_window)[-1], n)
    return g.guard(g.fir(field, w), n + signal_window)


def _relative_line(g, x, window, slow_window, signal_window, seed_multiplier, output, positive):
    n = slow_window * seed_multiplier + signal_window
    m = n - slow_window + 1
    fast = g.series(x, response(lambda v: ema_series(v, window)[-m:], n))
    slow = g.series(x, response(lambda v: ema_series(v, slow_window), n))
    fine = "> 0" if positive else "<> 0"
    lines = g.each(m, lambda j: f"CASE WHEN {g.at(slow, j)} {fine} THEN 100.0 * ({g.at(fast, j)} - {g.at(slow, j)}) / {g.at(slow, j)} END")
    # One undefined ratio in the history leaves all outputs undefined.
    line = g.let(f"CASE WHEN {g.total(lines)} IS NOT NULL THEN {g.at(lines, str(m))} END")
    signal = lambda: g.weighed(lines, response(lambda v: ema_series(v, signal_window)[-1], m))
    return g.guard(line_output(g, line, signal, output), n)


@primitive("ppo", "oscillators")
def ppo(g, window, field="close", slow_window=26, signal_window=9, seed_multiplier=5, output="line"):
    """Difference of two exponential means in percent of the slow one."""
    return _relative_line(g, field, window, slow_window, signal_window, seed_multiplier, output, False)


@primitive("pvo", "flow")
def pvo(g, window, field="close", slow_window=26, signal_window=9, seed_multiplier=5, output="line"):
    """The same on volume. The field is ignored."""
    return _relative_line(g, "volume", window, slow_window, signal_window, seed_multiplier, output, True)


@primitive("awesome", "oscillators")
def awesome(g, fast=5, slow=34):
    """Short less long mean of middles."""
    if fast >= slow:
        raise ParameterError("fast must be below slow")
    m = g.let(MEDIAN)
    return g.guard(g.let(f"{g.avg(m, fast)} - {g.avg(m, slow)}"), slow)


@primitive("trix", "oscillators")
def trix(g, window, field="close", signal_window=9, seed_multiplier=5, output="line"):
    """Change of a triple exponential mean in percent; the signal is a plain mean."""
    n = window * seed_multiplier + signal_window + 1
    if n < 3 * (window - 1) + signal_window + 1:
        return g.guard("CAST(NULL AS DOUBLE)", n)
    triple = lambda v: ema_series(ema_series(ema_series(v, window), window), window)[-signal_window - 1 :]
    xs = g.series(field, response(triple, n))
    a = lambda j: g.at(xs, j)
    rates = g.each(signal_window, lambda j: f"CASE WHEN {a(j)} <> 0 THEN 100.0 * ({a(f'({j} + 1)')} - {a(j)}) / {a(j)} WHEN {a(j)} = 0 THEN 0.0 END")
    line = g.let(g.at(rates, str(signal_window)))
    return g.guard(line_output(g, line, lambda: g.let(f"{g.total(rates)} / {signal_window}"), output), n)


@primitive("tsi", "oscillators")
def tsi(g, window, field="close", slow_window=26, signal_window=9, seed_multiplier=5, output="line"):
    """Momentum over absolute momentum, both smoothed twice."""
    n, d = slow_window * seed_multiplier, change(g, field)
    w = response(lambda v: ema_series(ema_series(v, slow_window), window)[-1], n)
    return g.guard(g.div(f"100.0 * {g.fir(d, w)}", g.fir(g.let(f"abs({d})"), w)), n + signal_window + 1)


@primitive("pmo", "oscillators")
def pmo(g, window, field="close", slow_window=26, signal_window=9, seed_multiplier=5, output="line"):
    """Rate of change smoothed twice, times ten."""
    n = slow_window * seed_multiplier
    w = response(lambda v: 10 * ema_series(ema_series(v, slow_window), window)[-1], n)
    rate = g.div(f"100.0 * {change(g, field)}", g.lag(field))
    return g.guard(g.fir(rate, w), n + signal_window + 1, (rate, n))


@primitive("coppock", "oscillators")
def coppock(g, window, field="close", slow_window=26, signal_window=9, seed_multiplier=5, output="line"):
    """Weighted mean, over ``window`` bars, of two rates of change."""
    rate = lambda k: g.div(f"100.0 * {change(g, field, k)}", g.lag(field, k))
    both = g.let(f"{rate(window)} + {rate(slow_window)}")
    return g.guard(g.fir(both, np.arange(1, window + 1) / (window * (window + 1) / 2)), slow_window + window + 1, (both, window))


def _double_smooth(g, raw, window, smooth_k, smooth_d, output, bars):
    k = g.avg(raw, smooth_k)
    built = pick(output, k=lambda: k, d=lambda: g.avg(k, smooth_d))
    return g.guard(built, bars, (raw, smooth_k + smooth_d - 1))


@primitive("stoch", "oscillators")
def stoch(g, window, smooth_k=3, smooth_d=3, output="k"):
    """Smoothed stochastic; undefined if any of its windows is flat."""
    h, l = g.max("high", window), g.min("low", window)
    raw = g.let(f"CASE WHEN {h} > {l} THEN 100.0 * (close - {l}) / ({h} - {l}) END")
    return _double_smooth(g, raw, window, smooth_k, smooth_d, output, window + smooth_k + smooth_d - 2)


@primitive("stoch_rsi", "oscillators")
def stoch_rsi(g, window, smooth_k=3, smooth_d=3, output="k"):
    """Stochastic of the relative strength."""
    r = g.guard(_rsi(g, "close", window), window + 1)
    h, l = g.max(r, window), g.min(r, window)
    whole = g.agg("count", r, window)
    raw = g.let(f"CASE WHEN {whole} = {window} AND {h} - {l} > 1E-12 THEN 100.0 * ({r} - {l}) / ({h} - {l}) END")
    return _double_smooth(g, raw, window, smooth_k, smooth_d, output, 2 * window + smooth_k + smooth_d - 1)


@primitive("ultimate", "oscillators")
def ultimate(g, fast=7, medium=14, slow=28):
    """Buying pressure over three horizons, weighted 4-2-1."""
    before = g.lag("close")
    low = g.let(f"CASE WHEN {before} IS NOT NULL THEN least(low, {before}) END")
    high = g.let(f"CASE WHEN {before} IS NOT NULL THEN greatest(high, {before}) END")
    bought, wide = g.let(f"close - {low}"), g.let(f"{high} - {low}")
    a, b, c = (g.div(g.sum(bought, n), g.sum(wide, n)) for n in (fast, medium, slow))
    return g.guard(g.let(f"100.0 * (4.0 * {a} + 2.0 * {b} + {c}) / 7.0"), slow + 1)


@primitive("rvgi", "oscillators")
def rvgi(g, window):
    """Bodies over ranges, both smoothed 1-2-2-1."""
    w = np.convolve(np.ones(window), [1, 2, 2, 1]) / 6
    return g.guard(g.div(g.fir(g.let("close - open"), w), g.fir(g.let("high - low"), w)), window + 3)


@primitive("fisher", "oscillators")
def fisher(g, window, field="close", signal_window=9, seed_multiplier=5, output="line"):
    """Fisher transform of the place in the range of middles; the signal is the bar before."""
    m = g.let(MEDIAN)
    h, l = g.max(m, window), g.min(m, window)
    z = g.let(f"CASE WHEN {h} > {l} THEN least(greatest(2.0 * ({m} - {l}) / ({h} - {l}) - 1.0, -0.999), 0.999) END")
    f = g.let(f"0.5 * ln((1.0 + {z}) / (1.0 - {z}))")
    return g.guard(line_output(g, f, lambda: g.lag(f), output), window * seed_multiplier + signal_window, (z, signal_window + 1))


@primitive("smi", "oscillators")
def smi(g, window, field="close", slow_window=26, signal_window=9, seed_multiplier=5, output="line"):
    """Distance from the middle of the range over half the range, both smoothed twice."""
    bars = slow_window * seed_multiplier
    n = bars - window + 1
    h, l = g.max("high", window), g.min("low", window)
    w = response(lambda v: ema_series(ema_series(v, signal_window), signal_window)[-1], n)
    return g.guard(g.div(f"200.0 * {g.fir(g.let(f'close - ({h} + {l}) / 2.0'), w)}", g.fir(g.let(f"{h} - {l}"), w)), bars)


@primitive("pgo", "oscillators")
def pgo(g, window):
    """Distance from the mean in mean true ranges."""
    return g.guard(g.div(f"close - {g.avg('close', window)}", g.avg(true_range(g), window)), window + 1)


@primitive("cfo", "oscillators")
def cfo(g, window, field="close"):
    """Distance from the regression line in percent."""
    line = g.let(f"{g.avg(field, window)} + {slope(g, field, window)} * {(window - 1) / 2.0}")
    return g.guard(g.div(f"100.0 * ({field} - {line})", field), window, (field, window))


@primitive("center_of_gravity", "oscillators")
def center_of_gravity(g, window, field="close"):
    """Weighted rank of the window's values, negative."""
    return g.guard(g.div(f"-{g.fir(field, np.arange(window, 0, -1))}", g.sum(field, window)), window, (field, window))


def relative_volatility(g, field, window):
    """Spread of rises as a share of the spread of rises and falls."""
    d = change(g, field)

    def side(sign):
        own = g.let(f"CASE WHEN {d} {sign} 0 THEN {d} END")
        return g.let(f"coalesce({g.std(own, window, 0)} * {g.agg('count', own, window)}, 0.0)")

    up, down = side(">"), side("<")
    return g.let(f"CASE WHEN {up} + {down} > 1E-12 THEN 100.0 * {up} / ({up} + {down}) END")


@primitive("inertia", "oscillators")
def inertia(g, window, field="close"):
    """Regression endpoint of the relative volatility."""
    r = g.guard(relative_volatility(g, field, window), window + 1)
    line = g.let(f"{g.avg(r, window)} + {slope(g, r, window)} * {(window - 1) / 2.0}")
    return g.guard(line, 2 * window, (r, window))


