"""Direction and quality of a trend, with Wilder's system."""

from __future__ import annotations

import math


from causeway.functions.common import change, pick, slope, true_range
from causeway.functions.registry import primitive
from causeway.operators.graph import response, wilder_series


def _moves(g):
    """Wilder's two directional moves: only the larger one of a bar counts."""
    up, down = change(g, "high"), g.let(f"{g.lag('low')} - low")
    return g.let(f"CASE WHEN {up} > {down} AND {up} > 0 THEN {up} WHEN {up} IS NOT NULL THEN 0.0 END"), g.let(f"CASE WHEN {down} > {up} AND {down} > 0 THEN {down} WHEN {down} IS NOT NULL THEN 0.0 END")


def _wilder(g, x, window, length):
    return g.fir(x, response(lambda v: wilder_series(v, window)[-1], length))


def _dx_list(g, window, length):
    """The directional index at every bar of one truncated history."""
    w = response(lambda v: wilder_series(v, window), length)
    plus, minus = (g.series(m, w) for m in _moves(g))
    p, m = lambda j: g.at(plus, j), lambda j: g.at(minus, j)
    return g.each(len(w), lambda j: f"CASE WHEN {p(j)} + {m(j)} > 0 THEN 100.0 * abs({p(j)} - {m(j)}) / ({p(j)} + {m(j)}) END"), len(w)


@primitive("dx", "directional")
def dx(g, window, seed_multiplier=5):
    """Relative distance of the two directional indicators."""
    n = window * seed_multiplier
    p, m = (_wilder(g, x, window, n) for x in _moves(g))
    t = _wilder(g, true_range(g), window, n)
    return g.guard(g.let(f"CASE WHEN {t} > 0 AND {p} + {m} > 0 THEN 100.0 * abs({p} - {m}) / ({p} + {m}) END"), n + 1)


@primitive("adx", "wilder")
def adx(g, window, seed_multiplier=5, output="adx"):
    """Wilder's average directional index and its two indicators."""
    n = window * (seed_multiplier + 1)

    def indicator(side):
        t = _wilder(g, true_range(g), window, n)
        return g.let(f"CASE WHEN {t} > 0 THEN 100.0 * {_wilder(g, _moves(g)[side], window, n)} / {t} END")

    def average():
        dxs, m = _dx_list(g, window, n)
        return g.weighed(dxs, response(lambda v: wilder_series(v, window)[-1], m))

    return g.guard(pick(output, adx=average, plus_di=lambda: indicator(0), minus_di=lambda: indicator(1)), n + 1)


@primitive("adxr", "directional")
def adxr(g, window, seed_multiplier=5):
    """Mean of the index now and a window ago, within one history."""
    n = window * (seed_multiplier + 1)
    dxs, m = _dx_list(g, window, n)
    mean = response(lambda v: (wilder_series(v, window)[-1] + wilder_series(v, window)[-1 - window]) / 2, m)
    return g.guard(g.weighed(dxs, mean), n + 1)


@primitive("atr_wilder", "wilder")
def atr_wilder(g, window, seed_multiplier=5):
    """Wilder's mean true range."""
    n = window * seed_multiplier
    return g.guard(_wilder(g, true_range(g), window, n), n + 1)


@primitive("atr_wilder_pct", "volatility")
def atr_wilder_pct(g, window, seed_multiplier=5):
    """Wilder's mean true range in percent of the close."""
    n = window * seed_multiplier
    return g.guard(g.div(f"100.0 * {_wilder(g, true_range(g), window, n)}", "close"), n + 1)


@primitive("rsi_wilder", "wilder")
def rsi_wilder(g, window, seed_multiplier=5, field="close"):
    """Relative strength with Wilder's means."""
    n, d = window * seed_multiplier, change(g, field)
    up = _wilder(g, g.let(f"greatest({d}, {d} * 0.0)"), window, n)
    down = _wilder(g, g.let(f"greatest(-{d}, {d} * 0.0)"), window, n)
    return g.guard(g.div(f"100.0 * {up}", f"{up} + {down}"), n + 1)


@primitive("aroon", "directional")
def aroon(g, window, output="up"):
    """Age of the window's extreme; the oldest of equals counts."""
    find = "array_position" if g.spark else "list_position"
    top, low = ("array_max", "array_min") if g.spark else ("list_max", "list_min")

    def side(x, extreme):
        xs = g.list(x, window)
        return g.let(f"100.0 * {find}({xs}, {extreme}({xs})) / {window}")

    up, down = lambda: side("high", top), lambda: side("low", low)
    return g.guard(pick(output, up=up, down=down, oscillator=lambda: g.let(f"{up()} - {down()}")), window)


@primitive("vortex", "directional")
def vortex(g, window, output="plus"):
    """Crossed ranges over the true range."""
    t = g.sum(true_range(g), window)
    plus = lambda: g.div(g.sum(g.let(f"abs(high - {g.lag('low')})"), window), t)
    minus = lambda: g.div(g.sum(g.let(f"abs(low - {g.lag('high')})"), window), t)
    return g.guard(pick(output, plus=plus, minus=minus, diff=lambda: g.let(f"{plus()} - {minus()}")), window + 1)


@primitive("chop", "directional")
def chop(g, window):
    """How far the path exceeds the range, on a logarithmic scale."""
    wide = g.let(f"{g.max('high', window)} - {g.min('low', window)}")
    t = g.sum(true_range(g), window)
    if window == 1:
        return g.guard("CAST(NULL AS DOUBLE)", 2)
    return g.guard(g.let(f"CASE WHEN {wide} > 0 AND {t} > 0 THEN 100.0 * log10({t} / {wide}) / {math.log10(window)!r} END"), window + 1)


@primitive("vhf", "directional")
def vhf(g, window, field="close"):
    """Range over path length."""
    wide = f"{g.max(field, window + 1)} - {g.min(field, window + 1)}"
    return g.guard(g.div(wide, g.sum(g.let(f"abs({change(g, field)})"), window)), window + 1)


def _trend_correlation(g, window, field):
    s = g.std(field, window, 0)
    return g.let(f"CASE WHEN {s} > 1E-12 THEN {slope(g, field, window)} * {math.sqrt((window**2 - 1) / 12)!r} / {s} END")


@primitive("cti", "directional")
def cti(g, window, field="close"):
    """Correlation with the bar number."""
    return g.guard(_trend_correlation(g, window, field), window, (field, window))


@primitive("linreg_r2", "directional")
def linreg_r2(g, window, field="close"):
    """Share of the variance that a line explains."""
    c = _trend_correlation(g, window, field)
    return g.guard(g.let(f"{c} * {c}"), window, (field, window))


@primitive("linreg_angle", "directional")
def linreg_angle(g, window, field="close"):
    """Angle of the regression line in degrees."""
    return g.guard(g.let(f"degrees(atan({slope(g, field, window)}))"), window, (field, window))


@primitive("ttm_trend", "directional")
def ttm_trend(g, window):
    """1 where the close is above the mean of middles."""
    return g.guard(g.when(f"close > {g.avg(g.let('(high + low) / 2.0'), window)}", "1E0", "0E0"), window)


def _trail(g, state, output):
    return pick(output, value=lambda: g.let(f"{state}.value"), direction=lambda: g.let(f"{state}.direction"))


@primitive("psar", "directional")
def psar(g, step=0.02, maximum=0.2, lookback=120, output="value"):
    """Parabolic stop over a truncated history that starts upward."""
    xs = g.list(g.let("struct(high AS h, low AS l)"), lookback)
    start = f"named_struct('up', true, 'sar', {xs}[0].l, 'ep', {xs}[0].h, 'af', {step}D, 'h', {xs}[0].h, 'l', {xs}[0].l)"
    moved = "(s.sar + s.af * (s.ep - s.sar))"
    held = f"(CASE WHEN s.up THEN least({moved}, s.l, v.l) ELSE greatest({moved}, s.h, v.h) END)"
    turn = f"(CASE WHEN s.up THEN v.l < {held} ELSE v.h > {held} END)"
    further = "(CASE WHEN s.up THEN v.h > s.ep ELSE v.l < s.ep END)"
    best = "(CASE WHEN s.up THEN v.h ELSE v.l END)"
    worst = "(CASE WHEN s.up THEN v.l ELSE v.h END)"
    next_ = (
        f"named_struct('up', s.up <> {turn}, 'sar', CASE WHEN {turn} THEN s.ep ELSE {held} END, "
        f"'ep', CASE WHEN {turn} THEN {worst} WHEN {further} THEN {best} ELSE s.ep END, "
        f"'af', CASE WHEN {turn} THEN {step}D WHEN {further} THEN least(s.af + {step}D, {maximum}D) ELSE s.af END, 'h', v.h, 'l', v.l)"
    )
    done = "named_struct('value', s.sar, 'direction', CASE WHEN s.up THEN 1.0D ELSE -1.0D END)"
    state = g.fold(f"slice({xs}, 2, {lookback})", start, next_, done)
    return g.guard(_trail(g, state, output), lookback)


@primitive("supertrend", "directional")
def supertrend(g, window, multiplier=3.0, lookback_multiplier=8, output="value"):
    """Range bands that only tighten while the trend holds, over a truncated history."""
    n = window * lookback_multiplier
    xs = g.list(g.let(f"struct((high + low) / 2.0D AS m, close AS c, {true_range(g)} AS t)"), n)
    seed = f"(aggregate(slice({xs}, 1, {window}), 0D, (s, v) -> s + v.t) / {window})"
    first = f"get({xs}, {window - 1})"
    start = f"named_struct('up', true, 'atr', {seed}, 'hi', {first}.m + {multiplier}D * {seed}, 'lo', {first}.m - {multiplier}D * {seed}, 'c', {first}.c)"
    atr = f"(s.atr + (v.t - s.atr) / {window})"
    hi, lo = f"(v.m + {multiplier}D * {atr})", f"(v.m - {multiplier}D * {atr})"
    high = f"(CASE WHEN {hi} < s.hi OR s.c > s.hi THEN {hi} ELSE s.hi END)"
    low = f"(CASE WHEN {lo} > s.lo OR s.c < s.lo THEN {lo} ELSE s.lo END)"
    next_ = f"named_struct('up', CASE WHEN v.c > {high} THEN true WHEN v.c < {low} THEN false ELSE s.up END, 'atr', {atr}, 'hi', {high}, 'lo', {low}, 'c', v.c)"
    done = "named_struct('value', CASE WHEN s.up THEN s.lo ELSE s.hi END, 'direction', CASE WHEN s.up THEN 1.0D ELSE -1.0D END)"
    state = g.fold(f"slice({xs}, {window + 1}, {n})", start, next_, done)
    return g.guard(_trail(g, state, output), n + 1)
