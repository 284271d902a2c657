"""Volume and money flow."""

from __future__ import annotations

import numpy as np

from causeway.functions.common import MEDIAN, TYPICAL, change, line_output, simple_return
from causeway.functions.registry import ParameterError, primitive
from causeway.operators.graph import ema_series, response


@primitive("vwap", "volume")
def vwap(g, window):
    """Typical price weighted by volume."""
    v = g.sum("volume", window)
    return g.guard(g.let(f"CASE WHEN {v} > 0 THEN {g.sum(g.let(f'{TYPICAL} * volume'), window)} / {v} END"), window)


@primitive("obv", "volume")
def obv(g, window):
    """Volume signed by the close's move, summed."""
    d = change(g, "close")
    return g.guard(g.sum(g.let(f"CASE WHEN {d} > 0 THEN volume WHEN {d} < 0 THEN -volume WHEN {d} = 0 THEN 0.0 END"), window), window + 1)


def _located(g):
    """Volume times the close's place in the range; 0 on a flat bar."""
    return g.let("CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0.0 END")


@primitive("ad", "flow")
def ad(g, window):
    """Accumulation and distribution over the window."""
    return g.guard(g.sum(_located(g), window), window)


@primitive("adosc", "flow")
def adosc(g, window, fast_window=3, seed_multiplier=5):
    """Fast less slow exponential mean of the accumulated line."""
    if fast_window >= window:
        raise ParameterError("fast_window must be below window")
    n = window * seed_multiplier
    w = response(lambda v: ema_series(np.cumsum(v), fast_window)[-1] - ema_series(np.cumsum(v), window)[-1], n)
    return g.guard(g.fir(_located(g), w), n)


@primitive("cmf", "flow")
def cmf(g, window):
    """Located volume over volume."""
    return g.guard(g.div(g.sum(_located(g), window), g.sum("volume", window)), window)


@primitive("mfi", "flow")
def mfi(g, window):
    """Share of rising money flow in percent."""
    t = g.let(TYPICAL)
    d = change(g, t)
    up = g.sum(g.let(f"CASE WHEN {d} > 0 THEN {t} * volume ELSE 0.0 END"), window)
    down = g.sum(g.let(f"CASE WHEN {d} < 0 THEN {t} * volume ELSE 0.0 END"), window)
    return g.guard(g.div(f"100.0 * {up}", f"{up} + {down}"), window + 1)


@primitive("eom", "flow")
def eom(g, window):
    """Mean move of the middle times range per volume, over bars that have both."""
    d = change(g, g.let(MEDIAN))
    return g.guard(g.avg(g.let(f"CASE WHEN volume > 0 AND high > low THEN {d} * ((high - low) / volume) END"), window), window + 1)


@primitive("force_index", "flow")
def force_index(g, window):
    """Mean of the close's move times volume."""
    return g.guard(g.avg(g.let(f"{change(g, 'close')} * volume"), window), window + 1)


@primitive("pvt", "flow")
def pvt(g, window):
    """Returns times volume, summed."""
    r = simple_return(g, "close")
    return g.guard(g.sum(g.let(f"{r} * volume"), window), window + 1, (r, window))


def _by_volume(g, window, sign):
    r, d = simple_return(g, "close"), change(g, "volume")
    return g.guard(g.sum(g.let(f"CASE WHEN {d} {sign} 0 THEN 100.0 * {r} ELSE 0.0 END"), window), window + 1, (r, window))


@primitive("nvi", "flow")
def nvi(g, window):
    """Returns in percent of bars on which volume fell, summed."""
    return _by_volume(g, window, "<")


@primitive("pvi", "flow")
def pvi(g, window):
    """Returns in percent of bars on which volume rose, summed."""
    return _by_volume(g, window, ">")


@primitive("volume_oscillator", "flow")
def volume_oscillator(g, window, fast_window=3, seed_multiplier=5):
    """Short against long mean volume in percent."""
    if fast_window >= window:
        raise ParameterError("fast_window must be below window")
    m = g.avg("volume", window)
    return g.guard(g.div(f"100.0 * ({g.avg('volume', fast_window)} - {m})", m), window)


@primitive("klinger", "flow")
def klinger(g, window, field="close", slow_window=26, signal_window=9, seed_multiplier=5, output="line"):
    """Fast less slow exponential mean of signed volume; the signal is a plain mean."""
    n = slow_window * seed_multiplier + signal_window
    d = change(g, g.let(TYPICAL))
    x = g.let(f"CASE WHEN {d} < 0 THEN -volume WHEN {d} IS NOT NULL THEN volume END")

    def line(v):
        late = ema_series(v, slow_window)
        return ema_series(v, window)[-len(late) :] - late

    now = g.fir(x, response(lambda v: line(v)[-1], n))
    return g.guard(line_output(g, now, lambda: g.fir(x, response(lambda v: line(v)[-signal_window:].mean(), n)), output), n + 1)


@primitive("dollar_volume", "flow")
def dollar_volume(g, window):
    """Mean of typical price times volume."""
    return g.guard(g.avg(g.let(f"{TYPICAL} * volume"), window), window)
