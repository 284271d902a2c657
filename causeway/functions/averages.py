"""Trend and smoothing primitives."""

from __future__ import annotations

import math

import numpy as np

from causeway.functions.common import ema, slope, true_range
from causeway.functions.registry import ParameterError, primitive
from causeway.operators.graph import Graph, ema_series, response, wilder_series, wma_series


def _fir(g: Graph, field: str, weights, bars: int | None = None) -> str:
    return g.guard(g.fir(field, weights), bars or len(weights), (field, len(weights)))


@primitive("sma", "trend")
def sma(g, window, field="close"):
    """Mean of the window."""
    return g.guard(g.avg(field, window), window, (field, window))


@primitive("ema", "trend")
def ema_(g, window, field="close", seed_multiplier=5):
    """Exponential mean over a truncated history, seeded by a simple mean."""
    n = window * seed_multiplier
    return g.guard(ema(g, field, window, n), n, (field, n))


@primitive("wma", "averages")
def wma(g, window, field="close"):
    """Linear weights, the newest heaviest."""
    return _fir(g, field, np.arange(1, window + 1) / (window * (window + 1) / 2))


@primitive("trima", "averages")
def trima(g, window, field="close"):
    """Mean of means over half windows."""
    d = (window + 1) // 2
    return g.guard(g.avg(g.avg(field, d), d), 2 * d - 1)


@primitive("swma", "averages")
def swma(g, window, field="close"):
    """Symmetric triangular weights."""
    w = np.minimum(np.arange(1, window + 1), np.arange(window, 0, -1))
    return _fir(g, field, w / w.sum())


@primitive("pwma", "averages")
def pwma(g, window, field="close"):
    """Binomial weights."""
    w = np.array([math.comb(window - 1, k) for k in range(window)], dtype=float)
    return _fir(g, field, w / w.sum())


@primitive("alma", "averages")
def alma(g, window, field="close", offset=0.85, sigma=6.0):
    """Gaussian weights about an offset."""
    if not 0 <= offset <= 1 or sigma <= 0:
        raise ParameterError("offset must lie in [0, 1] and sigma above 0")
    w = np.exp(-((np.arange(window) - offset * (window - 1)) ** 2) / (2 * (window / sigma) ** 2))
    return _fir(g, field, w / w.sum())


@primitive("smma", "averages")
def smma(g, window, field="close", seed_multiplier=5):
    """Wilder's mean over a truncated history."""
    n = window * seed_multiplier
    return _fir(g, field, response(lambda v: wilder_series(v, window)[-1], n))


def _nested(v, n, times):
    out = []
    for _ in range(times):
        v = ema_series(v, n)
        out.append(v[-1])
    return out


@primitive("dema", "averages")
def dema(g, window, field="close", seed_multiplier=5):
    """Twice the exponential mean less its own exponential mean."""
    return _fir(g, field, response(lambda v: np.dot([2, -1], _nested(v, window, 2)), window * seed_multiplier))


@primitive("tema", "averages")
def tema(g, window, field="close", seed_multiplier=5):
    """Triple exponential mean; undefined where the history is too short for three."""
    n = window * seed_multiplier
    if n < 3 * (window - 1) + 1:
        return g.guard("CAST(NULL AS DOUBLE)", n)
    return _fir(g, field, response(lambda v: np.dot([3, -3, 1], _nested(v, window, 3)), n))


@primitive("t3", "averages")
def t3(g, window, field="close", seed_multiplier=5, volume_factor=0.7):
    """Tillson's polynomial of six nested exponential means."""
    if not 0 <= volume_factor <= 1:
        raise ParameterError("volume_factor must lie in [0, 1]")
    n, a = max(window * seed_multiplier, 7 * window - 6), volume_factor
    # The expansion of ((1 + a) - a E)^3 E^3 in the averaging operator E.
    mix = [0, 0, (1 + a) ** 3, -3 * a * (1 + a) ** 2, 3 * a * a * (1 + a), -(a**3)]
    return _fir(g, field, response(lambda v: np.dot(mix, _nested(v, window, 6)), n))


@primitive("zlema", "averages")
def zlema(g, window, field="close", seed_multiplier=5):
    """Exponential mean of the series corrected by its own lag."""
    late = (window - 1) // 2
    n = window * seed_multiplier + late
    return _fir(g, field, response(lambda v: ema_series(2 * v[late:] - v[: len(v) - late], window)[-1], n))


@primitive("hma", "averages")
def hma(g, window, field="close"):
    """Hull: the weighted mean of twice a half-window mean less the whole one."""
    root, half = max(math.isqrt(window), 1), max(window // 2, 1)

    def hull(v):
        return wma_series(2 * wma_series(v, half)[-root:] - wma_series(v, window)[-root:], root)[-1]

    return _fir(g, field, response(hull, window + root))


@primitive("kama", "averages")
def kama(g, window, field="close", seed_multiplier=5, fast=2, slow=30):
    """Kaufman's mean: the smoothing follows net move over path length."""
    if fast >= slow:
        raise ParameterError("fast must be below slow")
    n = window * seed_multiplier + 1
    before = g.lag(field, window)
    path = g.sum(g.let(f"abs({field} - {g.lag(field)})"), window)
    ratio = g.let(f"CASE WHEN {path} = 0 THEN 0D ELSE abs({field} - {before}) / {path} END")
    a, b = 2.0 / (fast + 1), 2.0 / (slow + 1)
    alpha = g.let(f"power({ratio} * {a - b}D + {b}D, 2)")
    steps = g.list(g.let(f"struct({field} AS v, {alpha} AS a)"), n)
    seed = f"aggregate(slice({steps}, 1, {window + 1}), 0D, (s, v) -> s + v.v) / {window + 1}"
    return g.guard(g.fold(f"slice({steps}, {window + 2}, {n})", seed, "s + v.a * (v.v - s)", "s"), n)


@primitive("vwma", "averages")
def vwma(g, window, field="close"):
    """Mean weighted by volume."""
    return g.guard(g.div(g.sum(g.let(f"{field} * volume"), window), g.sum("volume", window)), window, (field, window))


@primitive("midpoint", "averages")
def midpoint(g, window, field="close"):
    """Middle of the window's range."""
    return g.guard(g.let(f"({g.max(field, window)} + {g.min(field, window)}) / 2.0"), window, (field, window))


@primitive("midprice", "averages")
def midprice(g, window):
    """Middle of the highest high and the lowest low."""
    return g.guard(g.let(f"({g.max('high', window)} + {g.min('low', window)}) / 2.0"), window)


def _regression(g, window, field, reach):
    return g.guard(g.let(f"{g.avg(field, window)} + {slope(g, field, window)} * {reach / 2.0}"), window, (field, window))


@primitive("linreg", "averages")
def linreg(g, window, field="close"):
    """Regression value at the last bar."""
    return _regression(g, window, field, window - 1)


@primitive("linreg_forecast", "averages")
def linreg_forecast(g, window, field="close"):
    """Regression value one bar ahead."""
    return _regression(g, window, field, window + 1)


@primitive("linreg_intercept", "averages")
def linreg_intercept(g, window, field="close"):
    """Regression value at the first bar."""
    return _regression(g, window, field, 1 - window)


@primitive("atr", "ranges")
def atr(g, window):
    """Mean true range."""
    return g.guard(g.avg(true_range(g), window), window + 1)


@primitive("rolling_high", "ranges")
def rolling_high(g, window, field="high"):
    """Largest of the window."""
    return g.guard(g.max(field, window), window, (field, window))


@primitive("rolling_low", "ranges")
def rolling_low(g, window, field="low"):
    """Smallest of the window."""
    return g.guard(g.min(field, window), window, (field, window))


@primitive("true_range", "ranges")
def true_range_(g):
    """Range that takes in the close before."""
    return g.guard(true_range(g), 2)
