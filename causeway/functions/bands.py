"""Bands and channels."""

from __future__ import annotations

from causeway.functions.common import band_output, ema, true_range
from causeway.functions.registry import primitive


@primitive("bollinger", "bands")
def bollinger(g, window, field="close", multiplier=2.0, ddof=1, output="upper"):
    """Mean and standard deviations about it."""
    m, s = g.avg(field, window), g.std(field, window, ddof)
    up, low = g.let(f"{m} + {multiplier} * {s}"), g.let(f"{m} - {multiplier} * {s}")
    return g.guard(band_output(g, up, m, low, field, output), window, (field, window))


@primitive("keltner", "bands")
def keltner(g, window, multiplier=2.0, seed_multiplier=5, output="upper"):
    """Exponential mean and mean true ranges about it."""
    n = window * seed_multiplier
    m, r = ema(g, "close", window, n), g.avg(true_range(g), window)
    up, low = g.let(f"{m} + {multiplier} * {r}"), g.let(f"{m} - {multiplier} * {r}")
    return g.guard(band_output(g, up, m, low, "close", output), n + 1)


@primitive("donchian", "bands")
def donchian(g, window, output="upper"):
    """Highest high and lowest low."""
    up, low = g.max("high", window), g.min("low", window)
    return g.guard(band_output(g, up, g.let(f"({up} + {low}) / 2.0"), low, "close", output), window)


@primitive("envelope", "bands")
def envelope(g, window, field="close", percent=2.5, output="upper"):
    """Mean and a share of it on either side."""
    m = g.avg(field, window)
    up, low = g.let(f"{m} * {1 + percent / 100}"), g.let(f"{m} * {1 - percent / 100}")
    return g.guard(band_output(g, up, m, low, field, output), window, (field, window))


@primitive("acceleration_bands", "bands")
def acceleration_bands(g, window, factor=4.0, output="upper"):
    """Widths taken bar by bar from the relative range, then averaged."""
    total = g.let("high + low")
    wide = g.let(f"CASE WHEN {total} > 0 THEN {factor} * (high - low) / {total} END")
    up, low = g.avg(g.let(f"high * (1.0 + {wide})"), window), g.avg(g.let(f"low * (1.0 - {wide})"), window)
    return g.guard(band_output(g, up, g.avg("close", window), low, "close", output), window, (wide, window))


@primitive("squeeze", "bands")
def squeeze(g, window, multiplier=2.0, seed_multiplier=5, output="upper"):
    """1 where the deviation band lies inside the range band."""
    s = g.std("close", window, 1) if window > 1 else "0.0"
    inside = f"{multiplier} * {s} < {multiplier} * {g.avg(true_range(g), window)}"
    return g.guard(g.when(inside, "1E0", "0E0"), window * seed_multiplier + 1)
