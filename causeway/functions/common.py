"""Pieces that several families of primitives share."""

from __future__ import annotations

from causeway.functions.registry import ParameterError
from causeway.operators.graph import Graph, ema_series, response

TYPICAL = "(high + low + close) / 3.0"
MEDIAN = "(high + low) / 2.0"


def pick(output: str, **choices):
    """The chosen output; only that one is built."""
    if output not in choices:
        raise ParameterError(f"output must be one of {', '.join(choices)}, not {output!r}")
    return choices[output]()


def true_range(g: Graph) -> str:
    """Null on the first bar, which has no close before it."""
    before = g.lag("close")
    return g.let(f"CASE WHEN {before} IS NOT NULL THEN greatest(high - low, abs(high - {before}), abs(low - {before})) END")


def change(g: Graph, x: str, k: int = 1) -> str:
    return g.let(f"{x} - {g.lag(x, k)}")


def simple_return(g: Graph, x: str) -> str:
    """Null after a price that is not positive."""
    before = g.lag(x)
    return g.let(f"CASE WHEN {before} > 0 THEN ({x} - {before}) / {before} END")


def log_return(g: Graph, x: str) -> str:
    before = g.lag(x)
    return g.let(f"CASE WHEN {before} > 0 AND {x} > 0 THEN ln({x} / {before}) END")


def ema(g: Graph, x: str, n: int, length: int) -> str:
    """Exponential average of the last ``length`` values, seeded by the mean of the first n of them."""
    return g.fir(x, response(lambda v: ema_series(v, n)[-1], length))


def log_ratio(g: Graph, a: str, b: str) -> str:
    """ln(a / b) as floating point has it, where Spark has an error or no value: infinite if one of them is 0, not a number if both are or their signs differ."""
    r = g.let(f"CASE WHEN {b} <> 0 THEN {a} / {b} ELSE {a} * power({b}, -1) END")
    return g.let(f"CASE WHEN {r} > 0 THEN ln({r}) WHEN {r} = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN {r} < 0 THEN CAST('NaN' AS DOUBLE) END")


def slope(g: Graph, x: str, n: int) -> str:
    """Least-squares slope per bar over n values."""
    if n == 1:
        return g.let(f"{x} * 0.0")
    middle = (n - 1) / 2.0
    scale = sum((i - middle) ** 2 for i in range(n))
    return g.fir(x, [(i - middle) / scale for i in range(n)])


def correlation(g: Graph, a: str, b: str, n: int) -> str:
    """Null where a side is constant."""
    spread = g.let(f"{g.std(a, n, 0)} * {g.std(b, n, 0)}")
    together = g.let(f"covar_pop({a}, {b}) OVER {g.over(n)}", n - 1)
    return g.let(f"CASE WHEN {spread} > 1E-300 THEN {together} / {spread} END")


def line_output(g: Graph, line: str, signal, output: str) -> str:
    """line, signal or histogram; ``signal`` is built on demand."""
    return pick(output, line=lambda: line, signal=signal, histogram=lambda: g.let(f"{line} - {signal()}"))


def band_output(g: Graph, upper: str, middle: str, lower: str, x: str, output: str) -> str:
    wide = lambda: g.let(f"{upper} - {lower}")
    return pick(output, upper=lambda: upper, middle=lambda: middle, lower=lambda: lower, width=lambda: g.div(wide(), middle), percent=lambda: g.div(g.let(f"{x} - {lower}"), wide()))


