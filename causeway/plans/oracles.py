"""DuckDB SQL of the primitives, written from their definitions.

Nothing here is shared with the builders in ``functions``: a value is worked out
from the lists ``o h l c v`` of the last bars alone, step by step and with plain
recursions, where the engine uses windows and weights. Bars with too short a
past have no value.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from types import SimpleNamespace

LETTER = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"}


class Past:
    """The last ``bars`` bars as lists, and columns that follow from them one after another."""

    def __init__(self, params: dict):
        self.p = SimpleNamespace(**params)
        self.x = LETTER.get(params.get("field", "close"))
        self.bars = 0
        self.steps: list[str] = []

    def let(self, expr: str) -> str:
        self.steps.append(expr)
        return f"s{len(self.steps)}"

    def each(self, first: int, last: int, body: str) -> str:
        """A list of ``body`` for i from first to last."""
        return self.let(f"list_transform(range({first}, {last + 1}), lambda i: {body})")

    def changes(self, x: str) -> str:
        return self.each(2, self.bars, f"{x}[i] - {x}[i - 1]")

    def rates(self, x: str) -> str:
        """Simple returns; undefined after a price that is not positive."""
        return self.each(2, self.bars, f"CASE WHEN {x}[i - 1] > 0 THEN {x}[i] / {x}[i - 1] - 1.0 END")

    def logs(self, x: str) -> str:
        return self.each(2, self.bars, f"CASE WHEN {x}[i - 1] > 0 AND {x}[i] > 0 THEN ln({x}[i]) - ln({x}[i - 1]) END")

    def true_ranges(self) -> str:
        return self.each(2, self.bars, "greatest(h[i], c[i - 1]) - least(l[i], c[i - 1])")

    def typical(self) -> str:
        return self.each(1, self.bars, "(h[i] + l[i] + c[i]) / 3.0")

    def middles(self) -> str:
        return self.each(1, self.bars, "(h[i] + l[i]) / 2.0")

    def running(self, x: str, length: int, n: int, alpha: float | None = None) -> str:
        """Exponential means of a list of ``length`` values, from the mean of the first n on."""
        return self.let(f"list_transform(range({n}, {length + 1}), lambda k: {recursion(f'{x}[1:k]', n, alpha)})")

    def mean(self, x: str, n: int, alpha: float | None = None) -> str:
        """The last exponential mean of a list."""
        return self.let(recursion(x, n, alpha))

    def sql(self, value: str, source: str, digits: int | None) -> str:
        lists = ", ".join(f"list({f}) OVER w AS {k}" for f, k in LETTER.items())
        rows = f"SELECT * FROM (SELECT symbol, bar_index, {lists} FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts_close ROWS BETWEEN {self.bars - 1} PRECEDING AND CURRENT ROW)) WHERE len(c) = {self.bars}"
        for i, expr in enumerate(self.steps, 1):
            rows = f"SELECT *, {expr} AS s{i} FROM ({rows})"
        out = "CAST(f.value AS DOUBLE)" if digits is None else f"round(CAST(f.value AS DOUBLE), {digits}) + 0.0"
        return f"WITH b AS (SELECT * FROM {source}), f AS (SELECT symbol, bar_index, {value} AS value FROM ({rows})) SELECT symbol, bar_index, {out} AS value FROM b LEFT JOIN f USING (symbol, bar_index)"


def recursion(x: str, n: int, alpha: float | None = None) -> str:
    alpha = 2.0 / (n + 1.0) if alpha is None else alpha
    return f"list_reduce(list_prepend(list_avg({x}[1:{n}]), {x}[{n + 1}:]), lambda a, e: a + {alpha!r} * (e - a))"


def last(x: str, n: int) -> str:
    return f"{x}[-{n}:]"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN ({a}) / ({b}) END"


def std(x: str, ddof: int = 1) -> str:
    return f"list_stddev_samp({x})" if ddof else f"list_stddev_pop({x})"


def whole(x: str, value: str) -> str:
    """The value if no element is undefined."""
    return f"CASE WHEN len(list_filter({x}, lambda e: e IS NULL)) = 0 THEN {value} END"


def choose(p, **outputs: str) -> str:
    return outputs[p.output]


FORMULAS: dict[str, Callable[[Past, SimpleNamespace], str]] = {}


def formula(*names: str):
    def register(f):
        for n in names:
            FORMULAS[n] = f
        return f

    return register


def window(*names: str, more: int = 0):
    """For formulas over a window of bars (and ``more``)."""

    def register(f):
        def run(b, p):
            b.bars = p.window + more
            return f(b, p)

        return formula(*names)(run)

    return register


# -- means ------------------------------------------------------------------------

window("sma")(lambda b, p: f"list_avg({b.x})")
window("wma")(lambda b, p: f"list_sum({b.each(1, p.window, f'{b.x}[i] * i')}) / {p.window * (p.window + 1) / 2}")
window("swma")(lambda b, p: f"list_sum({b.each(1, p.window, f'{b.x}[i] * least(i, {p.window + 1} - i)')}) / list_sum({b.each(1, p.window, f'least(i, {p.window + 1} - i)')})")
window("vwma")(lambda b, p: ratio(f"list_sum({b.each(1, p.window, f'{b.x}[i] * v[i]')})", "list_sum(v)"))
window("midpoint")(lambda b, p: f"(list_max({b.x}) + list_min({b.x})) / 2")
window("midprice")(lambda b, p: "(list_max(h) + list_min(l)) / 2")
window("rolling_high")(lambda b, p: f"list_max({b.x})")
window("rolling_low")(lambda b, p: f"list_min({b.x})")


@formula("ema", "smma")
def _(b, p):
    b.bars = p.window * p.seed_multiplier
    return b.mean(b.x, p.window, None if p.name == "ema" else 1.0 / p.window)


@formula("trima")
def _(b, p):
    d = (p.window + 1) // 2
    b.bars = 2 * d - 1
    return f"list_avg({b.each(d, b.bars, f'list_avg({b.x}[i - {d - 1}:i])')})"


@window("pwma")
def _(b, p):
    n = p.window - 1
    return f"list_sum({b.each(1, p.window, f'{b.x}[i] * gamma({n} + 1) / (gamma(i) * gamma({n + 2} - i))')}) / {2.0**n}"


@window("alma")
def _(b, p):
    w = b.each(1, p.window, f"exp(-power(i - 1 - {p.offset * (p.window - 1)!r}, 2) / {2 * (p.window / p.sigma) ** 2!r})")
    return f"list_sum({b.each(1, p.window, f'{b.x}[i] * {w}[i]')}) / list_sum({w})"


def nested(b, x, length, n, times):
    """Exponential means of exponential means, as lists with the length of the last."""
    out = []
    for _ in range(times):
        x, length = b.running(x, length, n), length - n + 1
        out.append(x)
    return out, length


@formula("dema", "tema")
def _(b, p):
    b.bars = p.window * p.seed_multiplier
    times = 2 if p.name == "dema" else 3
    if b.bars < times * (p.window - 1) + 1:
        return "NULL"
    e, _ = nested(b, b.x, b.bars, p.window, times)
    return f"2 * {e[0]}[-1] - {e[1]}[-1]" if times == 2 else f"3 * {e[0]}[-1] - 3 * {e[1]}[-1] + {e[2]}[-1]"


@formula("t3")
def _(b, p):
    b.bars, a = max(p.window * p.seed_multiplier, 6 * (p.window - 1) + p.window), p.volume_factor
    e, _ = nested(b, b.x, b.bars, p.window, 6)
    return f"{-(a**3)} * {e[5]}[-1] + {3 * a**2 + 3 * a**3} * {e[4]}[-1] + {-6 * a**2 - 3 * a - 3 * a**3} * {e[3]}[-1] + {1 + 3 * a + a**3 + 3 * a**2} * {e[2]}[-1]"


@formula("zlema")
def _(b, p):
    k = (p.window - 1) // 2
    b.bars = p.window * p.seed_multiplier + k
    return b.mean(b.each(k + 1, b.bars, f"2 * {b.x}[i] - {b.x}[i - {k}]"), p.window)


@formula("hma")
def _(b, p):
    root, half = max(int(math.sqrt(p.window)), 1), max(p.window // 2, 1)
    b.bars = p.window + root
    weighted = lambda n: f"list_sum(list_transform(range(1, {n + 1}), lambda j: j * {b.x}[i - {n} + j])) / {n * (n + 1) / 2}"
    raw = b.each(b.bars - root + 1, b.bars, f"2 * {weighted(half)} - {weighted(p.window)}")
    return f"list_sum({b.each(1, root, f'i * {raw}[i]')}) / {root * (root + 1) / 2}"


@formula("kama")
def _(b, p):
    b.bars, n, x = p.window * p.seed_multiplier + 1, p.window, b.x
    quick, idle = 2.0 / (p.fast + 1), 2.0 / (p.slow + 1)
    path = f"list_sum(list_transform(range(i - {n - 1}, i + 1), lambda j: abs({x}[j] - {x}[j - 1])))"
    share = b.each(n + 2, b.bars, f"CASE WHEN {path} = 0 THEN 0.0 ELSE abs({x}[i] - {x}[i - {n}]) / {path} END")
    pairs = b.each(n + 2, b.bars, f"{{'x': {x}[i], 'a': power({share}[i - {n + 1}] * {quick - idle!r} + {idle!r}, 2)}}")
    return f"list_reduce(list_prepend({{'x': list_avg({x}[1:{n + 1}]), 'a': CAST(0 AS DOUBLE)}}, {pairs}), lambda s, e: {{'x': s.x + e.a * (e.x - s.x), 'a': e.a}}).x"


def line_at(b, x, n, at):
    """Least squares over a list of n values, at an abscissa counted from its middle."""
    return f"list_avg({x}) + ({at}) * ({gradient(b, x, n)})"


def gradient(b, x, n):
    m = (n + 1) / 2
    return f"list_sum({b.each(1, n, f'(i - {m}) * {x}[i]')}) / {sum((i - m) ** 2 for i in range(1, n + 1)) or 1.0}"


window("linreg")(lambda b, p: line_at(b, b.x, p.window, (p.window - 1) / 2))
window("linreg_forecast")(lambda b, p: line_at(b, b.x, p.window, (p.window + 1) / 2))
window("linreg_intercept")(lambda b, p: line_at(b, b.x, p.window, (1 - p.window) / 2))
window("slope")(lambda b, p: gradient(b, b.x, p.window))
window("linreg_angle")(lambda b, p: f"atan({gradient(b, b.x, p.window)}) * 180 / pi()")
window("cfo")(lambda b, p: ratio(f"100 * ({b.x}[-1] - ({line_at(b, b.x, p.window, (p.window - 1) / 2)}))", f"{b.x}[-1]"))


@window("cti", "linreg_r2")
def _(b, p):
    m, y = (p.window + 1) / 2, b.let(f"list_avg({b.x})")
    up = f"list_sum({b.each(1, p.window, f'(i - {m}) * ({b.x}[i] - {y})')})"
    c = f"CASE WHEN {std(b.x, 0)} > 1e-12 THEN {up} / sqrt(list_sum({b.each(1, p.window, f'power(i - {m}, 2)')}) * list_sum({b.each(1, p.window, f'power({b.x}[i] - {y}, 2)')})) END"
    return c if p.name == "cti" else f"power({c}, 2)"


# -- bands ------------------------------------------------------------------------


def bands(p, upper, middle, lower, x):
    return choose(p, upper=upper, middle=middle, lower=lower, width=ratio(f"{upper} - {lower}", middle), percent=ratio(f"{x}[-1] - {lower}", f"({upper} - {lower})"))


@window("bollinger")
def _(b, p):
    m, s = b.let(f"list_avg({b.x})"), b.let(std(b.x, p.ddof))
    return bands(p, f"({m} + {p.multiplier} * {s})", m, f"({m} - {p.multiplier} * {s})", b.x)


@formula("keltner")
def _(b, p):
    b.bars = p.window * p.seed_multiplier + 1
    m, r = b.mean(b.let("c[2:]"), p.window), b.let(f"list_avg({last(b.true_ranges(), p.window)})")
    return bands(p, f"({m} + {p.multiplier} * {r})", m, f"({m} - {p.multiplier} * {r})", "c")


window("donchian")(lambda b, p: bands(p, "list_max(h)", "((list_max(h) + list_min(l)) / 2)", "list_min(l)", "c"))
window("envelope")(lambda b, p: bands(p, f"(list_avg({b.x}) * {1 + p.percent / 100})", f"list_avg({b.x})", f"(list_avg({b.x}) * {1 - p.percent / 100})", b.x))


@window("acceleration_bands")
def _(b, p):
    f = b.each(1, p.window, f"CASE WHEN h[i] + l[i] > 0 THEN {p.factor} * (h[i] - l[i]) / (h[i] + l[i]) END")
    up, low = (b.let(f"list_avg({b.each(1, p.window, e)})") for e in (f"h[i] * (1 + {f}[i])", f"l[i] * (1 - {f}[i])"))
    return whole(f, bands(p, up, "list_avg(c)", low, "c"))


@formula("squeeze")
def _(b, p):
    b.bars = p.window * p.seed_multiplier + 1
    return f"CASE WHEN {p.multiplier} * {std(last('c', p.window))} < {p.multiplier} * list_avg({last(b.true_ranges(), p.window)}) THEN 1 ELSE 0 END"


# -- direction --------------------------------------------------------------------


def moves(b):
    up, down = b.changes("h"), b.each(2, b.bars, "l[i - 1] - l[i]")
    n = b.bars - 1
    return b.each(1, n, f"CASE WHEN {up}[i] > {down}[i] AND {up}[i] > 0 THEN {up}[i] ELSE 0.0 END"), b.each(1, n, f"CASE WHEN {down}[i] > {up}[i] AND {down}[i] > 0 THEN {down}[i] ELSE 0.0 END")


@formula("dx")
def _(b, p):
    b.bars = p.window * p.seed_multiplier + 1
    plus, minus, t = (b.mean(x, p.window, 1.0 / p.window) for x in (*moves(b), b.true_ranges()))
    plus, minus = b.let(f"CASE WHEN {t} > 0 THEN 100 * {plus} / {t} END"), b.let(f"CASE WHEN {t} > 0 THEN 100 * {minus} / {t} END")
    return f"CASE WHEN {plus} + {minus} > 0 THEN 100 * abs({plus} - {minus}) / ({plus} + {minus}) END"


@formula("adx", "adxr")
def _(b, p):
    n = p.window * (p.seed_multiplier + 1)
    b.bars, m = n + 1, n - p.window + 1
    plus, minus, t = (b.running(x, n, p.window, 1.0 / p.window) for x in (*moves(b), b.true_ranges()))
    plus, minus = (b.each(1, m, f"CASE WHEN {t}[i] > 0 THEN 100 * {x}[i] / {t}[i] END") for x in (plus, minus))
    d = b.each(1, m, f"CASE WHEN {plus}[i] + {minus}[i] > 0 THEN 100 * abs({plus}[i] - {minus}[i]) / ({plus}[i] + {minus}[i]) END")
    a = b.running(d, m, p.window, 1.0 / p.window)
    if p.name == "adxr":
        return whole(d, f"({a}[-1] + {a}[-{p.window + 1}]) / 2")
    return choose(p, adx=whole(d, f"{a}[-1]"), plus_di=f"{plus}[-1]", minus_di=f"{minus}[-1]")


@formula("atr_wilder", "atr_wilder_pct")
def _(b, p):
    b.bars = p.window * p.seed_multiplier + 1
    a = b.mean(b.true_ranges(), p.window, 1.0 / p.window)
    return a if p.name == "atr_wilder" else ratio(f"100 * {a}", "c[-1]")


def strength(up, down):
    return f"CASE WHEN {up} = 0 AND {down} = 0 THEN NULL WHEN {down} = 0 THEN 100 WHEN {up} = 0 THEN 0 ELSE 100 - 100 / (1 + {up} / {down}) END"


@formula("rsi_wilder")
def _(b, p):
    b.bars = p.window * p.seed_multiplier + 1
    d = b.changes(b.x)
    up, down = (b.mean(b.each(1, b.bars - 1, f"greatest({s}{d}[i], 0)"), p.window, 1.0 / p.window) for s in ("", "-"))
    return strength(up, down)


@window("aroon")
def _(b, p):
    up, down = (f"100.0 * list_position({x}, {f}({x})) / {p.window}" for x, f in (("h", "list_max"), ("l", "list_min")))
    return choose(p, up=up, down=down, oscillator=f"{up} - {down}")


@window("vortex", more=1)
def _(b, p):
    t = f"list_sum({b.true_ranges()})"
    plus, minus = (ratio(f"list_sum({b.each(2, b.bars, f'abs({x}[i] - {y}[i - 1])')})", t) for x, y in (("h", "l"), ("l", "h")))
    return choose(p, plus=plus, minus=minus, diff=f"({plus}) - ({minus})")


@window("chop", more=1)
def _(b, p):
    wide = "(list_max(h[2:]) - list_min(l[2:]))"
    t = f"list_sum({b.true_ranges()})"
    return f"CASE WHEN {wide} > 0 AND {t} > 0 THEN 100 * log10({t} / {wide}) / log10({p.window}) END"


window("vhf", more=1)(lambda b, p: ratio(f"list_max({b.x}) - list_min({b.x})", f"list_sum({b.each(2, b.bars, f'abs({b.x}[i] - {b.x}[i - 1])')})"))
window("ttm_trend")(lambda b, p: f"CASE WHEN c[-1] > list_avg({b.middles()}) THEN 1 ELSE 0 END")


@formula("psar")
def _(b, p):
    b.bars = p.lookback
    row = lambda i: f"{{'up': TRUE, 'sar': l[{i}], 'ep': h[{i}], 'af': CAST({p.step} AS DOUBLE), 'h': h[{i}], 'l': l[{i}]}}"
    states = b.each(1, b.bars, row("i"))
    drift = "(s.sar + s.af * (s.ep - s.sar))"
    stop = f"(CASE WHEN s.up THEN least({drift}, s.l, e.l) ELSE greatest({drift}, s.h, e.h) END)"
    turn = f"(CASE WHEN s.up THEN e.l < {stop} ELSE e.h > {stop} END)"
    new = "(CASE WHEN s.up THEN e.h > s.ep ELSE e.l < s.ep END)"
    step = (
        f"{{'up': s.up <> {turn}, 'sar': CASE WHEN {turn} THEN s.ep ELSE {stop} END, 'ep': CASE WHEN {turn} THEN CASE WHEN s.up THEN e.l ELSE e.h END WHEN {new} THEN CASE WHEN s.up THEN e.h ELSE e.l END ELSE s.ep END, "
        f"'af': CASE WHEN {turn} THEN {p.step} WHEN {new} THEN least(s.af + {p.step}, {p.maximum}) ELSE s.af END, 'h': e.h, 'l': e.l}}"
    )
    end = b.let(f"list_reduce({states}, lambda s, e: {step})")
    return choose(p, value=f"{end}.sar", direction=f"CASE WHEN {end}.up THEN 1 ELSE -1 END")


@formula("supertrend")
def _(b, p):
    n, w = p.window * p.lookback_multiplier, p.window
    b.bars = n + 1
    t = b.true_ranges()
    a = b.running(t, n, w, 1.0 / w)  # from true range w, which is that of bar w + 1
    raw = b.each(w + 1, b.bars, f"{{'up': TRUE, 'hi': (h[i] + l[i]) / 2 + {p.multiplier} * {a}[i - {w}], 'lo': (h[i] + l[i]) / 2 - {p.multiplier} * {a}[i - {w}], 'c': c[i]}}")
    hi = "(CASE WHEN e.hi < s.hi OR s.c > s.hi THEN e.hi ELSE s.hi END)"
    lo = "(CASE WHEN e.lo > s.lo OR s.c < s.lo THEN e.lo ELSE s.lo END)"
    end = b.let(f"list_reduce({raw}, lambda s, e: {{'up': CASE WHEN e.c > {hi} THEN TRUE WHEN e.c < {lo} THEN FALSE ELSE s.up END, 'hi': {hi}, 'lo': {lo}, 'c': e.c}})")
    return choose(p, value=f"CASE WHEN {end}.up THEN {end}.lo ELSE {end}.hi END", direction=f"CASE WHEN {end}.up THEN 1 ELSE -1 END")


# -- oscillators ------------------------------------------------------------------


def two_means(b, x, length, fast, slow, term):
    """``term`` of the fast (f) and the slow (g) exponential mean at each place where both are there."""
    f, g = b.running(x, length, fast), b.running(x, length, slow)
    return b.let(f"list_transform(range(1, {length - slow + 2}), lambda i: {term(f'{f}[i + {slow - fast}]', f'{g}[i]')})")


@formula("macd")
def _(b, p):
    b.bars = p.slow * p.seed_multiplier + p.signal
    line = two_means(b, b.x, b.bars, p.fast, p.slow, lambda f, g: f"{f} - {g}")
    signal = b.mean(line, p.signal)
    return choose(p, line=f"{line}[-1]", signal=signal, histogram=f"{line}[-1] - {signal}")


@formula("ppo", "pvo")
def _(b, p):
    b.bars = p.slow_window * p.seed_multiplier + p.signal_window
    x, fine = (b.x, "<>") if p.name == "ppo" else ("v", ">")
    line = two_means(b, x, b.bars, p.window, p.slow_window, lambda f, g: f"CASE WHEN {g} {fine} 0 THEN 100 * ({f} - {g}) / {g} END")
    signal = b.mean(line, p.signal_window)
    return whole(line, choose(p, line=f"{line}[-1]", signal=signal, histogram=f"{line}[-1] - {signal}"))


@formula("apo")
def _(b, p):
    b.bars = p.slow_window * p.seed_multiplier + p.signal_window
    x = b.let(last(b.x, p.slow_window * p.seed_multiplier))
    return f"{b.mean(x, p.window)} - {b.mean(x, p.slow_window)}"


@formula("klinger")
def _(b, p):
    n = p.slow_window * p.seed_multiplier + p.signal_window
    b.bars = n + 1
    t = b.typical()
    signed = b.each(2, b.bars, f"CASE WHEN {t}[i] < {t}[i - 1] THEN -v[i] ELSE v[i] END")
    line = two_means(b, signed, n, p.window, p.slow_window, lambda f, g: f"{f} - {g}")
    signal = f"list_avg({last(line, p.signal_window)})"
    return choose(p, line=f"{line}[-1]", signal=signal, histogram=f"{line}[-1] - {signal}")


@formula("trix")
def _(b, p):
    b.bars = p.window * p.seed_multiplier + p.signal_window + 1
    if b.bars < 3 * (p.window - 1) + p.signal_window + 1:
        return "NULL"
    e, m = nested(b, b.x, b.bars, p.window, 3)
    rates = b.each(m - p.signal_window + 1, m, f"CASE WHEN {e[2]}[i - 1] <> 0 THEN 100 * ({e[2]}[i] / {e[2]}[i - 1] - 1) ELSE 0.0 END")
    return choose(p, line=f"{rates}[-1]", signal=f"list_avg({rates})", histogram=f"{rates}[-1] - list_avg({rates})")


def smoothed(b, x, length, first, second):
    return b.mean(b.running(x, length, first), second)


@formula("tsi")
def _(b, p):
    n = p.slow_window * p.seed_multiplier
    b.bars = n + p.signal_window + 1
    d = b.let(last(b.changes(b.x), n))
    return ratio(f"100 * {smoothed(b, d, n, p.slow_window, p.window)}", smoothed(b, b.each(1, n, f"abs({d}[i])"), n, p.slow_window, p.window))


@formula("pmo")
def _(b, p):
    n = p.slow_window * p.seed_multiplier
    b.bars = n + p.signal_window + 1
    r = b.let(last(b.each(2, b.bars, f"CASE WHEN {b.x}[i - 1] <> 0 THEN 100 * ({b.x}[i] / {b.x}[i - 1] - 1) END"), n))
    return whole(r, f"10 * {smoothed(b, r, n, p.slow_window, p.window)}")


@formula("coppock")
def _(b, p):
    b.bars, x, w = p.slow_window + p.window + 1, b.x, p.window
    part = lambda k: f"CASE WHEN {x}[i - {k}] <> 0 THEN 100 * ({x}[i] / {x}[i - {k}] - 1) END"
    both = b.each(b.bars - w + 1, b.bars, f"{part(w)} + {part(p.slow_window)}")
    return whole(both, f"list_sum({b.each(1, w, f'i * {both}[i]')}) / {w * (w + 1) / 2}")


@formula("smi")
def _(b, p):
    b.bars, w = p.slow_window * p.seed_multiplier, p.window
    n = b.bars - w + 1
    top, low = (b.each(w, b.bars, f"{f}({x}[i - {w - 1}:i])") for f, x in (("list_max", "h"), ("list_min", "l")))
    off = b.each(1, n, f"c[i + {w - 1}] - ({top}[i] + {low}[i]) / 2")
    wide = b.each(1, n, f"{top}[i] - {low}[i]")
    return ratio(f"100 * {smoothed(b, off, n, p.signal_window, p.signal_window)}", f"(0.5 * {smoothed(b, wide, n, p.signal_window, p.signal_window)})")


@window("cci")
def _(b, p):
    t = b.typical()
    m = b.let(f"list_avg({t})")
    d = f"list_avg({b.each(1, p.window, f'abs({t}[i] - {m})')})"
    return f"CASE WHEN {d} > 1e-12 THEN ({t}[-1] - {m}) / (0.015 * {d}) END"


window("williams_r")(lambda b, p: ratio("-100 * (list_max(h) - c[-1])", "(list_max(h) - list_min(l))"))
window("stochastic")(lambda b, p: ratio(f"100 * ({b.x}[-1] - list_min(l))", "(list_max(h) - list_min(l))"))
window("efficiency_ratio", more=1)(lambda b, p: ratio(f"abs({b.x}[-1] - {b.x}[1])", f"list_sum({b.each(2, b.bars, f'abs({b.x}[i] - {b.x}[i - 1])')})"))
window("mom", more=1)(lambda b, p: f"{b.x}[-1] - {b.x}[1]")
window("roc", more=1)(lambda b, p: ratio(f"100 * ({b.x}[-1] - {b.x}[1])", f"{b.x}[1]"))
window("rocr", more=1)(lambda b, p: ratio(f"{b.x}[-1]", f"{b.x}[1]"))
window("bias")(lambda b, p: ratio(f"100 * ({b.x}[-1] - list_avg({b.x}))", f"list_avg({b.x})"))
window("psl", more=1)(lambda b, p: f"100.0 * len(list_filter({b.changes(b.x)}, lambda e: e > 0)) / {p.window}")
window("qstick")(lambda b, p: f"list_avg({b.each(1, p.window, 'c[i] - o[i]')})")
window("bop")(lambda b, p: f"list_avg({b.each(1, p.window, 'CASE WHEN h[i] > l[i] THEN (c[i] - o[i]) / (h[i] - l[i]) END')})")
window("elder_ray")(lambda b, p: "(h[-1] - list_avg(c)) + (l[-1] - list_avg(c))")
window("center_of_gravity")(lambda b, p: ratio(f"-list_sum({b.each(1, p.window, f'{b.x}[i] * ({p.window + 1} - i)')})", f"list_sum({b.x})"))
window("pgo", more=1)(lambda b, p: ratio("c[-1] - list_avg(c[2:])", f"list_avg({b.true_ranges()})"))


@window("rsi", more=1)
def _(b, p):
    d = b.changes(b.x)
    up, down = (b.let(f"list_sum({b.each(1, p.window, f'greatest({s}{d}[i], 0)')})") for s in ("", "-"))
    return strength(up, down)


@window("cmo", more=1)
def _(b, p):
    d = b.changes(b.x)
    up, down = (b.let(f"list_sum({b.each(1, p.window, f'greatest({s}{d}[i], 0)')})") for s in ("", "-"))
    return ratio(f"100 * ({up} - {down})", f"({up} + {down})")


@formula("dpo")
def _(b, p):
    d = p.window // 2 + 1
    b.bars = p.window + d
    return f"{b.x}[{p.window}] - list_avg({b.x}[1:{p.window}])"


@formula("awesome")
def _(b, p):
    b.bars = p.slow
    m = b.middles()
    return f"list_avg({last(m, p.fast)}) - list_avg({m})"


def stochastics(b, p, raw, count):
    """K and D of ``count`` raw values."""
    k = b.each(p.smooth_k, count, f"list_avg({raw}[i - {p.smooth_k - 1}:i])")
    return whole(raw, choose(p, k=f"{k}[-1]", d=f"list_avg({last(k, p.smooth_d)})"))


@formula("stoch")
def _(b, p):
    b.bars, w = p.window + p.smooth_k + p.smooth_d - 2, p.window
    top, low = f"list_max(h[i - {w - 1}:i])", f"list_min(l[i - {w - 1}:i])"
    return stochastics(b, p, b.each(w, b.bars, f"CASE WHEN {top} > {low} THEN 100 * (c[i] - {low}) / ({top} - {low}) END"), p.smooth_k + p.smooth_d - 1)


@formula("stoch_rsi")
def _(b, p):
    b.bars, w = 2 * p.window + p.smooth_k + p.smooth_d - 1, p.window
    d = b.changes("c")
    n = b.bars - 1
    up, down = (b.each(w, n, f"list_sum(list_transform({d}[i - {w - 1}:i], lambda e: greatest({s}e, 0)))") for s in ("", "-"))
    r = b.each(1, n - w + 1, strength(f"{up}[i]", f"{down}[i]"))
    part = f"{r}[i - {w - 1}:i]"
    full = f"len(list_filter({part}, lambda e: e IS NULL)) = 0"
    raw = b.each(w + 1, n - w + 1, f"CASE WHEN {full} AND list_max({part}) - list_min({part}) > 1e-12 THEN 100 * ({r}[i] - list_min({part})) / (list_max({part}) - list_min({part})) END")
    return stochastics(b, p, raw, p.smooth_k + p.smooth_d - 1)


@formula("ultimate")
def _(b, p):
    b.bars = p.slow + 1
    low, top = b.each(2, b.bars, "least(l[i], c[i - 1])"), b.each(2, b.bars, "greatest(h[i], c[i - 1])")
    bought, wide = b.each(2, b.bars, f"c[i] - {low}[i - 1]"), b.each(1, p.slow, f"{top}[i] - {low}[i]")
    a, m, s = (f"({ratio(f'list_sum({last(bought, n)})', f'list_sum({last(wide, n)})')})" for n in (p.fast, p.medium, p.slow))
    return f"100 * (4 * {a} + 2 * {m} + {s}) / 7"


@window("rvgi", more=3)
def _(b, p):
    part = lambda x: f"list_sum({b.each(4, b.bars, f'({x("i")} + 2 * ({x("i - 1")}) + 2 * ({x("i - 2")}) + {x("i - 3")}) / 6')})"
    return ratio(part(lambda i: f"c[{i}] - o[{i}]"), part(lambda i: f"h[{i}] - l[{i}]"))


@formula("fisher")
def _(b, p):
    b.bars, w = p.window * p.seed_multiplier + p.signal_window, p.window
    m = b.middles()
    part = f"{m}[i - {w - 1}:i]"
    z = b.each(b.bars - p.signal_window, b.bars, f"CASE WHEN list_max({part}) > list_min({part}) THEN 2 * ({m}[i] - list_min({part})) / (list_max({part}) - list_min({part})) - 1 END")
    f = b.each(1, p.signal_window + 1, f"atanh(greatest(least({z}[i], 0.999), -0.999))")
    return whole(z, choose(p, line=f"{f}[-1]", signal=f"{f}[-2]", histogram=f"{f}[-1] - {f}[-2]"))


def spreads(d):
    """Population spreads times counts of rises and of falls."""
    side = lambda sign: f"coalesce(list_stddev_pop(list_filter({d}, lambda e: e {sign} 0)) * len(list_filter({d}, lambda e: e {sign} 0)), 0)"
    up, down = side(">"), side("<")
    return f"CASE WHEN {up} + {down} > 1e-12 THEN 100 * {up} / ({up} + {down}) END"


window("rvi_volatility", more=1)(lambda b, p: spreads(b.changes(b.x)))


@formula("inertia")
def _(b, p):
    b.bars, w = 2 * p.window, p.window
    d = b.changes(b.x)
    r = b.each(w, b.bars - 1, spreads(f"{d}[i - {w - 1}:i]"))
    return whole(r, line_at(b, r, w, (w - 1) / 2))


# -- ranges, statistics -----------------------------------------------------------

window("atr", more=1)(lambda b, p: f"list_avg({b.true_ranges()})")
window("natr", more=1)(lambda b, p: ratio(f"100 * list_avg({b.true_ranges()})", "c[-1]"))
window("zscore")(lambda b, p: f"CASE WHEN {std(b.x, p.ddof)} > 1e-12 THEN ({b.x}[-1] - list_avg({b.x})) / {std(b.x, p.ddof)} END")
window("stdev")(lambda b, p: std(b.x, p.ddof))
window("variance")(lambda b, p: f"list_var_samp({b.x})")
window("stderr")(lambda b, p: f"{std(b.x)} / sqrt({p.window})")
window("median")(lambda b, p: f"list_median({b.x})")
window("quantile")(lambda b, p: f"list_aggregate({b.x}, 'quantile_cont', {float(p.q)})")
window("percentile_rank")(lambda b, p: f"100.0 * len(list_filter({b.x}, lambda e: e <= {b.x}[-1])) / {p.window}")
window("mad")(lambda b, p: f"list_avg({b.each(1, p.window, f'abs({b.x}[i] - list_avg({b.x}))')})")


@formula("true_range")
def _(b, p):
    b.bars = 2
    return "greatest(h[2] - l[2], abs(h[2] - c[1]), abs(l[2] - c[1]))"


@window("returns", more=1)
def _(b, p):
    r = f"CASE WHEN {b.x}[1] * {b.x}[-1] > 0 THEN {b.x}[-1] / {b.x}[1] END"
    return f"ln({r})" if p.log else f"({r}) - 1"


@window("volatility", more=1)
def _(b, p):
    r = b.logs(b.x) if p.log else b.rates(b.x)
    return whole(r, f"{std(r, p.ddof)} * sqrt({p.annualise or 1.0})")


@window("skew", "kurtosis", more=1)
def _(b, p):
    r = b.rates(b.x)
    m, s = b.let(f"list_avg({r})"), b.let(std(r, 0))
    k, excess = (3, 0) if p.name == "skew" else (4, 3)
    return whole(r, f"CASE WHEN {s} > 1e-12 THEN list_avg({b.each(1, p.window, f'power(({r}[i] - {m}) / {s}, {k})')}) - {excess} END")


@window("entropy", more=1)
def _(b, p):
    r = b.rates(b.x)
    low, wide = b.let(f"list_min({r})"), b.let(f"list_max({r}) - list_min({r})")
    at = b.each(1, p.window, f"CASE WHEN {wide} > 0 THEN least(floor(({r}[i] - {low}) / {wide} * {p.bins}), {p.bins - 1}) END")
    share = b.let(f"list_transform(range(0, {p.bins}), lambda k: len(list_filter({at}, lambda e: e = k)) / {float(p.window)})")
    return whole(r, f"CASE WHEN {wide} > 0 THEN -list_sum(list_transform(list_filter({share}, lambda e: e > 0), lambda e: e * ln(e))) / ln({p.bins}) END")


def together(b, x, y, n):
    """Correlation of two lists."""
    mx, my = b.let(f"list_avg({x})"), b.let(f"list_avg({y})")
    cov = f"list_sum({b.each(1, n, f'({x}[i] - {mx}) * ({y}[i] - {my})')}) / {n}"
    scale = b.let(f"{std(x, 0)} * {std(y, 0)}")
    return f"CASE WHEN {scale} > 1e-300 THEN {cov} / {scale} END"


window("correlation")(lambda b, p: together(b, b.x, LETTER[p.other], p.window))


@formula("autocorrelation")
def _(b, p):
    b.bars = p.window + p.lag + 1
    r = b.rates(b.x)
    return whole(r, together(b, b.let(last(r, p.window)), b.let(f"{r}[1:{p.window}]"), p.window))


@window("beta", more=1)
def _(b, p):
    x, y = b.rates(b.x), b.rates(LETTER[p.other])
    mx, my = b.let(f"list_avg({x})"), b.let(f"list_avg({y})")
    v = b.let(f"list_avg({b.each(1, p.window, f'power({y}[i] - {my}, 2)')})")
    return whole(x, whole(y, f"CASE WHEN {v} > 1e-24 THEN list_avg({b.each(1, p.window, f'({x}[i] - {mx}) * ({y}[i] - {my})')}) / {v} END"))


@window("hurst", more=1)
def _(b, p):
    sizes = [e for e in (2, 4, 8) if p.window // e >= 2]
    if p.window < 8 or len(sizes) < 2:
        return "NULL"
    r, ys = b.logs(b.x), []
    for e in sizes:
        sums = b.each(1, p.window // e, f"list_sum({r}[(i - 1) * {e} + 1:i * {e}])")
        ys.append(b.let(f"CASE WHEN {std(sums, 0)} > 0 THEN ln({std(sums, 0)}) END"))
    xs = [math.log(e) for e in sizes]
    m = sum(xs) / len(xs)
    top = " + ".join(f"({x - m!r}) * {y}" for x, y in zip(xs, ys, strict=True))
    return whole(r, f"({top}) / {sum((x - m) ** 2 for x in xs)!r}")


# -- volatility, volume -----------------------------------------------------------

window("parkinson")(lambda b, p: f"sqrt(list_avg({b.each(1, p.window, 'power(ln(h[i] / l[i]), 2)')}) / (4 * ln(2)))")


@window("garman_klass", "rogers_satchell")
def _(b, p):
    term = "0.5 * power(ln(h[i] / l[i]), 2) - (2 * ln(2) - 1) * power(ln(c[i] / o[i]), 2)" if p.name == "garman_klass" else "ln(h[i] / c[i]) * ln(h[i] / o[i]) + ln(l[i] / c[i]) * ln(l[i] / o[i])"
    m = b.let(f"list_avg({b.each(1, p.window, term)})")
    return f"CASE WHEN {m} > 0 THEN sqrt({m}) END"


@formula("chaikin_volatility")
def _(b, p):
    b.bars = p.slow_window + p.window
    r = b.each(1, b.bars, "h[i] - l[i]")
    now, then = b.let(f"list_avg({last(r, p.window)})"), b.let(f"list_avg({r}[1:{p.window}])")
    return ratio(f"100 * ({now} - {then})", then)


@formula("mass_index")
def _(b, p):
    b.bars, k = p.window * p.seed_multiplier + p.sum_window, p.sum_window
    if b.bars - 2 * (p.window - 1) < k:
        return "NULL"
    x = b.each(1, b.bars, "CASE WHEN h[i] > l[i] THEN h[i] - l[i] END")
    (one, two), _ = nested(b, x, b.bars, p.window, 2)
    return whole(x, f"list_sum(list_transform(range(1, {k + 1}), lambda i: {one}[-i] / {two}[-i]))")


@window("ulcer_index", "max_drawdown")
def _(b, p):
    top = f"list_max({b.x}[1:i])"
    fall = b.each(1, p.window, f"CASE WHEN {top} > 0 THEN 100 * ({b.x}[i] / {top} - 1) END")
    return whole(fall, f"sqrt(list_avg(list_transform({fall}, lambda e: e * e)))" if p.name == "ulcer_index" else f"list_min({fall})")


@window("downside_deviation", "upside_deviation", more=1)
def _(b, p):
    r, f = b.rates(b.x), "least" if p.name == "downside_deviation" else "greatest"
    return whole(r, f"sqrt(list_avg(list_transform({r}, lambda e: power({f}(e - {p.threshold}, 0), 2))))")


@formula("volatility_ratio")
def _(b, p):
    b.bars = p.slow_window + 1
    r = b.logs("c")
    return whole(r, f"CASE WHEN {std(r)} > 1e-12 THEN {std(last(r, p.window))} / {std(r)} END")


@formula("atr_ratio")
def _(b, p):
    b.bars = p.slow_window + 1
    t = b.true_ranges()
    return ratio(f"list_avg({last(t, p.window)})", f"list_avg({t})")


window("vwap")(lambda b, p: f"CASE WHEN list_sum(v) > 0 THEN list_sum({b.each(1, p.window, '(h[i] + l[i] + c[i]) / 3.0 * v[i]')}) / list_sum(v) END")
window("obv", more=1)(lambda b, p: f"list_sum({b.each(2, b.bars, 'sign(c[i] - c[i - 1]) * v[i]')})")
window("force_index", more=1)(lambda b, p: f"list_avg({b.each(2, b.bars, '(c[i] - c[i - 1]) * v[i]')})")
window("dollar_volume")(lambda b, p: f"list_avg({b.each(1, p.window, '(h[i] + l[i] + c[i]) / 3.0 * v[i]')})")
window("volume_oscillator")(lambda b, p: ratio(f"100 * (list_avg({last('v', p.fast_window)}) - list_avg(v))", "list_avg(v)"))


def located(b):
    return b.each(1, b.bars, "CASE WHEN h[i] > l[i] THEN (2 * c[i] - l[i] - h[i]) / (h[i] - l[i]) * v[i] ELSE 0.0 END")


window("ad")(lambda b, p: f"list_sum({located(b)})")
window("cmf")(lambda b, p: ratio(f"list_sum({located(b)})", "list_sum(v)"))


@formula("adosc")
def _(b, p):
    b.bars = p.window * p.seed_multiplier
    x = located(b)
    total = b.each(1, b.bars, f"list_sum({x}[1:i])")
    return f"{b.mean(total, p.fast_window)} - {b.mean(total, p.window)}"


@window("mfi", more=1)
def _(b, p):
    t = b.typical()
    up, down = (f"list_sum({b.each(2, b.bars, f'CASE WHEN {t}[i] {s} {t}[i - 1] THEN {t}[i] * v[i] ELSE 0.0 END')})" for s in "><")
    return ratio(f"100 * {up}", f"({up} + {down})")


window("eom", more=1)(lambda b, p: f"list_avg({b.each(2, b.bars, 'CASE WHEN v[i] > 0 AND h[i] > l[i] THEN ((h[i] + l[i]) / 2 - (h[i - 1] + l[i - 1]) / 2) * (h[i] - l[i]) / v[i] END')})")


@window("pvt", "nvi", "pvi", more=1)
def _(b, p):
    r = b.rates("c")
    term = {"pvt": f"{r}[i - 1] * v[i]", "nvi": f"CASE WHEN v[i] < v[i - 1] THEN 100 * {r}[i - 1] ELSE 0.0 END", "pvi": f"CASE WHEN v[i] > v[i - 1] THEN 100 * {r}[i - 1] ELSE 0.0 END"}[p.name]
    return whole(r, f"list_sum({b.each(2, b.bars, term)})")


# -- single bars ------------------------------------------------------------------


def bars(n: int, *names: str):
    def register(f):
        def run(b, p):
            b.bars = n
            return f(p)

        return formula(*names)(run)

    return register


bars(1, "typical_price")(lambda p: "(h[1] + l[1] + c[1]) / 3")
bars(1, "median_price")(lambda p: "(h[1] + l[1]) / 2")
bars(1, "weighted_close")(lambda p: "(h[1] + l[1] + 2 * c[1]) / 4")
bars(1, "average_price")(lambda p: "(o[1] + h[1] + l[1] + c[1]) / 4")
bars(1, "bar_range")(lambda p: "h[1] - l[1]")
bars(1, "bar_range_pct")(lambda p: ratio("100 * (h[1] - l[1])", "c[1]"))
bars(2, "gap")(lambda p: ratio("100 * (o[2] - c[1])", "c[1]"))
bars(1, "body_ratio")(lambda p: ratio("abs(c[1] - o[1])", "(h[1] - l[1])"))
bars(1, "close_location")(lambda p: ratio("(c[1] - l[1]) - (h[1] - c[1])", "(h[1] - l[1])"))


@bars(2, "pivot")
def _(p):
    m = "((h[1] + l[1] + c[1]) / 3)"
    return choose(p, pp=m, r1=f"2 * {m} - l[1]", s1=f"2 * {m} - h[1]", r2=f"{m} + h[1] - l[1]", s2=f"{m} - h[1] + l[1]", r3=f"h[1] + 2 * ({m} - l[1])", s3=f"l[1] - 2 * (h[1] - {m})")


@formula("heikin_ashi")
def _(b, p):
    b.bars = max(p.lookback, 2)
    mean = b.each(b.bars - p.lookback + 1, b.bars, "(o[i] + h[i] + l[i] + c[i]) / 4")
    first = f"(o[-{p.lookback}] + c[-{p.lookback}]) / 2"
    opened = b.let(f"list_reduce(list_prepend({first}, {mean}[1:{p.lookback - 1}]), lambda a, e: (a + e) / 2)")
    return choose(p, close=f"{mean}[-1]", open=opened, high=f"greatest(h[-1], {opened}, {mean}[-1])", low=f"least(l[-1], {opened}, {mean}[-1])")


def primitive_sql(name: str, params: dict, source: str, digits: int | None = 6) -> str:
    """(symbol, bar_index, value) of a primitive at every bar of a source (a parenthesised query), rounded if asked."""
    past = Past(params | {"name": name})
    value = FORMULAS[name](past, past.p)
    return past.sql(value, source, digits)
