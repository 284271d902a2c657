"""The JSON expression language: 27 node types compiled to columns of a graph.

A signal is a number or undefined; truth is 1, falsehood 0. An undefined operand
makes any operator undefined, "and" and "or" included. No node can look ahead:
lags are whole numbers from 0, and every frame ends at the current bar.

Columns that a source must have: the bars' own; for ``session``, ``session_lag``,
``cumulative`` and rolling across sessions those of ``sessions.index``; for
``event`` and ``exogenous`` those of ``asof``; for ``position`` and ``account``
``position_<field>`` and ``account_<field>``, which the simulation provides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from causeway.functions import registry
from causeway.functions.common import slope
from causeway.operators.graph import Graph

POSITION = ("quantity", "direction", "bars_held", "entry_price", "high_since_entry", "low_since_entry", "closed_trade", "closed_pnl")
ACCOUNT = ("equity", "cash", "peak_equity", "initial_equity", "drawdown", "total_return")
TIMES = {"weekday": None, "hour": "hour", "minute": "minute", "day": "day", "month": "month", "day_of_year": "dayofyear", "year": "year"}
SESSION_VALUES = {"open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume"}
STATS = ("mean", "stdev", "min", "max", "sum", "zscore", "ema", "median", "var", "slope", "rank", "count_true")


class SpecError(ValueError):
    """A document that is not a valid expression."""


class LookAhead(SpecError):
    """A lag below zero, or a value that is not known yet."""


_NODES: dict[str, tuple[Callable[..., str], dict[str, object]]] = {}
REQUIRED = object()


def node(kind: str, **fields: object):
    def register(build):
        _NODES[kind] = (build, fields)
        return build

    return register


def kinds() -> list[str]:
    return sorted(_NODES)


def compile_node(g: Graph, spec: dict) -> str:
    """The column of a spec. Unknown types and fields are refused."""
    if not isinstance(spec, dict) or "type" not in spec:
        raise SpecError(f"not a node: {spec!r}")
    kind = str(spec["type"]).partition("@")[0]
    if kind not in _NODES:
        raise SpecError(f"unknown node {spec['type']!r}")
    build, fields = _NODES[kind]
    given = {k: v for k, v in spec.items() if k not in ("type", "version", "note")}
    if unknown := given.keys() - fields.keys():
        raise SpecError(f"{kind} takes no {', '.join(sorted(unknown))}")
    values = {k: given.get(k, d) for k, d in fields.items()}
    if missing := [k for k, v in values.items() if v is REQUIRED]:
        raise SpecError(f"{kind} needs {', '.join(missing)}")
    return build(g, **values)


MOST_NODES = 50_000


def expand(spec, definitions: dict, _open: tuple[str, ...] = (), _count: list[int] | None = None):
    """Replaces {"$ref": name} by its definition; cycles, unknown names and vast results are refused."""
    _count = [0] if _count is None else _count
    if isinstance(spec, dict):
        _count[0] += 1
        if _count[0] > MOST_NODES:
            raise SpecError(f"more than {MOST_NODES} nodes")
        if "$ref" in spec:
            name = spec["$ref"]
            if name in _open:
                raise SpecError(f"definitions refer to each other: {' > '.join((*_open, name))}")
            if name not in definitions:
                raise SpecError(f"unknown definition {name!r}")
            return expand(definitions[name], definitions, (*_open, name), _count)
        return {k: expand(v, definitions, _open, _count) for k, v in spec.items()}
    return [expand(x, definitions, _open, _count) for x in spec] if isinstance(spec, list) else spec


def _whole(name: str, value, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise SpecError(f"{name} must be a whole number, not {value!r}")
    if value < 0:
        raise LookAhead(f"{name} = {value} would look ahead")
    if value < least:
        raise SpecError(f"{name} must be at least {least}, not {value}")
    return value


def _one_of(name: str, value, allowed) -> str:
    if value not in allowed:
        raise SpecError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def _finite(g: Graph, x: str) -> str:
    return g.let(f"CASE WHEN abs({x}) <= 1.7976931348623157E308 THEN {x} END")


def _defined(*xs: str) -> str:
    return " AND ".join(f"{x} IS NOT NULL" for x in xs)


# -- leaves -------------------------------------------------------------------


@node("constant", value=REQUIRED)
def _constant(g, value):
    return g.let(f"CAST({float(value)!r} AS DOUBLE)")


@node("primitive", ref=REQUIRED, params=None)
def _primitive(g, ref, params):
    return registry.get(ref).column(g, **(params or {}))


@node("price", field="close", lag=0)
def _price(g, field, lag):
    _one_of("field", field, registry.FIELDS)
    return g.let(g.lag(field, _whole("lag", lag, 0)))


@node("position", field="quantity")
def _position(g, field):
    return g.let(f"position_{_one_of('field', field, POSITION)}")


@node("account", field="equity")
def _account(g, field):
    return g.let(f"account_{_one_of('field', field, ACCOUNT)}")


@node("time", field="hour")
def _time(g, field):
    _one_of("field", field, TIMES)
    if field == "weekday":
        return g.let("CAST(weekday(ts_close) AS DOUBLE)" if g.spark else "CAST(isodow(ts_close) - 1 AS DOUBLE)")
    return g.let(f"CAST({TIMES[field]}(ts_close) AS DOUBLE)")


@node("peer", symbol=REQUIRED, inner=REQUIRED)
def _peer(g, symbol, inner):
    """The other instrument at the same instant; undefined where it has no bar."""
    x = compile_node(g, inner)
    name = str(symbol).replace("'", "''")
    return g.let(f"max(CASE WHEN symbol = '{name}' THEN {x} END) OVER (PARTITION BY ts_close)")


def _minutes(g, later, earlier):
    return f"(unix_micros({later}) - unix_micros({earlier})) / 60000000D" if g.spark else f"date_diff('microsecond', {earlier}, {later}) / 60000000.0"


@node("event", name=REQUIRED, field="minutes_since")
def _event(g, name, field):
    _one_of("field", field, ("minutes_since", "minutes_until", "is_now"))
    if field == "minutes_until":
        return g.let(_minutes(g, f"event_{name}_next", "ts_close"))
    if field == "is_now":
        return g.let(f"CASE WHEN event_{name}_last = ts_close THEN 1E0 ELSE 0E0 END")
    return g.let(_minutes(g, "ts_close", f"event_{name}_last"))


@node("exogenous", name=REQUIRED, field="value")
def _exogenous(g, name, field):
    _one_of("field", field, ("value", "age_minutes"))
    return _finite(g, f"exogenous_{name}_value") if field == "value" else g.let(_minutes(g, "ts_close", f"exogenous_{name}_at"))


@node("session", field="bar_index", lag=0)
def _session(g, field, lag):
    lag = _whole("lag", lag, 0)
    if field in ("bar_index", "minutes_from_open", "is_first", "is_last"):
        if lag:
            raise SpecError(f"{field} has no lag")
        x = {"bar_index": "bar_in_session", "minutes_from_open": "minutes_from_open"}.get(field)
        return g.let(f"CAST({x} AS DOUBLE)" if x else f"CASE WHEN {field} THEN 1E0 ELSE 0E0 END")
    _one_of("field", field, SESSION_VALUES)
    if lag == 0 and field != "open":
        raise LookAhead(f"the session's {field} is not known before it ends")
    own = "(PARTITION BY symbol, session_number)" if field in ("high", "low", "volume") else "(PARTITION BY symbol, session_number ORDER BY ts_close ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    if field == "open":
        own = "(PARTITION BY symbol, session_number ORDER BY ts_close ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    call = {"open": "first_value(open)", "high": "max(high)", "low": "min(low)", "close": "last_value(close)", "volume": "sum(volume)"}[field]
    x = g.let(f"{call} OVER {own}")
    return _sessions_back(g, x, lag) if lag else x


def _sessions_back(g, x, lag, function="max", to=None):
    """A value of whole sessions, ``lag`` to ``to`` sessions ago."""
    return g.let(f"{function}({x}) OVER (PARTITION BY symbol ORDER BY session_number RANGE BETWEEN {lag} PRECEDING AND {lag if to is None else to} PRECEDING)")


# -- operators ----------------------------------------------------------------


@node("compare", op=REQUIRED, left=REQUIRED, right=REQUIRED)
def _compare(g, op, left, right):
    _one_of("op", op, (">", ">=", "<", "<=", "==", "!="))
    a, b = compile_node(g, left), compile_node(g, right)
    sign = {"==": "=", "!=": "<>"}.get(op, op)
    return g.let(f"CASE WHEN {_defined(a, b)} THEN CASE WHEN {a} {sign} {b} THEN 1E0 ELSE 0E0 END END")


@node("arith", op=REQUIRED, left=REQUIRED, right=REQUIRED)
def _arith(g, op, left, right):
    _one_of("op", op, ("+", "-", "*", "/", "%"))
    a, b = compile_node(g, left), compile_node(g, right)
    if op in "+-*":
        return _finite(g, g.let(f"{a} {op} {b}"))
    if op == "/":
        return _finite(g, g.div(a, b))
    rest = g.let(f"CASE WHEN {b} <> 0 THEN {a} % {b} END")
    return g.let(f"CASE WHEN {rest} <> 0 AND ({rest} < 0) <> ({b} < 0) THEN {rest} + {b} ELSE {rest} END")


def _all(g, operands):
    if not isinstance(operands, list) or not operands:
        raise SpecError("operands must be a list of at least one node")
    return [compile_node(g, x) for x in operands]


@node("all_of", operands=REQUIRED)
def _all_of(g, operands):
    xs = _all(g, operands)
    return g.let(f"CASE WHEN {_defined(*xs)} THEN CASE WHEN {' AND '.join(f'{x} <> 0' for x in xs)} THEN 1E0 ELSE 0E0 END END")


@node("any_of", operands=REQUIRED)
def _any_of(g, operands):
    xs = _all(g, operands)
    return g.let(f"CASE WHEN {_defined(*xs)} THEN CASE WHEN {' OR '.join(f'{x} <> 0' for x in xs)} THEN 1E0 ELSE 0E0 END END")


@node("not", inner=REQUIRED)
def _not(g, inner):
    x = compile_node(g, inner)
    return g.let(f"CASE WHEN {_defined(x)} THEN CASE WHEN {x} = 0 THEN 1E0 ELSE 0E0 END END")


def _cross(g, fast, slow, now, before):
    a, b = compile_node(g, fast), compile_node(g, slow)
    p, q = g.lag(a), g.lag(b)
    return g.let(f"CASE WHEN {_defined(a, b, p, q)} THEN CASE WHEN {p} {before} {q} AND {a} {now} {b} THEN 1E0 ELSE 0E0 END END")


@node("crosses_above", fast=REQUIRED, slow=REQUIRED)
def _crosses_above(g, fast, slow):
    return _cross(g, fast, slow, ">", "<=")


@node("crosses_below", fast=REQUIRED, slow=REQUIRED)
def _crosses_below(g, fast, slow):
    return _cross(g, fast, slow, "<", ">=")


@node("if_then_else", condition=REQUIRED, then=REQUIRED, otherwise=REQUIRED)
def _if(g, condition, then, otherwise):
    c, a, b = (compile_node(g, x) for x in (condition, then, otherwise))
    return g.let(f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} <> 0 THEN {a} ELSE {b} END")


@node("math", op=REQUIRED, inner=REQUIRED)
def _math(g, op, inner):
    x = compile_node(g, inner)
    forms = {
        "abs": f"abs({x})", "neg": f"-{x}", "sign": f"CAST(sign({x}) AS DOUBLE)", "log": f"CASE WHEN {x} > 0 THEN ln({x}) END",
        "exp": f"CASE WHEN {x} <= 700 THEN exp({x}) END", "sqrt": f"CASE WHEN {x} >= 0 THEN sqrt({x}) END",
        "inverse": f"CASE WHEN {x} <> 0 THEN 1E0 / {x} END", "floor": f"CAST(floor({x}) AS DOUBLE)", "ceil": f"CAST(ceil({x}) AS DOUBLE)",
    }
    return _finite(g, g.let(forms[_one_of("op", op, tuple(forms))]))


@node("min_of", operands=REQUIRED)
def _min_of(g, operands):
    xs = _all(g, operands)
    return xs[0] if len(xs) == 1 else g.let(f"CASE WHEN {_defined(*xs)} THEN least({', '.join(xs)}) END")


@node("max_of", operands=REQUIRED)
def _max_of(g, operands):
    xs = _all(g, operands)
    return xs[0] if len(xs) == 1 else g.let(f"CASE WHEN {_defined(*xs)} THEN greatest({', '.join(xs)}) END")


# -- windows ------------------------------------------------------------------


@node("lag", bars=REQUIRED, inner=REQUIRED)
def _lag(g, bars, inner):
    return g.lag(compile_node(g, inner), _whole("bars", bars, 1))


@node("rolling", stat=REQUIRED, window=REQUIRED, inner=REQUIRED, stride=1, across=None)
def _rolling(g, stat, window, inner, stride, across):
    _one_of("stat", stat, STATS)
    n, stride = _whole("window", window, 1), _whole("stride", stride, 1)
    if across not in (None, "sessions"):
        raise SpecError("across can only be sessions")
    if across and stride != 1:
        raise SpecError("across sessions takes no stride")
    if n < 2 and stat in ("stdev", "var", "zscore", "slope"):
        raise SpecError(f"{stat} needs a window of at least 2")
    x = compile_node(g, inner)
    if across == "sessions":
        # The same place in each of the last n sessions; all of them must have it.
        past = [x] + [g.let(f"max({x}) OVER (PARTITION BY symbol, bar_in_session ORDER BY session_number RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)") for k in range(1, n)]
        return _over_values(g, stat, past[::-1], x)
    if stride > 1:
        return _over_values(g, stat, [g.lag(x, k * stride) for k in range(n)][::-1], x)
    full = f"{g.agg('count', x, n)} = {n}"
    if stat == "ema":
        y = g.fir(x, _ema_weights(n))
    elif stat == "slope":
        y = slope(g, x, n)
    elif stat == "rank":
        y = g.let(f"{g.count_if(g.list(x, n), lambda v: f'{v} <= {x}')} / {float(n)}")
    elif stat == "zscore":
        s = g.std(x, n)
        y = g.let(f"CASE WHEN {s} > 1E-12 THEN ({x} - {g.avg(x, n)}) / {s} END")
    elif stat == "count_true":
        y = g.sum(g.let(f"CASE WHEN {x} > 0 THEN 1E0 ELSE 0E0 END"), n)
    elif stat == "median":
        y = g.quantile(x, n, 0.5)
    else:
        y = g.agg({"mean": "avg", "stdev": "stddev_samp", "var": "var_samp"}.get(stat, stat), x, n)
    return g.let(f"CASE WHEN {full} THEN {y} END")


def _ema_weights(n: int) -> list[float]:
    a = 2.0 / (n + 1)
    w = [a * (1 - a) ** (n - 1 - i) for i in range(n)]
    w[0] = (1 - a) ** (n - 1)
    return w


def _over_values(g, stat, past, x):
    """A statistic of some columns, oldest first; all must be defined."""
    n = len(past)
    xs = g.let(f"array({', '.join(past)})" if g.spark else f"[{', '.join(past)}]")
    total = g.total(xs)
    mean = g.let(f"{total} / {n}")
    spread = lambda: g.let(f"{g.total(g.mapped(xs, lambda v, i: f'power({v} - {mean}, 2)'))} / {max(n - 1, 1)}")
    forms = {
        "mean": lambda: mean, "sum": lambda: total, "min": lambda: f"{'array_min' if g.spark else 'list_min'}({xs})", "max": lambda: f"{'array_max' if g.spark else 'list_max'}({xs})",
        "var": spread, "stdev": lambda: f"sqrt({spread()})", "zscore": lambda: f"CASE WHEN {spread()} > 1E-24 THEN ({x} - {mean}) / sqrt({spread()}) END",
        "ema": lambda: g.weighed(xs, _ema_weights(n)), "rank": lambda: f"{g.count_if(xs, lambda v: f'{v} <= {x}')} / {float(n)}",
        "count_true": lambda: f"CAST({g.count_if(xs, lambda v: f'{v} > 0')} AS DOUBLE)",
        "median": lambda: _middle(g, xs, n), "slope": lambda: g.weighed(xs, _slope_weights(n)),
    }
    return g.let(f"CASE WHEN {total} IS NOT NULL THEN {forms[stat]()} END")


def _middle(g, xs, n):
    s = g.let(f"{'array_sort' if g.spark else 'list_sort'}({xs})")
    return g.at(s, str(n // 2 + 1)) if n % 2 else f"({g.at(s, str(n // 2))} + {g.at(s, str(n // 2 + 1))}) / 2.0"


def _slope_weights(n):
    i = np.arange(n) - (n - 1) / 2
    return i / max(float(i @ i), 1e-300)


@node("session_lag", sessions=REQUIRED, inner=REQUIRED)
def _session_lag(g, sessions, inner):
    x, k = compile_node(g, inner), _whole("sessions", sessions, 1)
    return g.let(f"max({x}) OVER (PARTITION BY symbol, bar_in_session ORDER BY session_number RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)")


def _last_true(g, c, n):
    """(row number, that of the last true bar if nothing undefined is newer)."""
    rn = g.row_number()
    hit = g.max(g.let(f"CASE WHEN {c} <> 0 THEN {rn} END"), n)
    hole = g.max(g.let(f"CASE WHEN {c} IS NULL THEN {rn} END"), n)
    return rn, g.let(f"CASE WHEN {hole} IS NULL OR {hole} < {hit} THEN {hit} END")


@node("bars_since", lookback=REQUIRED, inner=REQUIRED)
def _bars_since(g, lookback, inner):
    rn, hit = _last_true(g, compile_node(g, inner), _whole("lookback", lookback, 1))
    return g.let(f"{rn} - {hit}")


@node("value_when", lookback=REQUIRED, when=REQUIRED, inner=REQUIRED)
def _value_when(g, lookback, when, inner):
    n, c, x = _whole("lookback", lookback, 1), compile_node(g, when), compile_node(g, inner)
    rn, hit = _last_true(g, c, n)
    order = g.let(f"CASE WHEN {c} <> 0 THEN {rn} END")
    y = g.let(f"{'max_by' if g.spark else 'arg_max_null'}({x}, {order}) OVER {g.over(n)}", n - 1)
    return g.let(f"CASE WHEN {hit} IS NOT NULL THEN {y} END")


@node("cumulative", stat=REQUIRED, inner=REQUIRED, sessions=1, mask=None)
def _cumulative(g, stat, inner, sessions, mask):
    """From the opening of the session, or of the one ``sessions - 1`` before, to now."""
    _one_of("stat", stat, ("sum", "mean", "min", "max", "first", "last", "count_true"))
    n, x = _whole("sessions", sessions, 1), compile_node(g, inner)
    m = compile_node(g, mask) if mask is not None else None
    own = "(PARTITION BY symbol, session_number ORDER BY ts_close ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def so_far(function: str, y: str) -> str:
        """Over the current session up to now and, for several, over whole earlier ones."""
        here = g.let(f"{function}({y}) OVER {own}")
        if n == 1:
            return here
        before = _sessions_back(g, y, n - 1, function, 1)
        if function == "sum":
            return g.let(f"CASE WHEN {here} IS NULL THEN {before} WHEN {before} IS NULL THEN {here} ELSE {here} + {before} END")
        return g.let(f"CASE WHEN {here} IS NULL THEN {before} WHEN {before} IS NULL THEN {here} ELSE {'least' if function == 'min' else 'greatest'}({here}, {before}) END")

    holes = so_far("sum", g.let(f"CASE WHEN {x} IS NULL{f' OR {m} IS NULL' if m else ''} THEN 1E0 ELSE 0E0 END"))
    kept = g.let(f"CASE WHEN {m} > 0 THEN {x} END") if m else x
    rn = g.row_number()
    if stat in ("sum", "min", "max"):
        y = so_far(stat, kept)
    elif stat == "mean":
        y = g.div(so_far("sum", kept), so_far("sum", g.let(f"CASE WHEN {kept} IS NOT NULL THEN 1E0 ELSE 0E0 END")))
    elif stat == "count_true":
        y = so_far("sum", g.let(f"CASE WHEN {kept} > 0 THEN 1E0 WHEN {kept} IS NOT NULL THEN 0E0 END"))
    else:
        # The first or last kept bar of the frame by its number; its value travels with it.
        pair = g.let(f"CASE WHEN {kept} IS NOT NULL THEN " + (f"named_struct('rn', {rn}, 'v', {kept})" if g.spark else f"{{'rn': {rn}, 'v': {kept}}}") + " END")
        y = g.let(f"{so_far('min' if stat == 'first' else 'max', pair)}.v")
    short = ""
    if n > 1:
        # The oldest session of the frame must be there and have a bar of this rank.
        there = g.let(f"max(1E0) OVER (PARTITION BY symbol, bar_in_session ORDER BY session_number RANGE BETWEEN {n - 1} PRECEDING AND {n - 1} PRECEDING)")
        short = f" AND {there} IS NOT NULL"
    return g.let(f"CASE WHEN {holes} = 0{short} THEN {y} END")
