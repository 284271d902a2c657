"""DuckDB SQL of expression documents, written from the definitions of the nodes.

Nothing here is shared with the compiler in ``operators.nodes``. Every node is a
table (symbol, i, v) with a row for each bar i; a node joins the tables of its
operands, and what looks back joins the bars that it reads and gathers them in a
list. No window is used.
"""

from __future__ import annotations

import inspect

from causeway.functions import registry
from causeway.plans import oracles

_TIMES = {"weekday": "isodow(ts_close) - 1", "hour": "hour(ts_close)", "minute": "minute(ts_close)", "day": "day(ts_close)", "month": "month(ts_close)", "day_of_year": "dayofyear(ts_close)", "year": "year(ts_close)"}
_MATH = {
    "abs": "abs(x0)", "neg": "-x0", "sign": "sign(x0)", "log": "CASE WHEN x0 > 0 THEN ln(x0) END", "exp": "CASE WHEN x0 <= 700 THEN exp(x0) END", "sqrt": "CASE WHEN x0 >= 0 THEN sqrt(x0) END",
    "inverse": "CASE WHEN x0 <> 0 THEN 1 / x0 END", "floor": "floor(x0)", "ceil": "ceil(x0)",
}


class Tables:
    """The tables of a document, one after another. ``bars`` has the columns of a session index; ``cal`` and ``ser`` may stand before."""

    def __init__(self, bars: str):
        self.bars, self.made = bars, [f"b AS (SELECT *, bar_index AS i FROM {bars})"]

    def add(self, select: str) -> str:
        name = f"n{len(self.made)}"
        self.made.append(f"{name} AS ({select})")
        return name

    def rowwise(self, value: str, *operands: dict) -> str:
        """``value`` over the operands' values, called x0, x1 and so on."""
        tables = [self.of(x) for x in operands]
        joins = "".join(f" JOIN (SELECT symbol, i, v AS x{k} FROM {t}) USING (symbol, i)" for k, t in enumerate(tables))
        return self.add(f"SELECT symbol, i, CAST({value} AS DOUBLE) AS v FROM b{joins}")

    def back(self, table: str, k: int, column: str = "v") -> str:
        return self.add(f"SELECT b.symbol, b.i, t.{column} AS v FROM b LEFT JOIN {table} t ON t.symbol = b.symbol AND t.i = b.i - {k}")

    def gathered(self, table: str, on: str) -> str:
        """For each bar the list ``vs`` of the values of the bars (p) that it reads, oldest first."""
        return f"(SELECT b.symbol, b.i, list(t.v ORDER BY p.i) FILTER (WHERE p.i IS NOT NULL) AS vs, list(p.i ORDER BY p.i) FILTER (WHERE p.i IS NOT NULL) AS places FROM b LEFT JOIN b p ON p.symbol = b.symbol AND {on} LEFT JOIN {table} t ON t.symbol = p.symbol AND t.i = p.i GROUP BY b.symbol, b.i)"

    def of(self, spec: dict) -> str:
        kind = spec["type"].partition("@")[0]
        return getattr(self, f"_{kind}")(**{k: v for k, v in spec.items() if k not in ("type", "version", "note")})

    # -- leaves --

    def _constant(self, value):
        return self.rowwise(f"{float(value)!r}")

    def _primitive(self, ref, params=None):
        p = registry.get(ref)
        full = {k: v for k, v in p.defaults.items() if v is not inspect.Parameter.empty} | (params or {})
        return self.add(f"SELECT symbol, bar_index AS i, value AS v FROM ({oracles.primitive_sql(p.name, full, self.bars, None)})")

    def _price(self, field="close", lag=0):
        return self.back("b", lag, field)

    def _time(self, field="hour"):
        return self.rowwise(_TIMES[field])

    def _peer(self, symbol, inner):
        return self.add(f"SELECT b.symbol, b.i, t.v FROM b LEFT JOIN b o ON o.symbol = '{symbol}' AND o.ts_close = b.ts_close LEFT JOIN {self.of(inner)} t ON t.symbol = o.symbol AND t.i = o.i")

    def _event(self, name, field="minutes_since"):
        past, ahead = "(SELECT max(moment) FROM cal WHERE moment <= ts_close)", "(SELECT min(moment) FROM cal WHERE moment > ts_close)"
        return self.rowwise({"minutes_since": f"(epoch_us(ts_close) - epoch_us({past})) / 60e6", "minutes_until": f"(epoch_us({ahead}) - epoch_us(ts_close)) / 60e6", "is_now": f"CASE WHEN {past} = ts_close THEN 1 ELSE 0 END"}[field])

    def _exogenous(self, name, field="value"):
        known = "WHERE moment + to_minutes(lag) <= ts_close"
        return self.rowwise(f"(SELECT arg_max(value, moment) FROM ser {known})" if field == "value" else f"(epoch_us(ts_close) - epoch_us((SELECT max(moment) FROM ser {known}))) / 60e6")

    def _session(self, field="bar_index", lag=0):
        own = {"bar_index": "bar_in_session", "minutes_from_open": "minutes_from_open", "is_first": "CASE WHEN is_first THEN 1 ELSE 0 END", "is_last": "CASE WHEN is_last THEN 1 ELSE 0 END"}
        if field in own:
            return self.rowwise(own[field])
        value = {"open": "arg_min(open, i)", "high": "max(high)", "low": "min(low)", "close": "arg_max(close, i)", "volume": "sum(volume)"}[field]
        whole = self.add(f"SELECT symbol, session_number AS s, {value} AS v FROM b GROUP BY 1, 2")
        return self.add(f"SELECT b.symbol, b.i, t.v FROM b LEFT JOIN {whole} t ON t.symbol = b.symbol AND t.s = b.session_number - {lag}")

    # -- operators --

    def _compare(self, op, left, right):
        return self.rowwise(f"x0 {({'==': '=', '!=': '<>'}).get(op, op)} x1", left, right)

    def _arith(self, op, left, right):
        value = {"/": "CASE WHEN x1 <> 0 THEN x0 / x1 END", "%": "CASE WHEN x1 <> 0 THEN x0 - x1 * floor(x0 / x1) END"}.get(op, f"x0 {op} x1")
        return self.rowwise(value, left, right)

    def _joined(self, word, operands):
        names = [f"x{k}" for k in range(len(operands))]
        return self.rowwise(f"CASE WHEN {' + '.join(names)} IS NOT NULL THEN {f' {word} '.join(f'{n} <> 0' for n in names)} END", *operands)

    def _all_of(self, operands):
        return self._joined("AND", operands)

    def _any_of(self, operands):
        return self._joined("OR", operands)

    def _not(self, inner):
        return self.rowwise("x0 = 0", inner)

    def _crossing(self, fast, slow, now, before):
        gap = self.rowwise("x0 - x1", fast, slow)
        earlier = self.back(gap, 1)
        return self.add(f"SELECT symbol, i, CASE WHEN g.v IS NOT NULL AND e.v IS NOT NULL THEN CASE WHEN e.v {before} 0 AND g.v {now} 0 THEN 1.0 ELSE 0.0 END END AS v FROM {gap} g JOIN {earlier} e USING (symbol, i)")

    def _crosses_above(self, fast, slow):
        return self._crossing(fast, slow, ">", "<=")

    def _crosses_below(self, fast, slow):
        return self._crossing(fast, slow, "<", ">=")

    def _if_then_else(self, condition, then, otherwise):
        return self.rowwise("CASE WHEN x0 IS NULL THEN NULL WHEN x0 <> 0 THEN x1 ELSE x2 END", condition, then, otherwise)

    def _math(self, op, inner):
        return self.rowwise(_MATH[op], inner)

    def _least(self, f, operands):
        names = [f"x{k}" for k in range(len(operands))]
        return self.rowwise(f"CASE WHEN {' + '.join(names)} IS NOT NULL THEN {f}([{', '.join(names)}]) END", *operands)

    def _min_of(self, operands):
        return self._least("list_min", operands)

    def _max_of(self, operands):
        return self._least("list_max", operands)

    # -- what looks back --

    def _lag(self, bars, inner):
        return self.back(self.of(inner), bars)

    def _rolling(self, stat, window, inner, stride=1, across=None):
        n, m = window, (window + 1) / 2
        on = f"p.bar_in_session = b.bar_in_session AND p.session_number BETWEEN b.session_number - {n - 1} AND b.session_number" if across else f"p.i BETWEEN b.i - {(n - 1) * stride} AND b.i AND (b.i - p.i) % {stride} = 0"
        value = {
            "mean": "list_avg(vs)", "sum": "list_sum(vs)", "min": "list_min(vs)", "max": "list_max(vs)", "median": "list_median(vs)", "var": "list_var_samp(vs)", "stdev": "list_stddev_samp(vs)",
            "zscore": "CASE WHEN list_stddev_samp(vs) > 1e-12 THEN (vs[-1] - list_avg(vs)) / list_stddev_samp(vs) END", "ema": f"list_reduce(vs, lambda a, e: a + {2 / (n + 1)!r} * (e - a))",
            "rank": f"len(list_filter(vs, lambda e: e <= vs[-1])) / {float(n)}", "count_true": "len(list_filter(vs, lambda e: e > 0))",
            "slope": f"list_sum(list_transform(range(1, {n + 1}), lambda k: (k - {m}) * vs[k])) / {sum((k - m) ** 2 for k in range(1, n + 1)) or 1.0}",
        }[stat]
        return self.add(f"SELECT symbol, i, CASE WHEN len(list_filter(vs, lambda e: e IS NOT NULL)) = {n} THEN CAST({value} AS DOUBLE) END AS v FROM {self.gathered(self.of(inner), on)}")

    def _session_lag(self, sessions, inner):
        return self.add(f"SELECT b.symbol, b.i, t.v FROM b LEFT JOIN b p ON p.symbol = b.symbol AND p.session_number = b.session_number - {sessions} AND p.bar_in_session = b.bar_in_session LEFT JOIN {self.of(inner)} t ON t.symbol = p.symbol AND t.i = p.i")

    def _found(self, table, lookback):
        """(symbol, i, hit): the last bar of the past at which a condition held, if nothing undefined is newer."""
        seen = self.gathered(table, f"p.i BETWEEN b.i - {lookback - 1} AND b.i")
        newest = "list_max(list_filter(range(1, len(vs) + 1), lambda k: vs[k] IS NULL OR vs[k] <> 0))"
        return self.add(f"SELECT symbol, i, CASE WHEN vs[newest] IS NOT NULL THEN places[newest] END AS hit FROM (SELECT *, {newest} AS newest FROM {seen})")

    def _bars_since(self, lookback, inner):
        return self.add(f"SELECT symbol, i, CAST(i - hit AS DOUBLE) AS v FROM {self._found(self.of(inner), lookback)}")

    def _value_when(self, lookback, when, inner):
        found = self._found(self.of(when), lookback)
        return self.add(f"SELECT f.symbol, f.i, t.v FROM {found} f LEFT JOIN {self.of(inner)} t ON t.symbol = f.symbol AND t.i = f.hit")

    def _cumulative(self, stat, inner, sessions=1, mask=None):
        kept = self.rowwise("CASE WHEN x1 > 0 THEN x0 END", inner, mask) if mask else self.of(inner)
        holes = self.rowwise("CASE WHEN x0 IS NULL OR x1 IS NULL THEN 1 ELSE 0 END", inner, mask) if mask else self.rowwise("CASE WHEN x0 IS NULL THEN 1 ELSE 0 END", inner)
        on = f"p.session_number BETWEEN b.session_number - {sessions - 1} AND b.session_number AND p.i <= b.i"
        old = self.add(f"SELECT b.symbol, b.i, count(p.i) AS there FROM b LEFT JOIN b p ON p.symbol = b.symbol AND p.session_number = b.session_number - {sessions - 1} AND p.bar_in_session = b.bar_in_session GROUP BY 1, 2")
        value = {"sum": "list_sum(ks)", "mean": "list_avg(ks)", "min": "list_min(ks)", "max": "list_max(ks)", "first": "ks[1]", "last": "ks[-1]", "count_true": "CASE WHEN len(ks) > 0 THEN len(list_filter(ks, lambda e: e > 0)) END"}[stat]
        return self.add(
            f"SELECT symbol, i, CASE WHEN list_sum(h.vs) = 0 AND there > 0 THEN CAST({value} AS DOUBLE) END AS v FROM (SELECT symbol, i, list_filter(vs, lambda e: e IS NOT NULL) AS ks FROM {self.gathered(kept, on)}) JOIN {self.gathered(holes, on)} h USING (symbol, i) JOIN {old} USING (symbol, i)"
        )


def node_sql(spec: dict, bars: str, before: str = "") -> str:
    """(symbol, bar_index, value) of a document over bars (a parenthesised query); ``before`` has further tables."""
    tables = Tables(bars)
    last = tables.of(spec)
    return f"WITH {before}{', '.join(tables.made)} SELECT symbol, i AS bar_index, round(CAST(v AS DOUBLE), 6) + 0.0 AS value FROM {last}"
