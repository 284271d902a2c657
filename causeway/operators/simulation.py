"""Order, fill and portfolio simulation: a fold over the bars of each run.

Signals are computed before, as columns; only what depends on the path runs in
the fold. Runs are dealt to tasks by ``run_id`` and their bars stream through in
order, so a task holds a run's open positions and orders and no more of its
history than one instant. Equity, fills, trades and counts come out of one pass.
The order within a bar is: protections, due orders, mark, then the rules at the
close, whose orders are due ``lag_bars`` bars later at the earliest. Nothing
reads a later bar.
"""

from __future__ import annotations

import functools
import itertools
import math
import statistics
from collections import Counter, defaultdict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("entry_long", "exit_long", "entry_short", "exit_short", "stop_loss", "take_profit", "entry_limit", "entry_stop", "exit_quantity")
#: Signed share of equity, in notional, that an instrument is to be brought to.
TARGET = "target_share"


@dataclass(frozen=True)
class Costs:
    """Fees per contract and side or flat per fill; slippage in ticks or basis points."""

    fee_per_contract: float = 0.0
    fee_flat: float = 0.0
    slippage_ticks: float = 0.0
    slippage_bps: float = 0.0


@dataclass(frozen=True)
class Run:
    """One instrument's settings.

    ``sizing``: none and fixed take ``quantity``; equity_fraction a share of
    equity in notional; per_equity the column ``size`` times equity; column the
    column ``size``. All are truncated, and undefined is no order.
    """

    initial_cash: float
    quantity: int = 1
    multiplier: float = 1.0
    tick_size: float = 0.01
    lag_bars: int = 1
    pessimistic: bool = True
    pyramiding: bool = False
    initial_margin: float = 0.0
    #: Share of the initial margin that is asked for, for positions that do not last over night.
    margin_ratio: float = 1.0
    #: Otherwise an entry that the equity does not cover is filled all the same, and counted.
    reject_on_margin: bool = True
    max_fill_gap_seconds: float | None = None
    max_gross_contracts: int | None = None
    liquidate_at_end: bool = False
    sizing: str = "none"
    fraction: float = 0.0
    max_contracts: int | None = None
    category: str | None = None
    costs: Costs = field(default_factory=Costs)

    def __post_init__(self):
        if self.initial_cash <= 0:
            raise ValueError("initial_cash must be positive")
        if not 0 < self.margin_ratio <= 1:
            raise ValueError("margin_ratio must lie in (0, 1]")
        if self.lag_bars < 1:
            raise ValueError("lag_bars must be at least 1: an order cannot fill on the bar that decides it")
        if self.sizing not in ("none", "fixed", "equity_fraction", "per_equity", "column"):
            raise ValueError(f"unknown sizing {self.sizing!r}")


def trigger(kind: str, side: int, price: float | None, bar: dict) -> float | None:
    """Where an order would fill on a bar; None if it is not touched."""
    if kind == "market":
        return bar["open"]
    if kind == "limit":
        touched = bar["low"] <= price if side > 0 else bar["high"] >= price
        return (min if side > 0 else max)(price, bar["open"]) if touched else None
    touched = bar["high"] >= price if side > 0 else bar["low"] <= price
    return (max if side > 0 else min)(price, bar["open"]) if touched else None


@dataclass(frozen=True)
class Limits:
    """Caps on the portfolio; an order is refused if it ends above one and worse than before."""

    max_gross_exposure: float | None = None
    max_net_exposure: float | None = None
    max_positions: int | None = None
    max_per_category: int | None = None


class Book:
    """One instrument's average-price position and what has happened to it; cash is the account's."""

    def __init__(self, run: Run, account: Account, symbol: str):
        self.run, self.account, self.symbol = run, account, symbol
        self.quantity, self.average, self.opened, self.mark = 0, 0.0, None, None
        self.trade_fees, self.trade_pnl, self.largest = 0.0, 0.0, 0
        self.stop, self.target, self.armed = None, None, None
        self.held, self.high, self.low, self.last_pnl = 0, None, None, None

    def slipped(self, kind: str, side: int, price: float, bar: dict) -> float:
        """Only market and stop orders slip, against the order and never out of the bar."""
        if kind == "limit":
            return price
        c = self.run.costs
        moved = price + side * (c.slippage_ticks * self.run.tick_size + price * c.slippage_bps / 1e4)
        inside = min(max(moved, bar["low"]), bar["high"])
        self.account.counts["clamped"] += inside != moved
        return inside

    def fill(self, side: int, contracts: int, price: float, bar: dict, tag: str) -> None:
        """Books a fill; a flip closes first and enters the rest at the same price."""
        c, account = self.run.costs, self.account
        fee = c.fee_per_contract * contracts + c.fee_flat
        account.cash -= fee
        account.fees += fee
        account.fills.append({"symbol": self.symbol, "bar_index": bar["bar_index"], "side": side, "quantity": contracts, "price": price, "fee": fee, "tag": tag})
        closing = min(contracts, abs(self.quantity)) if self.quantity * side < 0 else 0
        self.trade_fees += fee
        if closing:
            pnl = -side * closing * self.run.multiplier * (price - self.average)
            account.cash += pnl
            account.realised += pnl
            self.trade_pnl += pnl
            self.quantity += side * closing
            if not self.quantity:
                account.trades.append({"symbol": self.symbol, "opened_bar": self.opened, "closed_bar": bar["bar_index"], "direction": -side, "max_quantity": self.largest, "gross_pnl": self.trade_pnl, "fees": self.trade_fees})
                self.last_pnl = self.trade_pnl - self.trade_fees
                self.trade_fees = self.trade_pnl = 0.0
                self.largest, self.average, self.held, self.high, self.low = 0, 0.0, 0, None, None
                self.stop = self.target = self.armed = None
        rest = contracts - closing
        if rest:
            if not self.quantity:
                self.opened = bar["bar_index"]
            self.average = (self.average * abs(self.quantity) + price * rest) / (abs(self.quantity) + rest)
            self.quantity += side * rest
        self.largest = max(self.largest, abs(self.quantity))
        self.mark = price if self.mark is None else self.mark

    def open_profit(self) -> float:
        return self.quantity * self.run.multiplier * (self.mark - self.average) if self.quantity else 0.0

    def margin(self, quantity: int | None = None) -> float:
        return self.run.initial_margin * self.run.margin_ratio * abs(self.quantity if quantity is None else quantity)

    def exposure(self, quantity: int | None = None, price: float | None = None) -> float:
        q = self.quantity if quantity is None else quantity
        return q * self.run.multiplier * (price if price is not None else self.mark) if q else 0.0

    def state(self, closed_now: bool) -> dict[str, float | None]:
        """What the position node reads."""
        held = self.quantity != 0
        return {
            "quantity": float(self.quantity), "direction": float((self.quantity > 0) - (self.quantity < 0)), "bars_held": float(self.held), "entry_price": self.average if held else None,
            "high_since_entry": self.high, "low_since_entry": self.low, "closed_trade": float(closed_now), "closed_pnl": self.last_pnl,
        }


class Account:
    """Cash and the books of a run."""

    def __init__(self, initial: float, limits: Limits):
        self.initial = self.cash = self.peak = initial
        self.limits = limits
        #: One for each instrument that has had a bar.
        self.books: dict[str, Book] = {}
        #: What has happened since it was last told.
        self.fills: list[dict] = []
        self.trades: list[dict] = []
        self.counts: Counter[str] = Counter()
        #: Results of closed contracts and fees of all time, for the check of the books.
        self.realised = self.fees = 0.0

    def checked(self) -> float:
        """The equity, which must be the initial cash and all results less all fees."""
        now = self.equity()
        other = self.initial + self.realised - self.fees + sum(b.open_profit() for b in self.books.values())
        if abs(now - other) > 1e-6 * max(1.0, abs(now)):
            raise ArithmeticError(f"the books do not agree: {now} and {other}")
        return now

    def equity(self) -> float:
        return self.cash + sum(b.open_profit() for b in self.books.values())

    def refusal(self, book: Book, side: int, contracts: int, price: float) -> str | None:
        """The cap that an entry would break, if any."""
        wanted, run, equity = book.quantity + side * contracts, book.run, self.equity()
        if run.max_gross_contracts is not None and abs(wanted) > run.max_gross_contracts:
            return "gross_contracts"
        others = [b for b in self.books.values() if b is not book]
        if abs(wanted) > abs(book.quantity):
            margin = sum(map(Book.margin, others)) + book.margin(wanted)
            if margin > equity and run.initial_margin:
                if run.reject_on_margin:
                    return "margin"
                self.counts["margin_warned"] += 1
        before, after = [book.exposure(price=price)], [book.exposure(wanted, price)]
        rest = [b.exposure() for b in others]
        worth = lambda xs, f: f(xs + rest) / equity if equity > 0 else float("inf")
        gross, net = lambda xs: sum(map(abs, xs)), lambda xs: abs(sum(xs))
        same = [b for b in others if b.run.category == run.category and b.quantity]
        held = [b for b in others if b.quantity]
        caps = (
            ("gross_exposure", self.limits.max_gross_exposure, worth(after, gross), worth(before, gross)),
            ("net_exposure", self.limits.max_net_exposure, worth(after, net), worth(before, net)),
            ("positions", self.limits.max_positions, len(held) + (wanted != 0), len(held) + (book.quantity != 0)),
            ("per_category", self.limits.max_per_category, len(same) + (wanted != 0), len(same) + (book.quantity != 0)),
        )
        return next((name for name, cap, now, was in caps if cap is not None and now > cap and now > was), None)

    def state(self) -> dict[str, float]:
        """What the account node reads."""
        now = self.equity()
        return {"equity": now, "cash": self.cash, "peak_equity": self.peak, "initial_equity": self.initial, "drawdown": now / self.peak - 1 if self.peak > 0 else 0.0, "total_return": now / self.initial - 1}


def _value(bar: dict, name: str) -> float | None:
    v = bar.get(name)
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v)


def statistic(stat: str, xs: list[float]) -> float:
    """A rolling statistic of values, oldest first; all of them are defined."""
    n, last = len(xs), xs[-1]
    mean = sum(xs) / n
    if stat in ("var", "stdev", "zscore"):
        var = sum((x - mean) ** 2 for x in xs) / (n - 1)
        return var if stat == "var" else math.sqrt(var) if stat == "stdev" else (last - mean) / math.sqrt(var) if var > 1e-24 else math.nan
    if stat == "ema":
        a = 2.0 / (n + 1)
        return functools.reduce(lambda y, x: y + a * (x - y), xs)
    if stat == "slope":
        middle = (n - 1) / 2
        return sum((i - middle) * x for i, x in enumerate(xs)) / sum((i - middle) ** 2 for i in range(n))
    return {"mean": lambda: mean, "sum": lambda: sum(xs), "min": lambda: min(xs), "max": lambda: max(xs), "median": lambda: statistics.median(xs), "rank": lambda: sum(x <= last for x in xs) / n, "count_true": lambda: float(sum(x > 0 for x in xs))}[stat]()


def _looking_back(kind: str, spec: dict, past: deque, of) -> float | None:
    """A node over the past of its operands; ``past`` keeps what they were, newest last."""
    if kind == "lag":
        past.append(of("inner"))
        return past[-1 - spec["bars"]] if len(past) > spec["bars"] else None
    if kind == "rolling":
        past.append(of("inner"))
        xs = list(past)[:: -spec.get("stride", 1)][: spec["window"]][::-1]
        if len(xs) < spec["window"] or None in xs:
            return None
        y = statistic(spec["stat"], xs)
        return None if math.isnan(y) else y
    if kind in ("bars_since", "value_when"):
        past.append((of("inner"), of("when")) if kind == "value_when" else (None, of("inner")))
        for ago, (value, met) in enumerate(list(past)[: -spec["lookback"] - 1 : -1]):
            if met is None:
                return None
            if met:
                return float(ago) if kind == "bars_since" else value
        return None
    fast, slow = of("fast"), of("slow")  # crossings
    past.append(None if fast is None or slow is None else fast - slow)
    if len(past) < 2 or None in (past[-2], past[-1]):
        return None
    sign = 1 if kind == "crosses_above" else -1
    return float(sign * past[-2] <= 0 < sign * past[-1])


#: Nodes that look back, and how many values of the past each keeps.
LOOKS_BACK = {"lag": lambda s: s["bars"] + 1, "rolling": lambda s: (s["window"] - 1) * s.get("stride", 1) + 1, "bars_since": lambda s: s["lookback"], "value_when": lambda s: s["lookback"], "crosses_above": lambda s: 2, "crosses_below": lambda s: 2}


def evaluate(spec: dict, bar: dict, position: dict, account: dict, pasts: dict[int, deque] | None = None) -> float | None:
    """What is left of a rule once its parts without position or account are columns.

    ``pasts`` has what nodes that look back remember from bar to bar; so every
    node is worked out at every bar.
    """
    pasts = {} if pasts is None else pasts
    kind, of = spec["type"].partition("@")[0], lambda k: evaluate(spec[k], bar, position, account, pasts)
    if kind == "column":
        return _value(bar, spec["name"])
    if kind == "constant":
        return float(spec["value"])
    if kind in ("position", "account"):
        return {"position": position, "account": account}[kind][spec.get("field", "quantity" if kind == "position" else "equity")]
    if kind in LOOKS_BACK:
        if id(spec) not in pasts:
            pasts[id(spec)] = deque(maxlen=LOOKS_BACK[kind](spec))
        return _looking_back(kind, spec, pasts[id(spec)], of)
    if kind == "if_then_else":
        c, a, b = of("condition"), of("then"), of("otherwise")
        return None if c is None else a if c else b
    if kind in ("all_of", "any_of", "min_of", "max_of"):
        xs = [evaluate(x, bar, position, account, pasts) for x in spec["operands"]]
        if None in xs:
            return None
        return {"all_of": lambda: float(all(xs)), "any_of": lambda: float(any(xs)), "min_of": lambda: min(xs), "max_of": lambda: max(xs)}[kind]()
    if kind == "not":
        x = of("inner")
        return None if x is None else float(x == 0)
    if kind == "math":
        x = of("inner")
        if x is None:
            return None
        try:
            y = {"abs": abs, "neg": lambda v: -v, "sign": lambda v: float((v > 0) - (v < 0)), "log": math.log, "exp": math.exp, "sqrt": math.sqrt, "inverse": lambda v: 1 / v, "floor": math.floor, "ceil": math.ceil}[spec["op"]](x)
        except (ValueError, ZeroDivisionError, OverflowError):
            return None
        return float(y)
    a, b = of("left"), of("right")
    if a is None or b is None:
        return None
    if kind == "compare":
        return float({">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "==": a == b, "!=": a != b}[spec["op"]])
    if spec["op"] in "/%" and b == 0:
        return None
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[spec["op"]]()


def fold_stream(bars: Iterable[dict], run: Run | dict[str, Run], limits: Limits | None = None, residual: dict[str, dict] | None = None, together: bool = False) -> Iterator[tuple[str, dict]]:
    """Equity, fills, trades and counts of one portfolio, as (kind, record), as they come about.

    Settings are one for all instruments, or one each. A portfolio of several
    (``together``) numbers its points by instant and tells the sum of contracts;
    any other has its instrument's bar numbers and signed contracts.
    ``bars`` come in order of instant and then symbol. An order waits for its
    instrument's next bar once it is due. ``residual`` holds the rules that read
    the position or the account.
    """
    of = (lambda s: run[s]) if isinstance(run, dict) else (lambda s: run)
    initial = next(iter(run.values())).initial_cash if isinstance(run, dict) else run.initial_cash
    account, pending, point, residual = Account(initial, limits or Limits()), [], None, residual or {}
    ended: dict[str, dict] = {}
    pasts: dict[str, dict[int, deque]] = defaultdict(dict)

    def told() -> Iterator[tuple[str, dict]]:
        yield from (("fills", x) for x in account.fills)
        yield from (("trades", x) for x in account.trades)
        account.fills, account.trades = [], []

    for i, (_, group) in enumerate(itertools.groupby(bars, key=lambda b: b["ts"])):
        if point:
            yield "equity", point
        group = list(group)
        closed = dict.fromkeys((b["symbol"] for b in group), False)
        for bar in group:
            symbol = bar["symbol"]
            if symbol not in account.books:
                account.books[symbol] = Book(of(symbol), account, symbol)
            book = account.books[symbol]
            ended[symbol] = bar
            own = book.run
            trades = len(account.trades)
            # Protections are armed from the bar after the fill.
            if book.quantity and book.armed is not None and i > book.armed:
                side = -1 if book.quantity > 0 else 1
                hits = [(k, t) for k, p in (("stop", book.stop), ("limit", book.target)) if p is not None and (t := trigger(k, side, p, bar)) is not None]
                if len(hits) == 2:
                    account.counts["both"] += 1
                    hits = hits[:1] if own.pessimistic else hits[1:]
                for kind, at in hits:
                    book.fill(side, abs(book.quantity), book.slipped(kind, side, at, bar), bar, "stop_loss" if kind == "stop" else "take_profit")
            due = [o for o in pending if o["due"] <= i and o["symbol"] == bar["symbol"]]
            pending = [o for o in pending if o["due"] > i or o["symbol"] != bar["symbol"]]
            for o in due:
                if own.max_fill_gap_seconds is not None and (bar["ts"] - o["ts"]) > own.max_fill_gap_seconds:
                    account.counts["expired"] += 1
                    continue
                contracts = min(o["quantity"], abs(book.quantity)) if o["reduce"] else o["quantity"]
                if not contracts or (o["reduce"] and book.quantity * o["side"] >= 0):
                    continue
                at = trigger(o["kind"], o["side"], o["price"], bar)
                if at is None:
                    continue
                if not o["reduce"]:
                    book.mark = at if book.mark is None else book.mark
                    if why := account.refusal(book, o["side"], contracts, at):
                        account.counts[why] += 1
                        continue
                elif o["due"] < i:
                    account.counts["late_exit"] += 1
                book.fill(o["side"], contracts, book.slipped(o["kind"], o["side"], at, bar), bar, o["tag"])
                if book.quantity and not o["reduce"]:
                    book.stop, book.target, book.armed = o["stop"], o["target"], i
            book.mark = bar["close"]
            if book.quantity:
                book.held += 1
                book.high = bar["high"] if book.high is None else max(book.high, bar["high"])
                book.low = bar["low"] if book.low is None else min(book.low, bar["low"])
            closed[bar["symbol"]] = len(account.trades) > trades
        equity = account.checked()
        account.peak = max(account.peak, equity)
        if sum(map(Book.margin, account.books.values())) > equity:
            account.counts["margin_short"] += 1
        held = sum(abs(b.quantity) if together else b.quantity for b in account.books.values())
        point = {"bar_index": i if together else group[0]["bar_index"], "ts": group[0]["ts"], "equity": equity, "cash": account.cash, "contracts": held}
        yield from told()
        for bar in group:
            book = account.books[bar["symbol"]]
            if residual:
                states = book.state(closed[bar["symbol"]]), account.state()
                bar = bar | {name: evaluate(rule, bar, *states, pasts[bar["symbol"]]) for name, rule in residual.items()}
            pending += decisions(book, bar, equity, i)
    if any(b.run.liquidate_at_end and b.quantity for b in account.books.values()):
        for symbol, book in account.books.items():
            if book.run.liquidate_at_end and book.quantity:
                book.fill(-1 if book.quantity > 0 else 1, abs(book.quantity), ended[symbol]["close"], ended[symbol], "liquidation")
        yield from told()
        point = point | {"equity": account.checked(), "cash": account.cash, "contracts": sum(abs(b.quantity) for b in account.books.values())}
    if point:
        yield "equity", point
    yield from (("counts", {"name": k, "n": n}) for k, n in sorted(account.counts.items()) if n)


def fold_panel(bars: Iterable[dict], runs: dict[str, Run], limits: Limits | None = None, residual: dict[str, dict] | None = None) -> dict[str, list[dict]]:
    """All that ``fold_stream`` tells of the instruments of ``runs``, by kind."""
    out: dict[str, list[dict]] = {k: [] for k in OUTPUTS}
    for kind, record in fold_stream(bars, runs, limits, residual, len(runs) > 1):
        out[kind].append(record)
    return out


def decisions(book: Book, bar: dict, equity: float, i: int) -> list[dict]:
    """The orders that the rules place at a bar's close: exits first, then entries."""
    run, out = book.run, []

    def order(side: int, contracts: int, reduce: bool, tag: str, kind: str = "market", price: float | None = None, stop=None, target=None) -> None:
        if contracts > 0:
            out.append({"symbol": book.symbol, "side": side, "quantity": contracts, "reduce": reduce, "tag": tag, "kind": kind, "price": price, "stop": stop, "target": target, "due": i + run.lag_bars, "ts": bar["ts"]})

    true = lambda name: (v := _value(bar, name)) is not None and v != 0
    leaving = False
    for direction, name in ((1, "exit_long"), (-1, "exit_short")):
        if book.quantity * direction > 0 and true(name):
            part = _value(bar, "exit_quantity")
            contracts = abs(book.quantity) if part is None else min(int(part), abs(book.quantity))
            order(-direction, contracts, True, name)
            leaving = contracts == abs(book.quantity)
    share = _value(bar, TARGET)
    if share is not None:
        worth = abs(bar["close"]) * run.multiplier
        wanted = int(equity * abs(share) / worth) * (1 if share > 0 else -1) if worth > 0 else 0
        delta = wanted - book.quantity
        order(1 if delta > 0 else -1, abs(delta), book.quantity * delta < 0 and abs(delta) <= abs(book.quantity), "rebalance")
    size = run.quantity
    if run.sizing == "equity_fraction":
        worth = abs(bar["close"]) * run.multiplier
        size = int(equity * run.fraction / worth) if worth > 0 else 0
    elif run.sizing == "per_equity":
        size = int(equity * (_value(bar, "size") or 0.0))
    elif run.sizing == "column":
        size = max(int(_value(bar, "size") or 0.0), 0)
    if run.max_contracts is not None:
        size = min(size, run.max_contracts)
    for direction, name in ((1, "entry_long"), (-1, "entry_short")):
        if not true(name):
            continue
        held = book.quantity and not leaving
        if held and (book.quantity * direction < 0 or not run.pyramiding):
            continue
        kind, price = next(((k, p) for k, n in (("limit", "entry_limit"), ("stop", "entry_stop")) if (p := _value(bar, n)) is not None), ("market", None))
        order(direction, size, False, name, kind, price, _value(bar, "stop_loss"), _value(bar, "take_profit"))
    return out


def fold(bars: list[dict], run: Run, residual: dict[str, dict] | None = None) -> dict[str, list[dict]]:
    """One run over one instrument."""
    return fold_panel([{"symbol": "", **b} for b in bars], {b.get("symbol", ""): run for b in bars[:1]} or {"": run}, None, residual)


OUTPUTS = {
    "equity": "run_id string, bar_index long, ts double, equity double, cash double, contracts long",
    "fills": "run_id string, symbol string, bar_index long, side int, quantity long, price double, fee double, tag string",
    "trades": "run_id string, symbol string, opened_bar long, closed_bar long, direction int, max_quantity long, gross_pnl double, fees double",
    "counts": "run_id string, name string, n long",
}
#: All kinds side by side, told apart by ``kind``.
_COLUMNS = dict(c.split() for ddl in OUTPUTS.values() for c in ddl.split(", "))
#: Records of an Arrow batch.
_BATCH = 8192


def simulate_all(signals: DataFrame, run: Run | dict[str, Run], limits: Limits | None = None, residual: dict[str, dict] | None = None, together: bool = False) -> DataFrame:
    """Folds each ``run_id`` of bars with rule columns; rows of every kind of output, with ``kind``.

    Settings are one for every symbol, or one a symbol; a run may have several
    instruments (``together``) or has one. A run's bars go through
    one task in order, since each depends on the last; many runs, folds or
    parameter sets go through as many tasks as there are.
    """
    names = [c for c in signals.columns if c in (*RULES, "size", TARGET) or c.startswith("part_")]
    rows = signals.select("run_id", "symbol", "bar_index", (F.unix_micros("ts_close") / 1e6).alias("ts"), "open", "high", "low", "close", *names)
    rows = rows.repartition("run_id").sortWithinPartitions("run_id", "ts", "symbol")
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([("kind", pa.string()), *((k, kinds[t]) for k, t in _COLUMNS.items())])

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield from b.to_pylist()

    def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for run_id, bars in itertools.groupby(records(batches), key=lambda r: r["run_id"]):
            for kind, record in fold_stream(bars, run, limits, residual, together):
                held.append({"kind": kind, "run_id": run_id, **record})
                if len(held) >= _BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return rows.mapInArrow(folded, "kind string, " + ", ".join(f"{k} {t}" for k, t in _COLUMNS.items()))


def output(told: DataFrame, kind: str) -> DataFrame:
    """One kind of ``simulate_all``'s rows, with its own columns."""
    if kind not in OUTPUTS:
        raise ValueError(f"unknown output {kind!r}")
    return told.where(F.col("kind") == kind).select(*(c.split()[0] for c in OUTPUTS[kind].split(", ")))


def simulate(signals: DataFrame, run: Run | dict[str, Run], kind: str = "equity", limits: Limits | None = None, residual: dict[str, dict] | None = None, together: bool = False) -> DataFrame:
    """One kind of output of a simulation: equity, fills, trades or counts."""
    if kind not in OUTPUTS:
        raise ValueError(f"unknown output {kind!r}")
    return output(simulate_all(signals, run, limits, residual, together), kind)


def buy_and_hold(bars: DataFrame, run: Run) -> DataFrame:
    """(symbol, equity at the last close) of one buy on the second bar's open, in closed form."""
    cost = run.costs.fee_per_contract * run.quantity + run.costs.fee_flat
    found = bars.groupBy("symbol").agg(F.max(F.when(F.col("bar_index") == 1, F.col("open"))).alias("entry"), F.max_by("close", "bar_index").alias("last"))
    gain = F.lit(run.quantity * run.multiplier) * (F.col("last") - F.col("entry"))
    return found.select("symbol", (F.lit(run.initial_cash) + F.coalesce(gain - cost, F.lit(0.0))).alias("equity"))
