"""Expressions as a graph of named columns, rendered as staged projections.

A column may use windows only over columns of earlier stages, so each new column
lands one stage after the last one it reads, and all columns of a stage are one
projection. All window columns share one partitioning and order, so that Spark
sorts once however many stages there are. Equal expressions are one column.

The same graph renders for Spark and for DuckDB; only lists and folds differ.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"\bx\d+_\b")
#: Bars of a chunk at least, and times the bars that it takes from the chunk before.
CHUNK, CHUNK_REACH = 1024, 8
BIGGEST = "1.7976931348623157E308"


class Graph:
    def __init__(self, dialect: str = "spark", partition: Sequence[str] = ("symbol",), order: str = "ts_close"):
        if dialect not in ("spark", "duckdb"):
            raise ValueError(dialect)
        self.spark = dialect == "spark"
        self.partition, self.order = tuple(partition), order
        self.levels: dict[str, int] = {}
        self.names: dict[str, str] = {}
        #: Bars that a column needs before it is defined.
        self.needs: dict[str, int] = {}
        #: Bars before its own that a column reads; None if that is not bounded.
        self.reach: dict[str, int | None] = {}

    # -- columns ---------------------------------------------------------

    def let(self, expr: str, back: int | None = 0) -> str:
        """Names an expression over earlier columns; ``back``: how far a window in it reaches."""
        if expr in self.names:
            return self.names[expr]
        name = f"x{len(self.names)}_"
        self.names[expr] = name
        below = _NAME.findall(expr)
        self.levels[name] = 1 + max([0, *(self.levels[d] for d in below)])
        reaches = [self.reach[d] for d in below]
        bounded = None not in reaches and back is not None and (back or " OVER " not in expr)
        self.reach[name] = back + max([0, *reaches]) if bounded else None
        return name

    def stages(self) -> list[dict[str, str]]:
        out: list[dict[str, str]] = [{} for _ in range(max(self.levels.values(), default=0))]
        for expr, name in self.names.items():
            out[self.levels[name] - 1][name] = expr
        return out

    def apply(self, df: DataFrame, chunk: int = CHUNK, **outputs: str) -> DataFrame:
        """Adds the outputs to a Spark DataFrame; helper columns are dropped."""
        base = [f"`{c}`" for c in df.columns]
        reach = max((r if (r := self.reach[n]) is not None else -1 for n in self.reach), default=0) if None not in self.reach.values() else None
        split = self.partition == ("symbol",) and "bar_index" in df.columns and reach
        if split:
            df = chunked(df, reach, max(chunk, CHUNK_REACH * reach))
        for stage in self.stages():
            df = df.selectExpr("*", *(f"{e.replace('(PARTITION BY symbol ORDER', '(PARTITION BY symbol, _chunk ORDER') if split else e} AS {n}" for n, e in stage.items()))
        if split:
            df = df.where("_own = _chunk")
        return df.selectExpr(*base, *(f"{v} AS `{k}`" for k, v in outputs.items()))

    def sql(self, source: str, select: str, where: str = "TRUE") -> str:
        """The same as one SQL query over a source (a name or a parenthesised query)."""
        for stage in self.stages():
            source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {source})"
        return f"SELECT {select} FROM {source} WHERE {where}"

    # -- windows ---------------------------------------------------------

    def over(self, n: int | None = None, back: int = 0) -> str:
        """The frame of the n rows that end ``back`` rows ago; without n, the bare window."""
        frame = "" if n is None else f" ROWS BETWEEN {n - 1 + back} PRECEDING AND " + (f"{back} PRECEDING" if back else "CURRENT ROW")
        return f"(PARTITION BY {', '.join(self.partition)} ORDER BY {self.order}{frame})"

    def agg(self, function: str, x: str, n: int, back: int = 0) -> str:
        return self.let(f"{function}({x}) OVER {self.over(n, back)}", n - 1 + back)

    def avg(self, x: str, n: int, back: int = 0) -> str:
        return self.agg("avg", x, n, back)

    def sum(self, x: str, n: int) -> str:
        return self.agg("sum", x, n)

    def max(self, x: str, n: int) -> str:
        return self.agg("max", x, n)

    def min(self, x: str, n: int) -> str:
        return self.agg("min", x, n)

    def std(self, x: str, n: int, ddof: int = 1) -> str:
        return self.agg("stddev_samp" if ddof == 1 else "stddev_pop", x, n)

    def lag(self, x: str, k: int = 1) -> str:
        return x if k == 0 else self.let(f"lag({x}, {k}) OVER {self.over()}", k)

    def row_number(self) -> str:
        """The bar's number; only its order and differences mean something."""
        return self.let("CAST(bar_index AS DOUBLE)")

    def list(self, x: str, n: int) -> str:
        return self.let(f"{'collect_list' if self.spark else 'list'}({x}) OVER {self.over(n)}", n - 1)

    def quantile(self, x: str, n: int, q: float) -> str:
        return self.let(f"percentile({x}, {q}D) OVER {self.over(n)}" if self.spark else f"quantile_cont({x}, {q}) OVER {self.over(n)}", n - 1)

    # -- rows ------------------------------------------------------------

    def div(self, a: str, b: str) -> str:
        """a / b; null where b is 0."""
        return self.let(f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END")

    def when(self, condition: str, then: str, otherwise: str = "NULL") -> str:
        return self.let(f"CASE WHEN {condition} THEN {then} ELSE {otherwise} END")

    def guard(self, x: str, bars: int, *whole: tuple[str, int], finite: bool = True) -> str:
        """x where ``bars`` bars are there and the result is finite, unless that is not asked; ``whole``: (column, n) without nulls."""
        full = "".join(f" AND {self.agg('count', c, n)} = {n}" for c, n in whole)
        bound = f" AND abs({x}) <= {BIGGEST}" if finite else ""
        out = self.let(f"CASE WHEN bar_index >= {bars - 1}{bound}{full} THEN {x} END")
        self.needs[out] = bars
        return out

    # -- lists -----------------------------------------------------------

    @staticmethod
    def _literal(values: Sequence[float]) -> list[str]:
        return [f"{float(v)!r}" for v in values]

    def fir(self, x: str, weights: Sequence[float]) -> str:
        """Dot product of the last len(weights) values, oldest first."""
        xs, w = self.list(x, len(weights)), self._literal(weights)
        if self.spark:
            return self.let(f"aggregate(zip_with({xs}, array({', '.join(v + 'D' for v in w)}), (a, b) -> a * b), 0D, (s, v) -> s + v)")
        return self.total(self.let(f"list_transform(list_zip({xs}, [{', '.join(w)}]), lambda z: z[1] * z[2])"))

    def mapped(self, xs: str, body: Callable[[str, str], str]) -> str:
        """``body(value, index from 1)`` for each element."""
        if self.spark:
            return self.let(f"transform({xs}, (v, i) -> {body('v', '(i + 1)')})")
        return self.let(f"list_transform({xs}, lambda v, i: {body('v', 'i')})")

    def total(self, xs: str) -> str:
        """Sum of a list; null if any element is."""
        if self.spark:
            return self.let(f"aggregate({xs}, 0D, (s, v) -> s + v)")
        return self.let(f"CASE WHEN len(list_filter({xs}, lambda v: v IS NULL)) = 0 THEN list_sum({xs}) END")

    def each(self, n: int, body: Callable[[str], str]) -> str:
        """``body(index)`` for the indices 1 to n."""
        if self.spark:
            return self.let(f"transform(sequence(1, {n}), j -> {body('j')})")
        return self.let(f"list_transform(range(1, {n + 1}), lambda j: {body('j')})")

    def at(self, xs: str, i: str) -> str:
        """An element (an expression)."""
        return f"try_element_at({xs}, {i})" if self.spark else f"{xs}[{i}]"

    def constants(self, values: Sequence[float]) -> str:
        """A list of numbers (an expression)."""
        w = self._literal(values)
        return f"array({', '.join(v + 'D' for v in w)})" if self.spark else f"[{', '.join(w)}]"

    def count_if(self, xs: str, condition: Callable[[str], str]) -> str:
        """How many elements meet a condition (an expression)."""
        return f"size(filter({xs}, v -> {condition('v')}))" if self.spark else f"len(list_filter({xs}, lambda v: {condition('v')}))"

    def series(self, x: str, weights: np.ndarray) -> str:
        """The list of dot products of the last values with each row of weights."""
        xs, rows = self.list(x, weights.shape[1]), ", ".join(self.constants(r) for r in weights)
        if self.spark:
            return self.let(f"transform(array({rows}), w -> aggregate(zip_with({xs}, w, (a, b) -> a * b), 0D, (s, v) -> s + v))")
        return self.let(f"list_transform([{rows}], lambda w: CASE WHEN len(list_filter({xs}, lambda u: u IS NULL)) = 0 AND len({xs}) = {weights.shape[1]} THEN list_sum(list_transform(list_zip({xs}, w), lambda z: z[1] * z[2])) END)")

    def weighed(self, xs: str, weights: Sequence[float]) -> str:
        """Dot product of a list with weights of the same length."""
        return self.total(self.each(len(weights), lambda j: f"{self.at(xs, j)} * {self.at(self.constants(weights), j)}"))

    def head_max(self, xs: str, i: str) -> str:
        """Largest of the first i elements (an expression, for ``mapped``)."""
        return f"array_max(slice({xs}, 1, {i}))" if self.spark else f"list_max({xs}[1:{i}])"

    def fold(self, xs: str, start: str, step: str, finish: str) -> str:
        """Spark's aggregate over a list: state ``s``, element ``v``."""
        if not self.spark:
            raise NotImplementedError("a fold with state has no DuckDB form")
        return self.let(f"aggregate({xs}, {start}, (s, v) -> {step}, s -> {finish})")


def chunked(bars: DataFrame, reach: int, chunk: int) -> DataFrame:
    """Bars with their chunk ``_own``, once for each chunk ``_chunk`` that reads them: their own, and the next ones within ``reach``."""
    at = F.floor(F.col("bar_index") / chunk).cast("long")
    late = (F.col("bar_index") % chunk) >= chunk - reach
    both = F.when(late, F.array(at, at + 1)).otherwise(F.array(at)) if reach <= chunk else F.sequence(at, F.floor((F.col("bar_index") + reach) / chunk).cast("long"))
    spread = bars.withColumn("_own", at).withColumn("_chunk", F.explode(both))
    # As many tasks as there may be: what is computed weighs more than the bytes by which Spark would join partitions.
    return spread.repartition(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol", "_chunk")


# -- weights of finite linear recursions -------------------------------------


def ema_series(values: np.ndarray, n: int, alpha: float | None = None) -> np.ndarray:
    """Exponential averages from the mean of the first n on."""
    alpha = 2.0 / (n + 1.0) if alpha is None else alpha
    out = np.empty(max(len(values) - n + 1, 0))
    if len(out):
        out[0] = values[:n].mean()
        for i in range(1, len(out)):
            out[i] = alpha * values[n + i - 1] + (1 - alpha) * out[i - 1]
    return out


def wilder_series(values: np.ndarray, n: int) -> np.ndarray:
    return ema_series(values, n, 1.0 / n)


def wma_series(values: np.ndarray, n: int) -> np.ndarray:
    w = np.arange(1.0, n + 1.0)
    return np.array([values[i : i + n] @ w for i in range(len(values) - n + 1)]) / w.sum()


def response(linear: Callable[[np.ndarray], np.ndarray | float], length: int) -> np.ndarray:
    """The weights of a linear function of ``length`` values (rows: its results)."""
    return np.array([linear(e) for e in np.eye(length)]).T
