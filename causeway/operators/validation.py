"""Rules over bars, counted in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

NEEDED = ("ts_event", "open", "high", "low", "close", "volume")
ERROR, WARNING, INFO = "error", "warning", "info"


class DataValidationError(ValueError):
    pass


@dataclass(frozen=True)
class Limits:
    """Bounds that some rules need; without one its rule is silent."""

    max_bar_return: float | None = None
    max_gap_seconds: float | None = None
    allow_non_positive_prices: bool = True


def rules(limits: Limits) -> dict[str, tuple[str, str]]:
    """name: (severity, SQL count). ``before``, ``gap`` and ``earlier`` are the last bar's close, distance and instant."""
    prices = ("open", "high", "low", "close")
    odd = " OR ".join(f"{p} IS NULL OR NOT abs({p}) <= 1.7976931348623157E308" for p in prices)
    out = {
        "timestamps_non_null": (ERROR, "count_if(ts_event IS NULL)"),
        "timestamps_strictly_monotonic": (ERROR, "count_if(gap <= 0)"),
        "prices_finite": (ERROR, f"count_if({odd})"),
        "volume_valid": (ERROR, "count_if(volume IS NULL OR volume < 0 OR NOT abs(volume) <= 1.7976931348623157E308)"),
        "high_low_ordering": (ERROR, "count_if(high < low)"),
        "open_close_within_range": (ERROR, "count_if(open < low OR open > high) + count_if(close < low OR close > high)"),
        "non_positive_prices": (WARNING if limits.allow_non_positive_prices else ERROR, " + ".join(f"count_if({p} <= 0)" for p in prices)),
    }
    if limits.max_bar_return is not None:
        out["max_bar_return"] = (ERROR, f"count_if(before <> 0 AND abs(close / before - 1) > {limits.max_bar_return})")
    if limits.max_gap_seconds is not None:
        out["max_gap"] = (ERROR, f"count_if(gap > {limits.max_gap_seconds})")
    return out


#: Rules that users add: name to (severity, SQL count over a bar's columns, ``before``, ``gap``).
_OWN: dict[str, tuple[str, str]] = {}


def validation_rule(name: str, severity: str, count: str) -> None:
    """Registers a rule: an aggregate that counts violations. It runs with all others, in the same aggregation."""
    if name in _OWN or name in rules(Limits(1.0, 1.0)):
        raise DataValidationError(f"{name} is already registered")
    if severity not in (ERROR, WARNING, INFO):
        raise DataValidationError(f"unknown severity {severity!r}")
    _OWN[name] = (severity, count)


def masked(bars: DataFrame, condition: str) -> DataFrame:
    """The bars that meet a condition; DataValidationError if there is none."""
    kept = bars.where(condition)
    if kept.isEmpty():
        raise DataValidationError(f"no bar meets {condition}")
    return kept


def _prepared(bars: DataFrame) -> DataFrame:
    """With the bar before. Order is that of ``ordinal`` (as ingested) if there is one, else of time."""
    by = "PARTITION BY symbol " if "symbol" in bars.columns else ""
    order = "ordinal" if "ordinal" in bars.columns else "ts_event"
    seconds = "unix_micros(ts_event) / 1000000D"
    return bars.withColumn("_s", F.expr(seconds)).selectExpr("*", f"lag(close) OVER ({by}ORDER BY {order}) AS before", f"_s - lag(_s) OVER ({by}ORDER BY {order}) AS gap")


def check(bars: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(rule, severity, violations) of every rule, clean ones included."""
    if missing := [c for c in NEEDED if c not in bars.columns]:
        raise DataValidationError(f"missing columns: {', '.join(missing)}")
    if not isinstance(bars.schema["ts_event"].dataType, (TimestampType, TimestampNTZType)):
        raise DataValidationError("ts_event must be a timestamp in UTC")
    found = rules(limits or Limits()) | _OWN
    counts = _prepared(bars).agg(*(F.expr(f"CAST({e} AS BIGINT)").alias(n) for n, (_, e) in found.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.col(n).alias("violations")) for n, (s, _) in found.items()))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def gap_profile(bars: DataFrame) -> DataFrame:
    """(median_step, irregular, up_to_6min, up_to_2h, up_to_3d, beyond) of the distances between bars, in seconds."""
    gaps = _prepared(bars).where("gap IS NOT NULL").select("gap")
    step = gaps.agg(F.percentile("gap", F.lit(0.5)).alias("median_step"))
    return gaps.join(step).groupBy("median_step").agg(*(F.expr(f"count_if({e})").alias(n) for n, e in GAPS.items()))


GAPS = {"irregular": "gap <> median_step", "up_to_6min": "gap > median_step AND gap <= 360", "up_to_2h": "gap > median_step AND gap > 360 AND gap <= 7200", "up_to_3d": "gap > median_step AND gap > 7200 AND gap <= 259200", "beyond": "gap > median_step AND gap > 259200"}


def accepted(bars: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The bars, or DataValidationError with every broken rule."""
    broken = [f"{r['rule']}: {r['violations']}" for r in check(bars, limits).where("severity = 'error' AND violations > 0").collect()]
    if broken:
        raise DataValidationError("; ".join(broken))
    return bars
