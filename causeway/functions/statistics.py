"""Rolling statistics."""

from __future__ import annotations

import math

import numpy as np

from causeway.functions.common import correlation as corr
from causeway.functions.common import log_return, simple_return, slope
from causeway.functions.registry import ParameterError, primitive


@primitive("returns", "statistics")
def returns(g, window=1, field="close", log=False):
    """Simple or logarithmic return; undefined on a zero or a change of sign."""
    before = g.lag(field, window)
    r = g.let(f"CASE WHEN {before} * {field} > 0 THEN {field} / {before} END")
    return g.guard(g.let(f"ln({r})" if log else f"{r} - 1.0"), window + 1)


@primitive("zscore", "statistics")
def zscore(g, window, field="close", ddof=1):
    """Distance from the mean in standard deviations."""
    s = g.std(field, window, ddof)
    return g.guard(g.let(f"CASE WHEN {s} > 1E-12 THEN ({field} - {g.avg(field, window)}) / {s} END"), window, (field, window))


@primitive("stdev", "statistics")
def stdev(g, window, field="close", ddof=1):
    """Standard deviation."""
    return g.guard(g.std(field, window, ddof), window, (field, window))


@primitive("volatility", "statistics")
def volatility(g, window, field="close", ddof=1, log=False, annualise=None):
    """Standard deviation of returns, scaled if asked."""
    r = log_return(g, field) if log else simple_return(g, field)
    scale = math.sqrt(annualise) if annualise else 1.0
    return g.guard(g.let(f"{g.std(r, window, ddof)} * {scale!r}"), window + 1, (r, window))


@primitive("slope", "statistics")
def slope_(g, window, field="close"):
    """Least-squares slope per bar."""
    if window < 2:
        return g.guard("CAST(NULL AS DOUBLE)", window)
    return g.guard(slope(g, field, window), window, (field, window))


@primitive("variance", "statistics")
def variance(g, window, field="close"):
    """Sample variance."""
    return g.guard(g.agg("var_samp", field, window), window, (field, window))


def _moment(g, r, window, power, excess):
    m, s = g.avg(r, window), g.std(r, window, 0)
    total = g.total(g.mapped(g.list(r, window), lambda v, i: f"power({v} - {m}, {power})"))
    return g.guard(g.let(f"CASE WHEN {s} > 1E-12 THEN {total} / {window} / power({s}, {power}) - {excess} END"), window + 1, (r, window))


@primitive("skew", "statistics")
def skew(g, window, field="close"):
    """Population skewness of simple returns."""
    return _moment(g, simple_return(g, field), window, 3, 0.0)


@primitive("kurtosis", "statistics")
def kurtosis(g, window, field="close"):
    """Population excess kurtosis of simple returns."""
    return _moment(g, simple_return(g, field), window, 4, 3.0)


@primitive("median", "statistics")
def median(g, window, field="close"):
    """Median of the window."""
    return g.guard(g.quantile(field, window, 0.5), window, (field, window))


@primitive("quantile", "statistics")
def quantile(g, window, field="close", q=0.5):
    """Quantile by linear interpolation."""
    if not 0 <= q <= 1:
        raise ParameterError("q must lie in [0, 1]")
    return g.guard(g.quantile(field, window, float(q)), window, (field, window))


@primitive("mad", "statistics")
def mad(g, window, field="close"):
    """Mean absolute deviation from the mean."""
    m = g.avg(field, window)
    return g.guard(g.let(f"{g.total(g.mapped(g.list(field, window), lambda v, i: f'abs({v} - {m})'))} / {window}"), window, (field, window))


@primitive("stderr", "statistics")
def stderr(g, window, field="close"):
    """Standard error of the mean."""
    return g.guard(g.let(f"{g.std(field, window, 1)} / {math.sqrt(window)!r}"), window, (field, window))


@primitive("percentile_rank", "statistics")
def percentile_rank(g, window, field="close"):
    """Share of the window at or below the last value, in percent."""
    xs = g.list(field, window)
    return g.guard(g.let(f"100.0 * {g.count_if(xs, lambda v: f'{v} <= {field}')} / {window}"), window, (field, window))


@primitive("entropy", "statistics")
def entropy(g, window, field="close", bins=8):
    """Shannon entropy of returns over equal bins, as a share of the largest."""
    if bins < 2:
        raise ParameterError("bins must be at least 2")
    r = simple_return(g, field)
    low, high = g.min(r, window), g.max(r, window)
    placed = g.mapped(g.list(r, window), lambda v, i: f"CASE WHEN {high} > {low} THEN least(floor(({v} - {low}) / ({high} - {low}) * {bins}), {bins - 1}) END")
    share = g.each(bins, lambda j: f"{g.count_if(placed, lambda v: f'{v} = {j} - 1')} / {float(window)}" if g.spark else f"len(list_filter({placed}, lambda v: v = {j} - 1)) / {float(window)}")
    parts = g.mapped(share, lambda p, i: f"CASE WHEN {p} > 0 THEN -{p} * ln({p}) ELSE 0.0 END")
    return g.guard(g.let(f"CASE WHEN {high} > {low} THEN {g.total(parts)} / {math.log(bins)!r} END"), window + 1, (r, window))


@primitive("autocorrelation", "statistics")
def autocorrelation(g, window, field="close", lag=1):
    """Correlation of returns with those ``lag`` bars before."""
    r = simple_return(g, field)
    return g.guard(corr(g, r, g.lag(r, lag), window), window + lag + 1, (r, window + lag))


@primitive("correlation", "statistics")
def correlation(g, window, field="close", other="volume"):
    """Correlation of two fields of the same bars."""
    return g.guard(corr(g, field, other, window), window, (field, window), (other, window))


@primitive("beta", "statistics")
def beta(g, window, field="close", other="volume"):
    """Covariance of returns over the other's variance."""
    a, b = simple_return(g, field), simple_return(g, other)
    covariance = g.let(f"covar_pop({a}, {b}) OVER {g.over(window)}", window - 1)
    v = g.agg("var_pop", b, window)
    return g.guard(g.let(f"CASE WHEN {v} > 1E-24 THEN {covariance} / {v} END"), window + 1, (a, window), (b, window))


@primitive("hurst", "statistics")
def hurst(g, window, field="close"):
    """Slope of log spread of block sums over log block size 2, 4 and 8."""
    sizes = [e for e in (2, 4, 8) if window // e >= 2]
    if window < 8 or len(sizes) < 2:
        return g.guard("CAST(NULL AS DOUBLE)", window + 1)
    r = log_return(g, field)
    xs, logs = g.list(r, window), []
    for e in sizes:
        k = window // e
        block = (lambda j, e=e: f"aggregate(slice({xs}, ({j} - 1) * {e} + 1, {e}), 0D, (s, v) -> s + v)") if g.spark else (lambda j, e=e: f"list_sum({xs}[({j} - 1) * {e} + 1 : {j} * {e}])")
        sums = g.each(k, block)
        mean = g.let(f"{g.total(sums)} / {k}")
        spread = g.let(f"sqrt({g.total(g.mapped(sums, lambda v, i, m=mean: f'power({v} - {m}, 2)'))} / {k})")
        logs.append(g.let(f"CASE WHEN {spread} > 0 THEN ln({spread}) END"))
    x = np.log(sizes) - np.log(sizes).mean()
    terms = " + ".join(f"{y} * {float(w)!r}" for y, w in zip(logs, x / (x @ x), strict=True))
    return g.guard(g.let(terms), window + 1, (r, window))
