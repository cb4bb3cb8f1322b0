"""Fixed row frames and running totals.

Every function takes a Series and returns a Column; missing values are skipped
but fill their place in the frame. Frames at a series' start are partial unless
said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.series import Series


def sum_(s: Series, v: Column, n: int) -> Column:
    """Zero where all are missing."""
    return F.coalesce(F.sum(v).over(s.last(n)), F.lit(0.0))


def mean(s: Series, v: Column, n: int) -> Column:
    return F.avg(v).over(s.last(n))


def std(s: Series, v: Column, n: int) -> Column:
    """Of the population: zero for a single value."""
    return F.stddev_pop(v).over(s.last(n))


def rms(s: Series, v: Column, n: int) -> Column:
    return F.sqrt(F.avg(v * v).over(s.last(n)))


def max_(s: Series, v: Column, n: int) -> Column:
    return F.max(v).over(s.last(n))


def min_(s: Series, v: Column, n: int) -> Column:
    return F.min(v).over(s.last(n))


def full(s: Series, v: Column, n: int, out: Column) -> Column:
    """``out`` only where the frame has n values."""
    return F.when(F.count(v).over(s.last(n)) == n, out)


def skew(s: Series, v: Column, n: int) -> Column:
    """Biased; missing unless the frame is full."""
    return full(s, v, n, F.skewness(v).over(s.last(n)))


def kurtosis(s: Series, v: Column, n: int) -> Column:
    """Biased excess; missing unless the frame is full."""
    return full(s, v, n, F.kurtosis(v).over(s.last(n)))


def quantile(s: Series, v: Column, q: float, n: int) -> Column:
    """Exact, linear between neighbours."""
    return F.percentile(v, F.lit(float(q))).over(s.last(n))


def cov(s: Series, v1: Column, v2: Column, n: int, mu_1: Column | None = None, mu_2: Column | None = None) -> Column:
    """Mean of (v1 - mu_1)(v2 - mu_2) over pairs with both; a mean left out is the series' own over the frame.

    Taken about the pairs' own means and shifted by their distance from the given
    ones, so that nothing is lost where values are large and vary little.
    """
    w = s.last(n)
    m1 = mu_1 if mu_1 is not None else F.avg(v1).over(w)
    m2 = mu_2 if mu_2 is not None else F.avg(v2).over(w)
    both = v1.isNotNull() & v2.isNotNull()
    a, b = F.when(both, v1), F.when(both, v2)
    return F.covar_pop(a, b).over(w) + (F.avg(a).over(w) - m1) * (F.avg(b).over(w) - m2)


def lag(s: Series, v: Column, n: int) -> Column:
    """The oldest of the last n rows: n - 1 steps back."""
    return F.lag(v, n - 1).over(s.ordered())


def strict(s: Series, v: Column, n: int, least: int, out: Column) -> Column:
    """``out`` only where the last n rows have ``least`` values."""
    return F.when(F.count(v).over(s.last(n)) >= least, out)


def abs_change(s: Series, v: Column) -> Column:
    """Against the last value that was not missing."""
    return v - s.prev(v)


def pct_change(s: Series, v: Column) -> Column:
    return F.try_divide(v, s.prev(v)) - 1


def cum_sum(s: Series, v: Column) -> Column:
    """Missing where v is; the sum goes on after a gap."""
    return F.when(v.isNotNull(), F.sum(v).over(s.upto()))


def cum_prod(s: Series, v: Column, a: float = 0.0) -> Column:
    """Product of a + v; a missing v leaves it as it was."""
    return F.when(F.count(v).over(s.upto()) > 0, F.product(F.coalesce(v + F.lit(float(a)), F.lit(1.0))).over(s.upto()))


def trimmed(s: Series, v: Column, out: Column, trim: int = 0) -> Column:
    """``out`` where v is not missing, without the first ``trim`` rows."""
    return F.when(v.isNotNull() & (F.row_number().over(s.ordered()) > trim), out)


# -- weighted frames: one weight per place, oldest first; places before the series' start have none


def _pairs(s: Series, v: Column, weights: Sequence[float]) -> Column:
    """(w, x) of the values in the frame."""
    n = len(weights)
    frame = F.collect_list(F.struct(v.alias("x"))).over(s.last(n))
    w = F.array(*[F.lit(float(x)) for x in weights])
    pairs = F.transform(frame, lambda e, i: F.struct(F.get(w, F.lit(n) - F.size(frame) + i).alias("w"), e["x"].alias("x")))
    return F.filter(pairs, lambda p: p["x"].isNotNull())


def _fold(pairs: Column, of) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda a, p: a + of(p))


def mean_w(s: Series, v: Column, weights: Sequence[float]) -> Column:
    p = _pairs(s, v, weights)
    return F.try_divide(_fold(p, lambda p: p["w"] * p["x"]), _fold(p, lambda p: p["w"]))


def rms_w(s: Series, v: Column, weights: Sequence[float]) -> Column:
    p = _pairs(s, v, weights)
    return F.sqrt(F.try_divide(_fold(p, lambda p: p["w"] * p["x"] * p["x"]), _fold(p, lambda p: p["w"])))


def std_w(s: Series, v: Column, weights: Sequence[float]) -> Column:
    p, m = _pairs(s, v, weights), mean_w(s, v, weights)
    return F.sqrt(F.try_divide(_fold(p, lambda p: p["w"] * (p["x"] - m) * (p["x"] - m)), _fold(p, lambda p: p["w"])))


def max_w(s: Series, v: Column, weights: Sequence[float]) -> Column:
    """The largest weighted value."""
    return F.array_max(F.transform(_pairs(s, v, weights), lambda p: p["w"] * p["x"]))


def min_w(s: Series, v: Column, weights: Sequence[float]) -> Column:
    return F.array_min(F.transform(_pairs(s, v, weights), lambda p: p["w"] * p["x"]))


def quantile_w(s: Series, v: Column, q: float, weights: Sequence[float]) -> Column:
    """The least value at which the weights up to it reach q of their sum."""
    p = F.array_sort(F.transform(_pairs(s, v, weights), lambda p: F.struct(p["x"].alias("x"), p["w"].alias("w"))))
    total = F.aggregate(p, F.lit(0.0), lambda a, e: a + e["w"])
    start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("x"))
    found = F.aggregate(p, start, lambda a, e: F.struct((a["w"] + e["w"]).alias("w"), F.when(a["x"].isNull() & (a["w"] + e["w"] >= F.lit(float(q)) * total), e["x"]).otherwise(a["x"]).alias("x")))
    return found["x"]
