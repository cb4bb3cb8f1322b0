"""Scalar arithmetic on Columns. A missing operand gives a missing result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def absolute(v: Column) -> Column:
    return F.abs(v)


def signed_sqrt(v: Column) -> Column:
    return F.signum(v) * F.sqrt(F.abs(v))


def signed_sq(v: Column) -> Column:
    return F.signum(v) * v * v


def add(left: Column, right: Column, a: float = 0.0, b: float = 1.0) -> Column:
    return F.lit(float(a)) + (left + right) * F.lit(float(b))


def subtract(left: Column, right: Column, a: float = 0.0, b: float = 1.0) -> Column:
    return F.lit(float(a)) + (left - right) * F.lit(float(b))


diff = subtract


def ratio(left: Column, right: Column) -> Column:
    """Missing where the denominator is zero to five places."""
    return F.when(F.round(right, 5) != 0, F.try_divide(left, right))


def pct_diff(left: Column, right: Column, m: float = 1.0) -> Column:
    return (F.try_divide(left, right) - 1) * F.lit(float(m or 1.0))


def truncate(v: Column, bound: Column, b: float = 1.0) -> Column:
    """Zero inside (-b * bound, b * bound)."""
    edge = bound * F.lit(float(b))
    return F.when((v > -edge) & (v < edge), F.lit(0.0)).when(v.isNotNull() & bound.isNotNull(), v)


def norm_range_pct(left: Column, right: Column, v: Column, a: float = 0.0, b: float = 1.0) -> Column:
    """Where v lies between left and right, shifted by a and scaled by b; missing for an empty range."""
    return (F.try_divide(v - left, right - left) + F.lit(float(a))) * F.lit(float(b))


def corr(cov: Column, s1: Column, s2: Column) -> Column:
    """Correlation from a covariance and two deviations."""
    return F.try_divide(cov, s1 * s2)


def beta(corr: Column, s1: Column, s2: Column) -> Column:
    """Slope of the first series (deviation s1) on the second (s2)."""
    return F.try_divide(corr * s1, s2)
