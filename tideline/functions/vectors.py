"""Arrays as vectors, arrays of arrays as matrices (by rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_vec(*vs: Column) -> Column:
    """A vector of scalars; filter on no_gaps() first where an absent part means no event."""
    return F.array(*vs)


def no_gaps(*vs: Column) -> Column:
    return reduce(lambda a, b: a & b, (v.isNotNull() for v in vs))


def all_missing(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNull())


def _total(v: Column) -> Column:
    """NULL if any part is."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean_vec(v: Column, a: float = 0.0, b: float = 1.0) -> Column:
    return F.try_divide(_total(v), F.size(v)) * F.lit(float(b)) + F.lit(float(a))


def sum_vec(v: Column, a: float = 0.0, b: float = 1.0) -> Column:
    return _total(v) * F.lit(float(b)) + F.lit(float(a))


def row_of(m: Column, i: int, transpose: bool = False) -> Column:
    return F.transform(m, lambda r: F.get(r, F.lit(i))) if transpose else F.get(m, F.lit(i))


def sum_mat(m: Column, i: int, transpose: bool = False) -> Column:
    """Sum of row i, or of column i."""
    return _total(row_of(m, i, transpose))


def mat_entry(m: Column, i: int, j: int) -> Column:
    return F.get(F.get(m, F.lit(i)), F.lit(j))


def subtract_vec_i(left: Column, right: Column, i: int, j: int, a: float = 0.0, b: float = 1.0) -> Column:
    return F.lit(float(a)) + (F.get(left, F.lit(i)) - F.get(right, F.lit(j))) * F.lit(float(b))


def dot(x: Column, y: Column) -> Column:
    return _total(F.zip_with(x, y, lambda a, b: a * b))


def v_x_vec_i(v: Column, vec: Column, i: int) -> Column:
    return F.when(~all_missing(vec), v * F.get(vec, F.lit(i)))


def vec_x_mat_i(v: Column, m: Column, i: int) -> Column:
    """Projection of v on column i of m."""
    return F.when(~all_missing(v), dot(v, row_of(m, i, transpose=True)))


def _middle(v: Column) -> tuple[Column, Column]:
    half = F.floor(F.size(v) / 2).cast("int")
    return F.get(v, half - 1), F.get(v, half)


def norm_mid_vec(v: Column) -> Column:
    """Distance from the middle of a sorted vector."""
    lo, hi = _middle(v)
    return F.transform(v, lambda x: x - (lo + hi) / 2)


def norm_mid_pct_vec(v: Column) -> Column:
    lo, hi = _middle(v)
    return F.transform(v, lambda x: F.try_divide(x - (lo + hi) / 2, (lo + hi) / 2))


def norm_mid_inner_vec(v: Column) -> Column:
    """Distance from the middle in units of the inner gap."""
    lo, hi = _middle(v)
    return F.transform(v, lambda x: F.try_divide(x - (lo + hi) / 2, lo - hi))


def exp_weights(n: int, span: float) -> Column:
    """Decaying weights over n rows, oldest first, that sum to one."""
    alpha = 2.0 / (span + 1.0)
    raw = F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(1.0 - alpha), i))
    return F.transform(raw, lambda w: w / F.lit((1.0 - (1.0 - alpha) ** n) / alpha))
