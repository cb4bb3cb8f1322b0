"""Positions and their profit and loss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.series import Series


def pos_simple(s: Series, scale: Column, signal: Column | None = None, const: float = 1.0) -> Column:
    """Signal over scale, from the second event on: the part of pos_linear that needs no state."""
    sig = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), signal)) if signal is not None else F.lit(float(const or 1.0))
    fired = F.row_number().over(s.ordered()) > 1
    ok = fired & sig.isNotNull() & scale.isNotNull()
    return F.last(F.when(ok, F.try_divide(sig, scale)), ignorenulls=True).over(s.upto())


def pnl_linear(s: Series, pos: Column, px: Column) -> Column:
    """The price change since the last price, times the position held then."""
    return (px - s.prev(px)) * s.prev(pos)
