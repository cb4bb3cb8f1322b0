"""The series model: rows of (key columns, time, tiebreak, values), in any order.

A missing value is NULL (NaN is turned into NULL on the way in); an absent event
is an absent row. Windows are partitioned by the key columns and ordered by time
and tiebreak.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def clean(v: Column | str) -> Column:
    """NaN to NULL."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(~F.isnan(v), v)


@dataclass(frozen=True)
class Series:
    """Which columns hold a frame's keys, time and tiebreak."""

    keys: tuple[str, ...]
    time: str
    tie: tuple[str, ...] = ()

    @staticmethod
    def of(keys: str | Sequence[str], time: str, *tie: str) -> Series:
        return Series((keys,) if isinstance(keys, str) else tuple(keys), time, tie)

    @property
    def order(self) -> tuple[str, ...]:
        return (self.time, *self.tie)

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        """The newest n rows, the present one included."""
        return self.ordered().rowsBetween(1 - n, 0)

    def upto(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, 0)

    def before(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, -1)

    def prev(self, v: Column) -> Column:
        """The newest value before the present row that is not missing."""
        return F.last(v, ignorenulls=True).over(self.before())


def canonical(df: DataFrame, keys: Sequence[str], time: str, value: str, *tie: str) -> DataFrame:
    """A long frame (keys, time, tiebreak, v) of doubles with NaN as NULL."""
    return df.select(*keys, time, *tie, clean(F.col(value).cast("double")).alias("v"))
