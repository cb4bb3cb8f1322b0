"""Dates: parsing, ordinals and calendar predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """YYYY, YYYYMMDD, YYYY-MM or YYYY-MM-DD; anything else is NULL."""
    s = F.trim(text.cast("string"))
    return (
        F.when(s.rlike(r"^\d{4}$"), F.try_to_date(F.concat(s, F.lit("-01-01")), "yyyy-MM-dd"))
        .when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd"))
        .when(s.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(s, F.lit("-01")), "yyyy-MM-dd"))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))
    )


def to_ordinal(d: Column) -> Column:
    """Days since 0001-01-01, which is 1."""
    return F.datediff(d, F.lit("0001-01-01").cast("date")) + 1


def from_ordinal(n: Column) -> Column:
    return F.date_add(F.lit("0001-01-01").cast("date"), (n - 1).cast("int"))


def is_month_end(d: Column) -> Column:
    return d == F.last_day(d)


def is_month_start(d: Column) -> Column:
    return F.dayofmonth(d) == 1


def is_quarter_start(d: Column) -> Column:
    return d == F.trunc(d, "quarter")


def is_quarter_end(d: Column) -> Column:
    return is_month_end(d) & (F.month(d) % 3 == 0)


def is_year_start(d: Column) -> Column:
    return F.dayofyear(d) == 1


def is_year_end(d: Column) -> Column:
    return (F.month(d) == 12) & (F.dayofmonth(d) == 31)


def is_week_start(d: Column) -> Column:
    """Monday."""
    return F.weekday(d) == 0


def is_week_end(d: Column) -> Column:
    """Sunday."""
    return F.weekday(d) == 6
