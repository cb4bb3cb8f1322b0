"""Gates (which rows fire) and the cutting of a run into batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import dates
from tideline.series import Series

GATES = {
    "month_end": dates.is_month_end,
    "month_start": dates.is_month_start,
    "quarter_end": dates.is_quarter_end,
    "quarter_start": dates.is_quarter_start,
    "year_end": dates.is_year_end,
    "year_start": dates.is_year_start,
    "week_end": dates.is_week_end,
    "week_start": dates.is_week_start,
}


def on(df: DataFrame, gate: str, date: str) -> DataFrame:
    """Rows whose date meets a calendar gate."""
    return df.where(GATES[gate](F.col(date)))


def not_missing(df: DataFrame, v: str) -> DataFrame:
    """Rows with a value, neither NULL nor NaN."""
    return df.where(F.col(v).isNotNull() & ~F.isnan(v))


def sign_change(df: DataFrame, s: Series, v: str) -> DataFrame:
    """Rows whose value and the row's before have strictly opposite signs."""
    return df.withColumn("_p", F.lag(v).over(s.ordered())).where(F.signum("_p") * F.signum(v) < 0).drop("_p")


def batch_ids(s: Series, size: int) -> Column:
    """Number of the batch of ``size`` events a row is in, from 0."""
    return F.floor((F.row_number().over(s.ordered()) - 1) / size)


def first_steps(df: DataFrame, s: Series, n: int) -> DataFrame:
    """The first n events of each key."""
    return df.withColumn("_n", F.row_number().over(s.ordered())).where(F.col("_n") <= n).drop("_n")


def split_ids(s: Series, stop: Column, ahead: bool = False) -> Column:
    """Number of the batch that ends with a row where ``stop`` holds, from 0.

    ahead: the batch ends before that row, which begins the next one; a key's first
    row begins its first batch, whether ``stop`` holds or not.
    """
    hit = F.when(stop, 1).otherwise(0)
    if ahead:
        return F.sum(hit).over(s.upto()) - F.first(hit).over(s.upto())
    return F.coalesce(F.sum(hit).over(s.before()), F.lit(0))


def until(df: DataFrame, s: Series, stop: Column) -> DataFrame:
    """Rows up to the first time at which ``stop`` holds, that time's other rows included."""
    from pyspark.sql import Window

    first = F.min(F.when(stop, F.col(s.time))).over(Window.partitionBy(*s.keys))
    return df.withColumn("_f", first).where(F.col("_f").isNull() | (F.col(s.time) <= F.col("_f"))).drop("_f")
