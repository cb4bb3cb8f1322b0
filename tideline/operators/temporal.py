"""Looking things up in time: as-of joins, last-n, alignment, barriers, spines."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.series import Series


def side_by_side(left: DataFrame, right: DataFrame, s: Series, values: Sequence[str], prefix: str = "", skip_missing: bool = False) -> tuple[DataFrame, Series, Callable[[Series], dict[str, Column]]]:
    """What as-of joins are made of: the rows of both frames (_side 0 right, 1 left), their order, and the columns to add."""
    ties = [t for t in s.tie if t in right.columns]
    l = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(_struct(right, values, s.time))})
    r = right.select(*s.keys, s.time, *ties, F.lit(0).alias("_side"), F.struct(*[F.col(v) for v in values], F.col(s.time).alias("_at")).alias("_v"))

    def found(by: Series) -> dict[str, Column]:
        w, at = by.upto(), F.last("_v", ignorenulls=True)
        pick = (lambda v: F.last(F.col(f"_v.{v}"), ignorenulls=True).over(w)) if skip_missing else (lambda v: at.over(w)[v])
        return {**{f"{prefix}{v}": pick(v) for v in values}, f"{prefix}at": pick("_at")}

    return l.unionByName(r, allowMissingColumns=True), Series(s.keys, s.time, ("_side", *ties)), found


def asof(left: DataFrame, right: DataFrame, s: Series, values: Sequence[str], skip_missing: bool = False, prefix: str = "") -> DataFrame:
    """Every left row with the newest right row at or before its time.

    Adds ``values`` of the right frame under ``prefix``, and ``{prefix}at``, the time
    they are from. skip_missing: each value is the newest that is not missing.
    Both frames share the key columns and the time column; a tiebreak orders the
    right rows of one time. One union, one shuffle and one sort: nothing is multiplied.
    """
    both, by, found = side_by_side(left, right, s, values, prefix, skip_missing)
    return both.withColumns(found(by)).where("_side = 1").select(*left.columns, *[f"{prefix}{v}" for v in values], f"{prefix}at")


def _struct(df: DataFrame, values: Sequence[str], time: str) -> str:
    parts = [f"`{v}`: {df.schema[v].dataType.simpleString()}" for v in values]
    return f"struct<{', '.join([*parts, f'`_at`: {df.schema[time].dataType.simpleString()}'])}>"


def asof_between(left: DataFrame, right: DataFrame, s: Series, values: Sequence[str], after: Column, prefix: str = "") -> DataFrame:
    """As asof, but missing where the value found is older than ``after``."""
    out = asof(left, right, s, values, prefix=prefix)
    return out.withColumns({f"{prefix}{v}": F.when(F.col(f"{prefix}at") >= after, F.col(f"{prefix}{v}")) for v in values})


def align(driver: DataFrame, source: DataFrame, s: Series, value: str, name: str) -> DataFrame:
    """The newest source value since the driver's row before; missing if there was no event.

    The first driver row of a key has the plain as-of value. A missing value is an
    event of its own. Nothing is carried forward.
    """
    out = asof(driver, source, s, [value], prefix="_a_")
    before = F.lag(s.time).over(s.ordered())
    fresh = before.isNull() | (F.col("_a_at") > before)
    return out.withColumn(name, F.when(fresh, F.col(f"_a_{value}"))).drop(f"_a_{value}", "_a_at")


def missing(shape: Sequence[int] = ()) -> Column:
    """The missing value of a shape: NULL, a vector of NULLs, or a matrix of them."""
    out = F.lit(None).cast("double")
    for n in reversed(shape):
        out = F.array_repeat(out, n)
    return out


def whole(v: Column, shape: Sequence[int] = ()) -> Column:
    """NULL in place of a vector or matrix that has a missing element (NULL or NaN) or another shape."""
    if not shape:
        return F.when(~F.isnan(v), v)
    if len(shape) == 1:
        return F.when((F.size(v) == shape[0]) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), v)
    rows = F.transform(v, lambda r: whole(r, shape[1:]))
    return F.when((F.size(v) == shape[0]) & F.forall(rows, lambda r: r.isNotNull()), v)


def asof_shaped(left: DataFrame, right: DataFrame, s: Series, value: str, shape: Sequence[int], skip_missing: bool = False, after: Column | None = None, prefix: str = "") -> DataFrame:
    """asof() for a vector or matrix: the missing value of its shape where there is none, or only one older than ``after``.

    skip_missing: the newest of which no element is missing.
    """
    if skip_missing:
        right = right.where(whole(F.col(value), shape).isNotNull())
    out = asof(left, right, s, [value], prefix=prefix)
    found = F.col(f"{prefix}{value}")
    if after is not None:
        found = F.when(F.col(f"{prefix}at") >= after, found)
    return out.withColumn(f"{prefix}{value}", F.coalesce(found, missing(shape)))


def last_n(s: Series, v: Column, n: int, shape: Sequence[int] = ()) -> Column:
    """The last n values, oldest first, filled up on the left with missing ones. shape: of a vector's or matrix's value."""
    got = F.transform(F.collect_list(F.struct(v.alias("v"))).over(s.last(n)), lambda e: F.coalesce(e["v"], missing(shape)) if shape else e["v"])
    return F.concat(F.array_repeat(missing(shape), F.lit(n) - F.size(got)), got)


def n_seen(s: Series, n: int) -> Column:
    """How many of the last n places hold a row."""
    return F.count(F.lit(1)).over(s.last(n))


def last_n_between(s: Series, v: Column, n: int, after: Column) -> Column:
    """Those of the last n values, of any type, whose time is not before ``after``."""
    got = F.collect_list(F.struct(F.col(s.time).alias("t"), v.alias("v"))).over(s.last(n))
    return F.transform(F.filter(got, lambda e: e["t"] >= after), lambda e: e["v"])


def newest(df: DataFrame, s: Series, n: int) -> DataFrame:
    """The last n rows of each key."""
    from pyspark.sql import Window

    w = Window.partitionBy(*s.keys).orderBy(*[F.col(c).desc() for c in s.order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def last_time(df: DataFrame, s: Series) -> DataFrame:
    return df.groupBy(*s.keys).agg(F.max(s.time).alias("last_t"))


def barrier(frames: Sequence[DataFrame], s: Series) -> DataFrame:
    """Rows of the times at which every frame has an event: inner joins on keys and time."""
    return reduce(lambda a, b: a.join(b, [*s.keys, s.time]), frames)


def driven_by(driver: DataFrame, others: Sequence[tuple[DataFrame, Sequence[str]]], s: Series) -> DataFrame:
    """A row for each driver row, with the others' values as of then."""
    out = driver
    for frame, values in others:
        out = asof(out, frame, s, values, prefix="_d_").withColumnsRenamed({f"_d_{v}": v for v in values}).drop("_d_at")
    return out


def spine(keys: DataFrame, start: Column, end: Column, name: str = "date", step_days: int = 1) -> DataFrame:
    """A row for each key and day from start to end, both included, every ``step_days``."""
    days = F.sequence(start.cast("date"), end.cast("date"), F.make_interval(days=F.lit(step_days)))
    return keys.withColumn(name, F.explode(F.when(start <= end, days).otherwise(F.array().cast("array<date>"))))


def reindex(df: DataFrame, keys: Sequence[str], date: str, start: str, end: str) -> DataFrame:
    """One row for each key and day of [start, end]; days without data have missing values."""
    days = spine(df.select(*keys).distinct(), F.lit(start).cast("date"), F.lit(end).cast("date"), date)
    inside = df.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return days.join(inside, [*keys, date], "left")
