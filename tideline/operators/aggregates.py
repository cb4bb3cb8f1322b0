"""Aggregates of one's own over the newest rows of a series."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from tideline.series import Series


def over_last(s: Series, fn: Callable, n: int, *columns: Column, type: str = "double", **params: object) -> Column:
    """fn(arrays, **params) of the newest n rows: one numpy array for each column, oldest first, missing values NaN; None is missing.

    A grouped aggregate over a row frame: Spark sends a key's rows once, as Arrow,
    and frames are slices of them.
    """

    def call(*arrays: pa.Array) -> object:
        return fn(*(a.cast(pa.float64()).to_numpy(zero_copy_only=False) for a in arrays), **params)

    return F.arrow_udf(call, type, ArrowUDFType.GROUPED_AGG)(*columns).over(s.last(n))


def trimmed_mean(v, cut: int = 1) -> float | None:
    """The mean without the ``cut`` least and the ``cut`` greatest values; missing where nothing is left."""
    v = sorted(v[v == v])
    v = v[cut : len(v) - cut]
    return float(sum(v) / len(v)) if len(v) else None
