"""Daily bars: delimited files, archives, one frame of (symbol, date, fields)."""

from __future__ import annotations

import io
import math
import os
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.temporal import reindex

FIELDS = ("open", "high", "low", "close", "volume", "open_interest")
SCHEMA = "date date, open double, high double, low double, close double, volume double, open_interest double"


def bars_dir(path: str | None = None) -> str:
    """The folder of bar files: given, or named by TIDELINE_BARS."""
    found = path or os.environ.get("TIDELINE_BARS")
    if not found:
        raise ValueError("no folder of bars is named")
    return found


def read_csv(spark: SparkSession, path: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Headerless files of date, open, high, low, close[, volume[, open interest]]; symbol is the file's name."""
    df = spark.read.schema(SCHEMA).option("dateFormat", date_format).csv(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return df.select(name.alias("symbol"), *df.columns)


def read_zips(spark: SparkSession, path: str, pattern: str = "", one: bool = False) -> DataFrame:
    """The same rows from delimited members of zip archives whose name holds ``pattern``.

    one: each archive must have exactly one such member.
    """
    schema = f"symbol string, {SCHEMA}"

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for body in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    members = [m for m in z.namelist() if pattern in m and not m.endswith("/")]
                    if one and len(members) != 1:
                        raise ValueError(f"{len(members)} members hold {pattern!r}, not one")
                    for member in members:
                        rows = pd.read_csv(z.open(member), header=None)
                        rows = rows.reindex(columns=range(7)).set_axis(["date", *FIELDS], axis=1)
                        rows["date"] = pd.to_datetime(rows["date"]).dt.date
                        rows.insert(0, "symbol", os.path.splitext(os.path.basename(member))[0])
                        yield rows.astype({f: "float64" for f in FIELDS})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, schema)


#: What tells a table of bars apart, besides its days.
IDENTIFIER = ("product", "symbol", "adjust", "expiry", "fx", "source")


def identify(bars: DataFrame, **given: str | None) -> DataFrame:
    """``bars`` with all columns of the identifier: given, there already, or NULL."""
    if unknown := set(given) - set(IDENTIFIER):
        raise TypeError(f"no part of an identifier: {sorted(unknown)}")
    return bars.withColumns({c: F.lit(given.get(c)).cast("string") for c in IDENTIFIER if c in given or c not in bars.columns})


#: Folders of a store, at most about; identifiers beyond that share folders, so many for each value of the other parts.
MOST_FOLDERS, BUCKETS = 1_000, 64
_BUCKET = "bucket"


def _bucket(parts: Sequence[Column]) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def _folders(bars: DataFrame, by: Sequence[str]) -> list[str]:
    """Those parts that have a folder for each value: all, or as many as leave room for buckets of the others."""
    counts = bars.agg(*[F.approx_count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in by]).first().asDict()
    if math.prod(counts.values()) <= MOST_FOLDERS:
        return list(by)
    kept, n = [], BUCKETS
    for c in sorted(by, key=counts.__getitem__):
        n *= counts[c]
        if n > MOST_FOLDERS:
            break
        kept.append(c)
    return [c for c in by if c in kept]


def write_bars(bars: DataFrame, path: str, by: Sequence[str] = ("symbol",)) -> None:
    """Parquet by symbol, or by other parts of the identifier, so that reading one opens its folder alone.

    Where these have more values than MOST_FOLDERS, files and folders would cost more
    than what is in them: parts of few values keep their folders, the others share
    BUCKETS of them by hash, sorted, so reading one opens its bucket and in it
    the row groups that can hold it. Rows are dealt by ranges of folder, identifier and
    day: a task writes few folders, and a long one is written by several tasks.
    """
    folders = _folders(bars, by)
    rest = [c for c in by if c not in folders]
    if rest:
        bars, folders = bars.withColumn(_BUCKET, _bucket([F.col(c) for c in rest])), [*folders, _BUCKET]
    order = [*folders, *rest, "date"]
    bars.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(*folders).parquet(path)


def _levels(spark: SparkSession, path: str) -> list[str]:
    """The columns that a store's folders stand for."""
    at, out = spark._jvm.org.apache.hadoop.fs.Path(path), []
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    while at is not None:
        found = [f.getPath() for f in system.listStatus(at) if f.isDirectory() and "=" in f.getPath().getName()]
        at = found[0] if found else None
        if at is not None:
            out.append(at.getName().split("=")[0])
    return out


def read_bars(
    spark: SparkSession, path: str, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None, by: Sequence[str] = ("symbol",), where: Mapping[str, str | None] | None = None
) -> DataFrame:
    """Bars of some symbols and days; all conditions reach the files.

    by: as written. where: values of parts of the identifier, None for a missing one.
    With either, the result has the whole identifier.
    """
    whole = tuple(by) != ("symbol",) or where is not None
    kept = [c for c in IDENTIFIER if whole or c == "symbol"]
    levels = _levels(spark, path)
    df = spark.read.schema(", ".join([SCHEMA, *(f"{c} string" for c in kept), *([f"{_BUCKET} int"] if _BUCKET in levels else [])])).parquet(path)
    wanted = {c: [v] for c, v in (where or {}).items()}
    if symbols is not None:
        df = df.where(F.col("symbol").isin(*symbols))
        wanted.setdefault("symbol", list(symbols))
    for c, v in (where or {}).items():
        df = df.where(F.col(c).eqNullSafe(F.lit(v)))
    rest = [c for c in by if c not in levels]
    if _BUCKET in levels and all(c in wanted for c in rest):
        df = df.where(F.col(_BUCKET).isin(*[_bucket([F.lit(v).cast("string") for v in values]) for values in product(*(wanted[c] for c in rest))]))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df.select(*kept, "date", *FIELDS)


def modified_since(spark: SparkSession, path: str, since: str) -> DataFrame:
    """Files under ``path`` that were modified after ``since``: path, time and length."""
    return spark.read.format("binaryFile").option("modifiedAfter", since).option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def daily_bars(days: DataFrame, bars: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """``days`` (symbol, date) with a vector of fields; days without any field are absent."""
    got = days.join(bars, ["symbol", "date"])
    return got.where(F.coalesce(*[F.col(f) for f in FIELDS]).isNotNull()).select("symbol", "date", F.array(*fields).alias("v"))


def daily_field(days: DataFrame, bars: DataFrame, field: str) -> DataFrame:
    return daily_bars(days, bars, [field]).select("symbol", "date", F.get("v", F.lit(0)).alias("v"))


def on_calendar(bars: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each symbol and calendar day."""
    return reindex(bars, ["symbol"], "date", start, end)


def bars_of(ticks: DataFrame, key: str, time: str, tie: str, value: str) -> DataFrame:
    """Open, high, low and close of each key and day."""
    at = F.struct(time, tie)
    return ticks.groupBy(key, F.to_date(time).alias("date")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(F.lit(1)).alias("n")
    )
