"""Series that are too long for one task, cut into stretches of even size.

Windows keep a key's rows in one task. Where a few keys hold much of a table, the
rows are dealt out by ranges of (key, time, tiebreak) instead, so that a long
series spans several blocks; each block gets the few rows before it that its
windows look back on, and windows are then taken over (key, block).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.folders import shared_dir
from tideline.operators import fold
from tideline.operators.temporal import side_by_side
from tideline.series import Series


def over_blocks(df: DataFrame, s: Series, lookback: int, fn: Callable[[DataFrame, Series], DataFrame], blocks: int, counted: Column | None = None) -> DataFrame:
    """fn(df, series) for windows that look back on at most ``lookback`` rows, evenly dealt.

    fn gets rows and a series to take windows over, and returns the rows it got
    with columns added. counted: which rows the lookback counts (all); rows for
    which it does not hold are not handed on, so a value's newest row or a join's
    right side is found however far back it is. The order of (key, time, tiebreak)
    should be total, as elsewhere.

    The dealt rows are written to the shared folder. What is handed on is at most
    ``lookback`` rows for each block.
    """
    spark, keys = df.sparkSession, list(s.keys)
    path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(blocks, *keys, *s.order).withColumns({"_block": F.spark_partition_id(), "_counted": F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))})
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    # Only a range's first and last key can be in another range too: one row for each block at most, or two.
    stretches = _stretches(dealt.groupBy(*keys, "_block").agg(F.sum(F.col("_counted").cast("long")).alias("_n")), keys)
    of_key = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    full = F.count(F.when(F.col("_n") > 0, 1))  # blocks without counted rows leave all open
    stretches = stretches.withColumns({"_to": F.sum("_n").over(of_key.orderBy("_b")), "_e": full.over(of_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))})
    # the blocks after one, and how many of its newest rows those between leave open to each of them
    after = F.collect_list(F.struct("_b", (F.col("_to") - F.col("_n")).alias("_before"))).over(of_key.orderBy("_e").rangeBetween(1, lookback))
    wants = stretches.withColumn("_after", after).select("*", F.explode("_after").alias("_w"))
    wants = wants.withColumn("_open", F.lit(lookback) - (F.col("_w._before") - F.col("_to"))).where("_open > 0 and _n > 0")
    wants = wants.select(*[f"_k{i}" for i in range(len(keys))], F.col("_b").alias("_from"), F.col("_w._b").alias("_for"), "_open")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    newest = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*[F.col(c).desc() for c in s.order]))
    sources = wants.groupBy(*[f"_k{i}" for i in range(len(keys))], F.col("_from").alias("_b")).agg(F.max("_open").alias("_most"))
    tails = (
        dealt.where("_counted")
        .join(F.broadcast(sources), [*same, F.col("_block") == F.col("_b")])
        .withColumn("_r", newest)
        .where(F.col("_r") <= F.col("_most"))
        .select(*[F.col(f"`{c}`") for c in df.columns], "_block", "_r")
    )
    handed = tails.join(wants, [*same, F.col("_block") == F.col("_from"), F.col("_r") <= F.col("_open")])
    handed = handed.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_for").alias("_block"), F.lit(True).alias("_handed"))
    rows = dealt.drop("_counted").withColumn("_handed", F.lit(False)).unionByName(handed)
    return fn(rows, Series((*s.keys, "_block"), s.time, s.tie)).where("not _handed").drop("_block", "_handed")


def _stretches(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Those of (keys, _block, ...) whose key is in several blocks, as _k0, ..., _b, ...: two for each block at most."""
    many = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rest = [c for c in groups.columns if c not in keys and c != "_block"]
    return groups.withColumn("_many", many).where("_many > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), *rest)


def mean_ew(df: DataFrame, s: Series, name: str, v: str, blocks: int, span: float | None = None, alpha: float | None = None) -> DataFrame:
    """fold.mean_ew over series of any length, evenly dealt: no row's weight is cut off.

    In a block the mean is an affine map of what came in: its slope is a power of the
    number of values, its constant the mean from zero. Blocks' maps are composed in
    the order of a key's blocks, and each row takes what came in to its block. The
    rows with their maps are written to the shared folder.
    """
    return _affine(df, s, name, F.col(v), fold.alpha_of(span, alpha), blocks, lambda p: p)


def rms_ew(df: DataFrame, s: Series, name: str, v: str, blocks: int, span: float | None = None, alpha: float | None = None, b: float = 1.0) -> DataFrame:
    """fold.rms_ew over series of any length, as mean_ew() of the squares."""
    x = F.col(v)
    return _affine(df, s, name, x * x, fold.alpha_of(span, alpha), blocks, lambda p: F.when(x.isNotNull(), F.sqrt(p) * b))


def _affine(df: DataFrame, s: Series, name: str, x: Column, a: float, blocks: int, finish: Callable[[Column], Column]) -> DataFrame:
    spark, keys = df.sparkSession, list(s.keys)
    path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(blocks, *keys, *s.order).withColumns({"_block": F.spark_partition_id(), "_x": x})
    maps = [fold.mean_ew("_own", "_x", alpha=a), fold.mean_ew_from("_zero", "_x", a, 0.0), fold.count_of("_count", "_x")]
    fold.fold(dealt, Series((*s.keys, "_block"), s.time, s.tie), maps).write.parquet(path)
    rows = spark.read.parquet(path)
    end = F.max_by(F.struct("_own", "_zero", "_count"), F.struct(*s.order))
    ends = _stretches(rows.groupBy(*keys, "_block").agg(end.alias("_end")), keys)
    mine = [f"_k{i}" for i in range(len(keys))]
    ends = ends.select(*mine, "_b", F.col("_end._own").alias("_o"), F.col("_end._zero").alias("_z"), F.col("_end._count").alias("_c"))

    def carry(p, own, zero, count):
        after = p if own is None else own if p is None else (1.0 - a) ** count * p + zero
        return after, p

    came = fold.fold(ends, Series(tuple(mine), "_b"), [fold.Recurrence("_in", ("_o", "_z", "_c"), carry)]).select(*mine, "_b", "_in")
    same = [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, mine)]
    out = rows.join(F.broadcast(came), [*same, F.col("_block") == F.col("_b")], "left")
    p = F.when(F.col("_in").isNull(), F.col("_own")).when(F.col("_own").isNull(), F.col("_in")).otherwise(F.pow(F.lit(1.0 - a), F.col("_count")) * F.col("_in") + F.col("_zero"))
    return out.withColumn(name, finish(p)).select(*df.columns, name)


def asof(left: DataFrame, right: DataFrame, s: Series, values: Sequence[str], blocks: int, prefix: str = "") -> DataFrame:
    """temporal.asof where a few keys hold much of either frame: equal rows, evenly dealt."""
    both, by, found = side_by_side(left, right, s, values, prefix)
    out = over_blocks(both, by, 1, lambda d, b: d.withColumns(found(b)), blocks, F.col("_side") == 0)
    return out.where("_side = 1").select(*left.columns, *[f"{prefix}{v}" for v in values], f"{prefix}at")
