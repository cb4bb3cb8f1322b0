"""Windows over blocks of hot series equal windows over whole series."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import blocks, fold, rolling, temporal
from tideline.series import Series

S = Series.of("key", "t")


@pytest.fixture(scope="module")
def hot(spark):
    r = random.Random(4)
    rows = [(0, t, None if r.random() < 0.3 else r.random()) for t in range(700)]
    rows += [(None, t, float(t)) for t in range(90)]
    rows += [(k, t, r.random()) for k in range(1, 40) for t in range(r.randint(1, 9))]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "key long, t long, v double").repartition(5).cache()


def rows(df):
    return sorted((tuple(None if x is None else round(x, 9) for x in r) for r in df.select("key", "t", "r").collect()), key=repr)


@pytest.mark.parametrize("n, parts", [(2, 4), (5, 16), (40, 64), (5, 1)])
def test_rolling(hot, n, parts):
    fn = lambda d, s: d.withColumn("r", rolling.mean(s, F.col("v"), n))
    got = blocks.over_blocks(hot, S, n - 1, fn, parts)
    assert got.columns == [*hot.columns, "r"]
    assert rows(got) == rows(fn(hot, S))


@pytest.mark.parametrize("parts", [3, 200])
def test_newest_value(hot, parts):
    """Gaps longer than a block: the newest value is handed on over all of them."""
    gap = hot.withColumn("v", F.when(F.col("t") % 97 == 0, F.col("v")))
    fn = lambda d, s: d.withColumn("r", rolling.abs_change(s, F.col("v")))
    assert rows(blocks.over_blocks(gap, S, 1, fn, parts, F.col("v").isNotNull())) == rows(fn(gap, S))


def test_asof(hot):
    left, right = hot.where("t % 3 = 0").select("key", "t"), hot.where("t % 50 = 1")
    want = temporal.asof(left, right, S, ["v"]).withColumnRenamed("v", "r")
    got = blocks.asof(left, right, S, ["v"], 32).withColumnRenamed("v", "r")
    assert got.columns == want.columns and rows(got) == rows(want)


def test_ew(hot):
    recs = [fold.mean_ew("r", "v", span=3)]
    got = blocks.over_blocks(hot, S, fold.memory(span=3), lambda d, s: fold.fold(d, s, recs), 12, F.col("v").isNotNull())
    assert rows(got) == rows(fold.fold(hot, S, recs))
    assert fold.memory(alpha=1.0) == 1 and (1 - 0.5) ** fold.memory(span=3) <= 1e-17


def test_rows_are_even(hot):
    parts = blocks.over_blocks(hot, S, 2, lambda d, s: d.withColumn("n", F.count(F.lit(1)).over(s.last(1))).withColumn("p", F.col("_block")), 16)
    assert max(r["count"] for r in parts.groupBy("p").count().collect()) < 150
    assert blocks.over_blocks(hot.where("false"), S, 2, lambda d, s: d, 4).count() == 0


def test_affine_blocks(spark):
    """EW mean and rms of a hot series by composed maps, with blocks that have no value at all."""
    data = [(k, t, None if (t // 40) % 3 == 1 or t % 7 == 0 else float(t % 23 - 11)) for k, n in ((1, 900), (2, 3), (3, 150), (None, 60)) for t in range(n)]
    df = spark.createDataFrame(data, "key long, t long, v double").repartition(5)
    s = Series.of("key", "t")
    recs = [fold.mean_ew("m", "v", span=500), fold.rms_ew("q", "v", span=90, b=2.0)]
    want = {(r["key"], r["t"]): (r["m"], r["q"]) for r in fold.fold(df, s, recs).collect()}
    means, roots = (f(df, s, "r", "v", 40, span=n, **more) for f, n, more in ((blocks.mean_ew, 500, {}), (blocks.rms_ew, 90, {"b": 2.0})))
    for i, got in enumerate((means, roots)):
        got = {(r["key"], r["t"]): r["r"] for r in got.collect()}
        assert got.keys() == want.keys()
        assert all((a := want[k][i]) is None and got[k] is None or abs(a - got[k]) < 1e-9 for k in want)


def test_lookback_over_many_small_blocks(spark):
    """A lookback over more rows than a block has: from each block only what those after it leave open."""
    df = spark.range(400).select(F.lit(1).alias("key"), F.col("id").alias("t"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("v")).repartition(3)
    s = Series.of("key", "t")
    last = lambda d, b: d.withColumn("x", F.sum("v").over(b.last(61))).withColumn("n", F.count(F.lit(1)).over(b.last(61)))
    want = sorted(map(tuple, last(df, s).collect()))
    assert sorted(map(tuple, blocks.over_blocks(df, s, 60, last, 50).collect())) == want
