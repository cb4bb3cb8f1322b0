"""Documented sequences: seeded walks through every operator, to two places."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import scalar, vectors
from tideline.operators import factors, fold, rolling, signals, temporal
from tideline.series import Series

S = Series.of("key", "t")


def noise(k, mean=0.0, walk=False, n=5):
    r = np.random.default_rng(0)
    x = r.normal(mean, 1.0, (n, k))
    return np.cumsum(x, axis=0) if walk else x


def frame(spark, cols):
    names = list(cols)
    return spark.createDataFrame([(0, i, *(float(cols[c][i]) for c in names)) for i in range(len(cols[names[0]]))], ["key", "t", *names])


def got(df, c="r"):
    return [None if x[0] is None else round(x[0], 2) + 0.0 for x in df.orderBy("t").select(c).collect()]


def same(have, want):
    assert [x if x is None else pytest.approx(x, abs=0.0101) for x in want] == have


def walk1(spark, mean):
    return frame(spark, {"v": noise(1, mean, True)[:, 0]})



@pytest.mark.parametrize(
    "mean, fn, want",
    [
        (1, lambda v: rolling.sum_(S, v, 3), [1.13, 3.12, 6.75, 10.37, 13.58]),
        (1, lambda v: rolling.mean(S, v, 3), [1.13, 1.56, 2.25, 3.46, 4.53]),
        (1, lambda v: rolling.std(S, v, 3), [0, 0.43, 1.04, 1.13, 0.66]),
        (1, lambda v: rolling.rms(S, v, 3), [1.13, 1.62, 2.48, 3.63, 4.57]),
        (0.2, lambda v: rolling.max_(S, v, 3), [0.33, 0.39, 1.23, 1.54, 1.54]),
        (-0.2, lambda v: rolling.min_(S, v, 3), [-0.07, -0.41, -0.41, -0.41, -0.80]),
        (-0.2, lambda v: rolling.skew(S, v, 3), [None, None, -0.53, -0.58, -0.67]),
        (-0.2, lambda v: rolling.kurtosis(S, v, 3), [None, None, -1.5, -1.5, -1.5]),
        (-0.2, lambda v: rolling.quantile(S, v, 0.5, 3), [-0.07, -0.24, -0.07, -0.06, -0.06]),
        (0, lambda v: rolling.abs_change(S, v), [None, -0.13, 0.64, 0.10, -0.54]),
        (1, lambda v: rolling.pct_change(S, v), [None, 0.77, 0.82, 0.30, 0.10]),
        (0, scalar.signed_sqrt, [0.35, -0.08, 0.80, 0.86, 0.45]),
        (0, scalar.signed_sq, [0.02, 0, 0.40, 0.55, 0.04]),
        (1, lambda v: signals.pos_simple(S, v), [None, 0.50, 0.28, 0.21, 0.19]),
    ],
)
def test_walks(spark, mean, fn, want):
    same(got(walk1(spark, mean).withColumn("r", fn(F.col("v")))), want)


def test_cumulative(spark):
    df = frame(spark, {"v": noise(1)[:, 0]})
    same(got(df.withColumn("r", rolling.cum_sum(S, F.col("v")))), [0.13, -0.01, 0.63, 0.74, 0.20])
    same(got(df.withColumn("r", rolling.cum_prod(S, F.col("v"), 1.0))), [1.13, 0.98, 1.60, 1.77, 0.82])


@pytest.mark.parametrize(
    "mean, recs, want",
    [
        (1, [fold.mean_ew("r", "v", span=4)], [1.13, 1.47, 2.34, 3.30, 4.06]),
        (1, [fold.mean_ew("m", "v", span=4), fold.std_ew("r", "v", "m", span=4)], [0, 0.33, 0.86, 1.13, 1.13]),
        (1, [fold.rms_ew("r", "v", span=4)], [1.13, 1.53, 2.59, 3.61, 4.32]),
        (0.2, [fold.mean_ew("m", "v", span=4), fold.max_ew("r", "v", "m", span=4)], [0.33, 0.39, 1.23, 1.54, 1.37]),
        (-0.2, [fold.mean_ew("m", "v", span=4), fold.min_ew("r", "v", "m", span=4)], [-0.07, -0.41, -0.29, -0.21, -0.80]),
    ],
)
def test_recurrences(spark, mean, recs, want):
    same(got(fold.fold(walk1(spark, mean), S, recs)), want)


def test_crossover(spark):
    df = fold.fold(walk1(spark, 1), S, [fold.xo_mean_ew_rms_ew("x", "v", 4, 12, 6)])
    want = [(0, 1.13, 1.13, 1.13), (0.20, 1.47, 1.26, 1.06), (0.57, 2.34, 1.62, 1.25), (0.99, 3.30, 2.10, 1.21), (1.40, 4.06, 2.58, 1.05)]
    for i, c in enumerate(("xo", "fast", "slow", "vol")):
        same(got(df.withColumn("r", F.col(f"x.{c}"))), [w[i] for w in want])


def test_pairs(spark):
    x = noise(2)
    df = frame(spark, {"l": x[:, 0], "r_": x[:, 1]})
    l, r = F.col("l"), F.col("r_")
    for fn, want in [
        (rolling.cov(S, l, r, 3), [0, 0.03, -0.06, 0.15, 0.64]),
        (scalar.truncate(l, r), [0.13, 0.64, -0.54, 1.30, -0.70]),
        (scalar.ratio(l, r), [-0.95, 6.11, -1.48, 1.38, 0.56]),
        (scalar.pct_diff(l, r), [-1.95, 5.11, -2.48, 0.38, -0.44]),
        (scalar.subtract(l, r), [0.26, 0.54, -0.90, 0.36, 0.56]),
        (scalar.add(l, r), [-0.01, 0.75, -0.17, 2.25, -1.97]),
    ]:
        same(got(df.withColumn("r", fn)), want)


def test_correlation_and_beta(spark):
    x = noise(2, 1, True)
    df = frame(spark, {"a": x[:, 0], "b": x[:, 1]})
    a, b = F.col("a"), F.col("b")
    c = scalar.corr(rolling.cov(S, a, b, 3), rolling.std(S, a, 3), rolling.std(S, b, 3))
    same(got(df.withColumn("r", c)), [None, 1.00, 0.93, 0.97, 0.97])
    same(got(df.withColumn("r", scalar.beta(c, rolling.std(S, a, 3), rolling.std(S, b, 3)))), [None, 1.48, 0.83, 0.86, 1.31])


def test_range_and_vectors(spark):
    x = noise(3)
    df = frame(spark, {c: x[:, i] for i, c in enumerate("lrv")}).withColumnRenamed("r", "r_")
    same(got(df.withColumn("r", scalar.norm_range_pct(F.col("l"), F.col("r_"), F.col("v")))), [-2.00, -0.40, 5.63, 2.03, 0.51])
    one = df.where("t = 0").withColumn("x", F.array("l", "r_", "v"))
    same(got(one.withColumn("r", vectors.mean_vec(F.col("x")))), [0.21])
    same(got(one.withColumn("r", vectors.sum_vec(F.col("x")))), [0.63])
    v = spark.range(1).select(F.array(F.lit(1.30), F.lit(0.95), F.lit(-0.70)).alias("x"), F.array(*[F.lit(float(c)) for c in x[0]]).alias("y"))
    mid, pct, inner = v.select(vectors.norm_mid_vec(F.col("x")), vectors.norm_mid_pct_vec(F.col("x")), vectors.norm_mid_inner_vec(F.col("y"))).first()
    assert mid == pytest.approx([0.18, -0.18, -1.83], abs=0.01)
    assert pct == pytest.approx([0.16, -0.16, -1.63], abs=0.01)
    assert inner == pytest.approx([0.5, -0.5, 2.5], abs=0.05)


def test_products(spark):
    x = noise(2, -0.2, True)
    df = frame(spark, {"a": x[:, 0], "b": x[:, 1]}).withColumn("v", F.array("a", "b"))
    same(got(df.withColumn("r", vectors.dot(F.col("v"), F.col("v")))), list(np.round((x * x).sum(axis=1), 2)))
    same(got(df.withColumn("r", vectors.v_x_vec_i(F.col("a"), F.col("v"), 0))), list(np.round(x[:, 0] ** 2, 2)))


def test_pnl(spark):
    df = walk1(spark, 1).withColumn("pos", signals.pos_simple(S, F.col("v")))
    same(got(df.withColumn("r", signals.pnl_linear(S, F.col("pos"), F.col("v")))), [None, None, 0.82, 0.30, 0.10])


def test_pca(spark):
    x = noise(2)
    df = frame(spark, {"a": x[:, 0], "b": x[:, 1]}).withColumn("p", factors.pca(S, F.array("a", "b"), 3, 1))
    same(got(df.withColumn("r", F.get("p.e", F.lit(0)))), [None, 0.66, 0.86, 1.74, 2.12])
    rows = [r.u for r in df.orderBy("t").select(F.col("p.u").alias("u")).collect()]
    for u, w in zip(rows[1:], [(0.99, 0.12), (-0.97, 0.24), (-0.87, -0.49), (-0.69, -0.72)]):
        assert [abs(r[0]) for r in u] == pytest.approx(np.abs(w), abs=0.01)


def test_align(spark):
    """A daily driver against calendars of every second and every third day."""
    day = lambda i: dt.date(2025, 1, 1) + dt.timedelta(i)
    driver = spark.createDataFrame([(0, day(i)) for i in range(5)], ["key", "d"])
    s = Series.of("key", "d")
    for step, want in ((2, [1, None, 3, None, 5]), (3, [1, None, None, 4, None])):
        source = spark.createDataFrame([(0, day(i), day(i)) for i in range(0, 5, step)], ["key", "d", "v"])
        out = temporal.align(driver, source, s, "v", "r").orderBy("d").collect()
        assert [r.r and r.r.day for r in out] == want


def test_asof_boundaries(spark):
    t = [float(x) for x in np.linspace(0, 8, 8)]
    right = spark.createDataFrame([(0, x, x) for x in t], ["key", "t", "v"])
    left = spark.createDataFrame([(0, x) for x in (-1.0, 0.0, 1.0, t[1], 8.0, 9.0)], ["key", "t"])
    out = temporal.asof(left, right, S, ["v"]).orderBy("t").collect()
    assert [r.v for r in out] == [None, 0.0, 0.0, t[1], 8.0, 8.0]
