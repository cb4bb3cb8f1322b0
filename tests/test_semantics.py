"""Missing values, order independence, gates, tables, sources, pipelines and streams."""

import datetime as dt
import tempfile
import time
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline import queries
from tideline.functions import dates
from tideline.operators import factors, fold, rolling, temporal, triggers
from tideline.plans.pipeline import Pipeline, compile_rows, parse_cell, plot_axes, signatures
from tideline.series import Series, canonical
from tideline.sources import bars, gaps, generators, tables
from tideline.streaming import stateful

S = Series.of("key", "t")
ROWS = [(k, i, None if (i + k) % 4 == 0 else float((i * 7 + k) % 11)) for k in range(3) for i in range(30)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "key long, t long, v double")


def by_t(df, key=1):
    return [r.r for r in df.where(F.col("key") == key).orderBy("t").collect()]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(0, 0, float("nan")), (0, 1, 2.0)], ["key", "t", "v"])
    assert [r.v for r in canonical(df, ["key"], "t", "v").orderBy("t").collect()] == [None, 2.0]


def test_prev_skips_missing(spark):
    v = {(k, t): x for k, t, x in ROWS}
    out = by_t(frame(spark).withColumn("r", rolling.abs_change(S, F.col("v"))))
    last = None
    for t, r in enumerate(out):
        x = v[1, t]
        assert r == (x - last if x is not None and last is not None else None)
        last = x if x is not None else last


@pytest.mark.parametrize("n", [1, 4])
def test_rows_and_partitions_do_not_matter(spark, n):
    df = frame(spark)
    other = frame(spark, ROWS[::-1]).repartition(7)
    recs = [fold.mean_ew("m", "v", span=3), fold.max_ew("x", "v", "m", span=3)]
    for make in (lambda d: d.withColumn("r", rolling.mean(S, F.col("v"), n)), lambda d: fold.fold(d, S, recs).withColumn("r", F.coalesce("x", "m"))):
        assert by_t(make(df)) == by_t(make(other))


def test_fold_carries_state_over_batches(spark):
    """The state of a series lives across Arrow batches."""
    df = frame(spark, [(0, i, float(i % 13)) for i in range(500)])
    want = pd.Series([float(i % 13) for i in range(500)]).ewm(alpha=0.4, adjust=False).mean()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert by_t(fold.fold(df, S, [fold.mean_ew("r", "v", span=4)]), 0) == pytest.approx(list(want))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_window_of_one_is_identity(spark):
    assert by_t(frame(spark).withColumn("r", rolling.mean(S, F.col("v"), 1))) == [x for k, _, x in ROWS if k == 1]


def test_alpha_must_agree():
    assert fold.alpha_of(span=4, alpha=0.4) == 0.4
    with pytest.raises(ValueError):
        fold.alpha_of(span=4, alpha=0.5)


def test_position_rules(spark):
    day = lambda i: dt.date(2024, 1, 14) + dt.timedelta(i)
    rows = [(0, i, 2.0 + i, s, day(i)) for i, s in enumerate([0.0, 0.4, 0.45, 0.6, 0.55, -1.0, 9.0])]
    df = spark.createDataFrame(rows, ["key", "t", "px", "sig", "d"])
    out = [r.p for r in fold.fold(df, S, [fold.pos_linear("p", "px", "d", "sig", upper=0.5, lower=-0.5, freq="D15")]).orderBy("t").collect()]
    assert out[0].pos is None
    assert [r.sig for r in out[1:]] == [0.4, 0.4, 0.6, 0.6, -1.0, 3.0]  # held, crossed, cut to three
    assert [r.scl for r in out[1:]] == [3.0] * 6  # the 15th is the second day


def test_positions_go_on_by_parts(spark):
    """A missing signal or scale keeps its own former value; crossings come from beyond the bound."""
    none = None
    rows = [(0, i, px, sig) for i, (px, sig) in enumerate([(2.0, 1.0), (2.0, 1.0), (4.0, none), (none, 2.0), (5.0, 0.5), (5.0, 0.7), (5.0, 0.4), (5.0, 0.7)])]
    df = spark.createDataFrame(rows, "key long, t long, px double, sig double")
    simple = [r.p for r in fold.fold(df, S, [fold.pos_linear("p", "px", signal="sig")]).orderBy("t").collect()]
    assert [r.pos and round(r.pos, 9) for r in simple] == [None, 0.5, 0.25, 0.5, 0.1, 0.14, 0.08, 0.14]
    upper = [r.p.sig for r in fold.fold(df, S, [fold.pos_linear("p", "px", signal="sig", upper=0.5)]).orderBy("t").collect()]
    assert upper == [None] + [1.0] * 7  # never below the bound while held
    at = spark.createDataFrame([(0, i, 1.0, x) for i, x in enumerate([0.0, 0.5, 0.9, 0.2, 0.9])], "key long, t long, px double, sig double")
    assert [r.p.sig for r in fold.fold(at, S, [fold.pos_linear("p", "px", signal="sig", upper=0.5)]).orderBy("t").collect()] == [None, 0.5, 0.5, 0.5, 0.5]


def test_covariance_of_large_values(spark):
    df = spark.createDataFrame([(0, i, 1e9 + i, 2e9 - i) for i in range(10)], "key long, t long, a double, b double")
    out = df.withColumns({"v": rolling.cov(S, F.col("a"), F.col("a"), 5), "w": rolling.cov(S, F.col("a"), F.col("b"), 5), "g": rolling.cov(S, F.col("a"), F.col("a"), 5, F.lit(1e9), F.lit(1e9))}).orderBy("t").collect()
    assert [(r.v, r.w) for r in out[4:]] == [(2.0, -2.0)] * 6 and out[4].g == 6.0


def test_factors_against_numpy(spark):
    """Loadings of rolling factors, weighted and held, and a Gaussian process on several points."""
    r = np.random.default_rng(3)
    rows = [(0, i, r.normal(size=3).tolist() if i % 9 else [1.0, None, 2.0], float(r.normal()) if i % 4 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "key long, t long, x array<double>, y double")
    w = [0.5, 1.0, 1.0, 2.0, 3.0, 4.0]
    df = df.withColumns({"p": factors.pca(S, F.col("x"), 6, 2), "c": factors.pca(S, F.col("x"), 6, 2, centre=True), "b": factors.unit_norm_beta(S, F.col("x"), 6, w), "g": factors.pca(S, F.col("x"), 6, 1, gate=F.col("t") % 10 == 7)})
    df = factors.gp_regression(df.withColumn("at", F.col("t") / 2), S, "at", "y", 6, 0.7, 1.3, 0.2)
    held = None
    for o in df.orderBy("t").collect():
        frame = [(i, q[2]) for i, q in enumerate(rows[max(0, o.t - 5) : o.t + 1], 6 - min(6, o.t + 1)) if None not in q[2]]
        x = np.array([q for _, q in frame])
        if len(x) >= 3:
            for got, m in ((o.p, x), (o.c, x - x.mean(axis=0))):
                e, v = np.linalg.svd(m)[1:]
                np.testing.assert_allclose(got.e, e[:2], atol=1e-9)
                np.testing.assert_allclose(np.abs(np.array(got.u)), np.abs(v[:2].T), atol=1e-6)
                assert all(a >= 0 for a in got.u[-1])
            top = np.linalg.svd(x * np.sqrt([w[i] for i, _ in frame])[:, None])[2][0]
            np.testing.assert_allclose(o.b, top * np.sign(top[-1]), atol=1e-9)
        if o.t % 10 == 7:
            held = o.p.e[0]
        assert (o.g and round(o.g.e[0], 9)) == (held and round(held, 9))
        pts = np.array([(q[1] / 2, q[3]) for q in rows[max(0, o.t - 6) : o.t] if q[3] is not None]).reshape(-1, 2)
        k = 1.69 * np.exp(-0.5 * (pts[:, None, 0] - pts[None, :, 0]) ** 2 / 0.49) + 0.04 * np.eye(len(pts))
        ks = 1.69 * np.exp(-0.5 * (o.t / 2 - pts[:, 0]) ** 2 / 0.49)
        np.testing.assert_allclose([o.gp_mean, o.gp_var], [ks @ np.linalg.solve(k, pts[:, 1]), 1.69 - ks @ np.linalg.solve(k, ks)] if len(pts) else [0, 1.69], atol=1e-9)


def test_decomposition_page(spark, sf_dir):
    """The page's first singular value and projection, by numpy from the same means."""
    rows = queries.events(spark, sf_dir).select("user_id", "ts", "event_id", "v").collect()
    got = {r.event_id: (r.e0, r.f) for r in queries.flagship_decomp(spark, sf_dir).collect()}
    by_user = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.ts, r.event_id)):
        by_user.setdefault(r.user_id, []).append(r)
    for own in by_user.values():
        means, vectors_ = [None] * 4, []
        for r in own:
            for i, span in enumerate((2, 4, 8, 16)):
                a = 2 / (span + 1)
                means[i] = means[i] if r.v is None else r.v if means[i] is None else (1 - a) * means[i] + a * r.v
            vectors_.append(None if None in means else np.array(means) - (means[1] + means[2]) / 2)
            x = np.array([q for q in vectors_[-12:] if q is not None])
            e0, f = got[r.event_id]
            if len(x) < 4:
                assert e0 is None
                continue
            _, e, v = np.linalg.svd(x - x.mean(axis=0))
            assert e0 == pytest.approx(e[0], abs=2e-6)
            if e[0] - e[1] > 1e-3 * e[0] and abs(v[0][-1]) > 1e-6:
                assert f == pytest.approx(vectors_[-1] @ v[0] * np.sign(v[0][-1]), abs=1e-3)


def test_gates(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29),), (dt.date(2024, 12, 31),), (dt.date(2024, 4, 1),)], ["d"])
    assert triggers.on(df, "month_end", "d").count() == 2
    assert triggers.on(df, "quarter_start", "d").count() == 1
    u = frame(spark, [(0, i, x) for i, x in enumerate([1.0, -1.0, 0.0, 2.0, None, -3.0])])
    assert [r.t for r in triggers.sign_change(u, S, "v").collect()] == [1]
    assert triggers.not_missing(u, "v").count() == 5
    assert triggers.until(u, S, F.col("v") == 0).count() == 3


def test_parse_dates(spark):
    df = spark.createDataFrame([(x,) for x in ("2024", "20240203", "2024-02", "2024-02-03", "x", "2024-02-31")], ["s"])
    assert [r.d and str(r.d) for r in df.select(dates.parse_date(F.col("s")).alias("d")).collect()] == ["2024-01-01", "2024-02-03", "2024-02-01", "2024-02-03", None, None]


def test_tolerance_and_last_n(spark):
    df = frame(spark, [(0, i, float(i)) for i in range(6)])
    out = df.withColumn("r", temporal.last_n(S, F.col("v"), 3)).orderBy("t").collect()
    assert out[0].r == [None, None, 0.0] and out[5].r == [3.0, 4.0, 5.0]
    left = spark.createDataFrame([(0, 20), (0, 6)], "key long, t long")
    got = temporal.asof_between(left, df, S, ["v"], F.col("t") - 3).orderBy("t").collect()
    assert [r.v for r in got] == [5.0, None]


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], ["k", "x"])
    new = spark.createDataFrame([(2, "B"), (3, "C")], ["k", "x"])
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(tables.insert_ignore(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(tables.insert_replace(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(tables.delete(old, "k = 1")) == [(2, "b")]
    many = spark.createDataFrame([(k, "x") for k in (5, 3, 1, 6, 2, 4, 3)], ["k", "row"]).repartition(4)
    assert sorted((r.id, r.k) for r in tables.with_id(many, ["k"]).collect()) == [(1, 1), (2, 2), (3, 3), (4, 3), (5, 4), (6, 5), (7, 6)]
    assert rows(tables.insert_ignore(old, new.union(spark.createDataFrame([(3, "A")], ["k", "x"])), ["k"])) == [(1, "a"), (2, "b"), (3, "A")]
    assert tables.merge_columns(old, new.withColumn("y", F.lit(1))).columns == ["k", "x", "y"]


def test_gaps(spark):
    d = lambda x: dt.date(2024, 1, x)
    wanted = spark.createDataFrame([(1, d(1), d(31)), (2, d(1), d(31))], ["id", "start", "end"])
    done = spark.createDataFrame([(1, d(3), d(5)), (1, d(4), d(10)), (1, d(31), d(31))], ["id", "start", "end"])
    got = sorted(map(tuple, gaps.required_ranges(wanted, done, "id").collect()))
    assert got == [(1, d(1), d(2)), (1, d(11), d(30)), (2, d(1), d(20)), (2, d(21), d(31))]
    queries = spark.createDataFrame([(1, False), (2, False)], ["id", "done"])
    assert sorted(map(tuple, gaps.mark_done(queries, queries.where("id = 2")).collect())) == [(1, False), (2, True)]


def test_bars_files(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "AA.txt").write_text("2024-01-02,1,2,0.5,1.5,100\n2024-01-04,1.5,2,1,1.8,50\n")
    df = bars.read_csv(spark, str(tmp_path / "csv"))
    assert [(r.symbol, r.close, r.open_interest) for r in df.orderBy("date").collect()] == [("AA", 1.5, None), ("AA", 1.8, None)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "csv" / "AA.txt", "AA.txt")
    assert bars.read_zips(spark, str(tmp_path / "a.zip")).count() == 2
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("AA.txt", "2024-01-02,1,2,0.5,1.5\n")
        z.writestr("AAB.txt", "2024-01-02,1,2,0.5,1.5\n")
    assert bars.read_zips(spark, str(tmp_path / "b.zip"), "AAB", one=True).count() == 1
    with pytest.raises(Exception, match="not one"):
        bars.read_zips(spark, str(tmp_path / "b.zip"), "AA", one=True).count()
    assert [f["length"] > 0 for f in map(lambda r: r.asDict(), bars.modified_since(spark, str(tmp_path / "csv"), "2020-01-01T00:00:00").collect())] == [True]
    bars.write_bars(bars.identify(df, fx="EUR").unionByName(bars.identify(df, fx="EUR", adjust="back")), str(tmp_path / "both"), ("adjust", "symbol"))
    got = bars.read_bars(spark, str(tmp_path / "both"), ["AA"], by=("adjust", "symbol"), where={"adjust": None, "product": None})
    assert got.count() == 2 and got.columns[:6] == list(bars.IDENTIFIER)
    bars.write_bars(df, str(tmp_path / "store"))
    assert bars.read_bars(spark, str(tmp_path / "store"), ["AA"], "2024-01-03").count() == 1
    assert bars.on_calendar(df, "2024-01-01", "2024-01-05").count() == 5


def test_generators(spark):
    a = generators.walk(generators.times(spark, 2, 10), "key", "i", generators.gaussian(3, "key", "i"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, generators.walk(generators.times(spark, 2, 10).repartition(7), "key", "i", generators.gaussian(3, "key", "i")).collect()))
    many = generators.times(spark, 20, 1000).select(*[generators.gaussian(s, "key", "i", mean=1.0, std=2.0, part=p).alias(f"x{i}") for i, (s, p) in enumerate([(3, 0), (3, 1), (4, 0)])]).toPandas()
    assert abs(many.mean() - 1).max() < 0.06 and abs(many.std() - 2).max() < 0.06 and (many.corr() - np.eye(3)).abs().max().max() < 0.04
    assert generators.calendar(spark, "2024-01-01", "2024-01-10", 4).count() == 3


def test_pipeline_rows(spark):
    rows = [{"label": "c", "func": "pct_change", "kw-0": "v"}, {"label": None, "func": "x"}, {"label": "r", "func": "rms_ew", "kw-0": "v:ref=c", "kw-1": "span:float=4", "kw-2": ".", "kw-3": "junk"}]
    p = compile_rows(rows[::-1], S)
    built = Pipeline(S).add("c", "pct_change", "v").add("r", "rms_ew", "c", span=4.0)
    assert by_t(p.apply(frame(spark))) == by_t(built.apply(frame(spark)))
    again = compile_rows(built.describe(), S)
    assert [s.op for s in again.steps] == ["pct_change", "rms_ew"]
    with pytest.raises(ValueError):
        compile_rows([{"label": "a", "func": "absolute", "kw-0": "b"}, {"label": "b", "func": "absolute", "kw-0": "a"}], S)
    assert parse_cell("k:bool=False") == ("k", False, False)
    known = {s["func"]: s for s in signatures()}
    assert {"mean_ew", "mean", "pca"} <= set(known)
    assert known["pos_linear"] == {"func": "pos_linear", "kind": "fold", "inputs": ["scale", "date", "signal"], "params": ["upper", "lower", "delta", "freq", "const"]}
    assert known["rms_ew"]["params"] == ["span", "alpha", "b"] and known["ratio"]["kind"] == "column"
    assert plot_axes([{"label": "a", "x": True}, {"label": "b", "name": "c"}, {"label": "d", "y2": True}]) == {"x": "a", "y": ["c"], "y2": ["d"]}
    with pytest.raises(ValueError):
        plot_axes([{"label": "a", "x": True}, {"label": "b", "x": True}])


def test_stream_equals_batch(spark, tmp_path):
    df = frame(spark)
    for i in range(3):
        df.where((F.col("t") >= 10 * i) & (F.col("t") < 10 * i + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    recs = [fold.mean_ew("r", "v", span=4)]
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    stateful.run_available(stateful.fold_stream(stream, S, recs), lambda b, i: seen.extend(map(tuple, b.collect())), str(tmp_path / "state"))
    # a batch's maps are composed, a stream's rows are stepped through: the last bits can differ
    want = {(r[0], r[1]): r for r in fold.fold(df, S, recs).collect()}
    assert len(seen) == len(want)
    for r in seen:
        *same, last = want[r[0], r[1]]
        assert list(r[:-1]) == same and (last is None) == (r[-1] is None) and (last is None or abs(last - r[-1]) <= 1e-12 * abs(last))


def test_late_rows_are_dropped(spark, tmp_path):
    """Two micro-batches whose times overlap: what is not later than what a key has seen has no place."""
    df = frame(spark)
    for i, (a, b) in enumerate([(0, 12), (8, 20)]):
        df.where((F.col("t") >= a) & (F.col("t") < b) & (F.col("key") < 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their times
    for name, make in (("fold", lambda d: stateful.fold_stream(d, S, [fold.mean_ew("r", "v", span=4)])), ("last", lambda d: stateful.last_n_stream(d, S, "v", 3))):
        stream, seen = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), []
        stateful.run_available(make(stream), lambda b, i: seen.extend(b.collect()), str(tmp_path / f"state-{name}"))
        assert sorted((r.key, r.t) for r in seen) == [(k, t) for k in range(2) for t in range(20)]
        if name == "last":
            values = {(k, t): v for k, t, v in ROWS}
            assert all(r.last_n == [values.get((r.key, r.t - i)) for i in (2, 1, 0)] for r in seen)


def test_stream_bars(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(minutes=i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, ts timestamp, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = []
    stateful.run_available(stateful.bars_stream(stream, ["key"], "ts", "v", "10 minutes", "0 minutes"), lambda b, i: out.extend(b.collect()), tempfile.mkdtemp(dir=tmp_path), "update")
    assert {(r.high, r.n) for r in out} == {(10.0 * k + 9, 10) for k in range(6)}


def test_pca_with_gaps(spark):
    """Frames of different lengths in one batch, gaps, missing vectors, and no vector at all."""
    r = np.random.default_rng(3)
    x = r.normal(size=(40, 3))
    x[r.random((40, 3)) < 0.1] = np.nan
    rows = [(0, i, None if i % 11 == 0 else [None if np.isnan(c) else float(c) for c in x[i]]) for i in range(40)] + [(1, 0, None)]
    df = spark.createDataFrame(rows, "key long, t long, v array<double>").coalesce(1)
    got = {r.t: r.p for r in df.withColumn("p", factors.pca(S, F.col("v"), 6, 2, centre=True)).where("key = 0").collect()}
    for t in range(40):
        own = np.array([x[i] for i in range(max(0, t - 5), t + 1) if i % 11 and not np.isnan(x[i]).any()]).reshape(-1, 3)
        if len(own) < 3:
            assert got[t] is None
            continue
        u, e, _ = np.linalg.svd((own - own.mean(axis=0)).T, full_matrices=False)
        assert got[t].e == pytest.approx(e[:2])
        assert np.abs(np.array(got[t].u)) == pytest.approx(np.abs(u[:, :2]), abs=1e-6) or e[1] < 1e-9
        assert all(c >= 0 for c in got[t].u[-1])
    assert df.where("key = 1").withColumn("p", factors.pca(S, F.col("v"), 6, 2)).first().p is None
