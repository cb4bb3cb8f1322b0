"""Recurrences over batches at once and in loops, lookups of vectors and matrices, walks, aggregates of one's own, Gaussian processes."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import aggregates, factors, fold, temporal
from tideline.plans.pipeline import REGISTRY, Pipeline, compile_rows, register
from tideline.series import Series
from tideline.sources import generators

S = Series.of("key", "t")
SCHEMA = "key long, t double, v double, w double"


def rows_of(n=200, seed=1):
    r = random.Random(seed)
    some = lambda: None if r.random() < 0.25 else r.choice([0.0, round(r.gauss(0, 3), 3)])
    return [(k, float(t), some(), some()) for k in range(4) for t in range(n if k == 0 else r.randrange(1, 30))]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3).cache()


def stepped(recurrences):
    """What steps give one after the other, by (key, t)."""
    out = {}
    for key in range(4):
        states, before = [None] * len(recurrences), {}
        for k, t, v, w in rows_of():
            if k != key:
                continue
            now = dict(before)
            for i, r in enumerate(recurrences):
                states[i], now[r.name] = r.step(states[i], *[{"v": v, "w": w}.get(c) if c in "vw" else now.get(c) for c in r.inputs])
            before = now
            out[k, t] = tuple(now[r.name] for r in recurrences)
    return out


def close(a, b):
    if isinstance(a, dict):
        return all(close(a[k], b[k]) for k in a)
    return (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * (1 + abs(a)))


def same(df, names, want):
    got = {(r["key"], r["t"]): tuple(x.asDict() if hasattr(x := r[n], "asDict") else x for n in names) for r in df.collect()}
    assert got.keys() == want.keys()
    assert all(close(a, b) for k in want for a, b in zip(want[k], got[k]))


RECURRENCES = [fold.mean_ew("mu", "v", span=4), fold.std_ew("sd", "v", "mu", span=3), fold.rms_ew("rms", "v", span=3, b=2.0), fold.xo_mean_ew_rms_ew("xo", "v", 2, 5, 3), fold.xo_mean_ew_rms_ew("xp", "v", 2, 5, 3, "pct"), fold.max_ew("mx", "v", "mu", span=3), fold.min_ew("mn", "v", span=3), fold.quantile_ew("qt", "v", 0.3, span=3)]


@pytest.mark.parametrize("batch,few", [(3, 8), (10_000, 8), (3, 0), (10_000, 0)])
def test_batches_at_once(spark, frame, monkeypatch, batch, few):
    """Scans give what steps give, wherever a batch ends and whether series go side by side or not."""
    monkeypatch.setattr(fold, "ABREAST", few)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        same(fold.fold(frame, S, RECURRENCES), [r.name for r in RECURRENCES], stepped(RECURRENCES))
    finally:
        spark.conf.set(name, before)


LOOP = [fold.feedback("p", "v", "q", c=-0.5), fold.mean_ew("q", "p", span=4), fold.rms_ew("r", "q", span=3), fold.feedback("own", "w", "own", c=0.5), fold.mapped("sum", ("r", "own"), lambda x, y: None if x is None or y is None else x + y)]


def test_loops(frame):
    assert fold.passes(LOOP, ["v", "w"]) == [[0, 1], [2], [3], [4]]
    a, b, c = (fold.mapped(n, i, lambda *x: None) for n, i in (("a", ("b",)), ("b", ("c",)), ("c", ("a",))))
    assert fold.passes([a, b, c], []) == [[0, 1, 2]]
    with pytest.raises(ValueError, match="neither"):
        fold.passes([a], ["v"])
    same(fold.fold(frame, S, LOOP), [r.name for r in LOOP], stepped(LOOP))


def test_loop_of_rows(frame):
    rows = [{"label": "m", "func": "mean", "kw-0": "v", "kw-1": "n=3"}, {"label": "p", "func": "feedback", "kw-0": "v:ref=m", "kw-1": "back:ref=q", "kw-2": "c:float=-0.5"}, {"label": "q", "func": "mean_ew", "kw-0": "v:ref=p", "kw-1": "span:float=4"}, {"label": "z", "func": "absolute", "kw-0": "v:ref=q"}]
    compiled = compile_rows(rows[::-1][:1] + rows[:3], S)
    assert [s.name for s in compiled.steps] == ["m", "p", "q", "z"]
    built = Pipeline(S).add("m", "mean", "v", n=3).apply(frame)
    want = fold.fold(built, S, [fold.feedback("p", "m", "q", c=-0.5), fold.mean_ew("q", "p", span=4)]).withColumn("z", F.abs("q"))
    assert sorted(map(tuple, compiled.apply(frame).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    with pytest.raises(ValueError, match="cycle"):
        compile_rows([{"label": "a", "func": "mean_ew", "kw-0": "b:ref=b", "kw-1": "span=3"}, {"label": "b", "func": "absolute", "kw-0": "v:ref=a"}], S)


def test_gaussian_process(spark):
    """A factor that grows and shrinks, against frames that are solved whole, for frames longer and shorter than a series."""
    r = random.Random(3)
    rows = [(k, float(t), None if r.random() < 0.1 else r.uniform(0, 20), None if r.random() < 0.1 else r.gauss(0, 1)) for k in range(2) for t in range(170)]
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 2, 50):
        want = {(x["key"], x["t"]): (x["gp_mean"], x["gp_var"]) for x in factors.gp_regression(df, S, "v", "w", n, 1.5, 2.0, 0.3).collect()}
        got = {(x["key"], x["t"]): tuple(x["g"]) for x in fold.fold(df, S, [factors.gp_incremental("g", "v", "w", n, 1.5, 2.0, 0.3)]).collect()}
        assert got.keys() == want.keys()
        assert all(close(a, b) or abs(a - b) < 1e-7 for k in want for a, b in zip(want[k], got[k]))


def test_own_aggregates(frame):
    spread = register("spread", lambda v, w, scale=1.0: None if np.isnan(v).all() or np.isnan(w).all() else float((np.nanmax(v) - np.nanmin(w)) * scale), "aggregate", ("v", "w"))
    assert REGISTRY["spread"].params == ("n", "scale")
    out = Pipeline(S).add("r", "trimmed_mean", "v", n=5).add("x", "spread", "v", "w", n=3, scale=2.0).apply(frame)
    mine = {}
    for k, t, v, w in rows_of():
        mine.setdefault(k, []).append((t, v, w))
    got = {(x["key"], x["t"]): (x["r"], x["x"]) for x in out.collect()}
    for k, xs in mine.items():
        for i, (t, _, _) in enumerate(xs):
            five = np.array([np.nan if x[1] is None else x[1] for x in xs[max(0, i - 4) : i + 1]])
            three = [np.array([np.nan if x[j] is None else x[j] for x in xs[max(0, i - 2) : i + 1]]) for j in (1, 2)]
            assert close(aggregates.trimmed_mean(five), got[k, t][0]) and close(spread(*three, scale=2.0), got[k, t][1])
    del REGISTRY["spread"]


def test_lookups_of_vectors(frame):
    df = frame.withColumns({"vec": F.when(F.col("t") % 5 != 2, F.array("v", "w")), "mat": F.array(F.array("v", "w"), F.array("w", "v"))})
    rows = {(r["key"], r["t"]): r for r in df.withColumns({"l": temporal.last_n(S, F.col("vec"), 3, (2,)), "m": temporal.last_n(S, F.col("mat"), 3, (2, 2))}).collect()}
    none = [None, None]
    for (k, t), r in rows.items():
        back = [rows.get((k, t - i)) for i in (2, 1, 0)]
        assert r["l"] == [none if b is None or b["vec"] is None else b["vec"] for b in back]
        assert r["m"] == [[none, none] if b is None else b["mat"] for b in back]
    left = df.where("t % 3 = 0").select("key", "t", "v")
    right = df.where("t % 2 = 1").select("key", "t", "vec", "mat")
    for value, shape, empty in (("vec", (2,), none), ("mat", (2, 2), [none, none])):
        whole = lambda x, value=value: x is not None and None not in (x if value == "vec" else [z for y in x for z in y])
        for skip in (False, True):
            for r in temporal.asof_shaped(left, right, S, value, shape, skip, prefix="r_", after=F.col("t") - 4).collect():
                at = next((t for t in np.arange(r["t"], -1, -1) if t % 2 == 1 and (r["key"], t) in rows and (not skip or whole(rows[r["key"], t][value]))), None)
                found = empty if at is None or at < r["t"] - 4 else rows[r["key"], at][value]
                assert r[f"r_{value}"] == (empty if found is None else found)


def test_whole(spark):
    rows = [([1.0, 2.0], [[1.0], [2.0]]), ([1.0, None], [[1.0], [None]]), ([1.0, float("nan")], [[1.0], None]), ([1.0], [[1.0]]), (None, None)]
    df = spark.createDataFrame(rows, "v array<double>, m array<array<double>>")
    assert [tuple(r) for r in df.select(temporal.whole(F.col("v"), (2,)), temporal.whole(F.col("m"), (2, 1))).collect()] == [rows[0], *[(None, None)] * 4]


def test_walks(frame):
    walks = generators.gaussian_walk_mat(generators.gaussian_walk_vec(frame, "key", "t", 5, 3, "key", "t", name="vec"), "key", "t", 6, 2, 2, "key", "t", name="mat")
    noise = {(r["key"], r["t"]): r for r in frame.withColumns({"vec": generators.gaussian_vec(5, 3, "key", "t"), "mat": generators.gaussian_mat(6, 2, 2, "key", "t")}).collect()}
    got = {(r["key"], r["t"]): r for r in walks.collect()}
    for key in range(4):
        vec, mat = np.zeros(3), np.zeros((2, 2))
        for _, t in sorted(k for k in noise if k[0] == key):
            vec, mat = vec + noise[key, t]["vec"], mat + noise[key, t]["mat"]
            assert np.allclose(vec, got[key, t]["vec"]) and np.allclose(mat, got[key, t]["mat"])


def test_sources_of_tables(spark, frame):
    days = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-08"), (2, "2024-02-01"), (3, None)], "k int, d string")
    assert sorted((r["k"], str(r["date"])) for r in generators.calendar_of(days, "d", 3, ["k"]).collect()) == [(1, "2024-01-01"), (1, "2024-01-04"), (1, "2024-01-07"), (2, "2024-02-01")]
    assert sorted(map(tuple, generators.every(frame.select("key").distinct(), 2, 0.5, 1.0).collect())) == [(k, i, 1.0 + i / 2) for k in range(4) for i in range(2)]


@pytest.mark.parametrize("parts", [1, 7])
def test_shared_stream(spark, monkeypatch, parts):
    """numpy's own numbers, bit by bit, however rows are dealt and wherever a state was noted."""
    monkeypatch.setattr(generators, "STATE_EVERY", 64)
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("t"), "id").repartition(parts)
    for normal in (True, False):
        rng = np.random.default_rng(11)
        want = rng.normal(1.0, 2.0, (1000, 3)) if normal else rng.random((1000, 3))
        got = sorted(generators.shared_stream(df, ["t"], 11, ["a", "b", "c"], normal, 1.0, 2.0).select("t", "a", "b", "c").collect())
        assert [tuple(r)[1:] for r in got] == [tuple(x) for x in want.tolist()]
    assert generators.shared_stream(df.limit(0), ["t"], 11, ["a"]).count() == 0


def test_scans_have_the_bits_of_steps():
    """Rounded results may not hang on where a batch ends: scan() gives step()'s doubles, not just numbers close to them."""
    r = random.Random(8)
    new = np.array([i % 137 == 0 for i in range(1500)])
    x = np.array([np.nan if r.random() < 0.2 else round(r.uniform(0, 500), 2) for _ in new])
    m = np.array([r.gauss(200, 50) for _ in new])
    for rec in (fold.mean_ew("a", "v", span=12), fold.std_ew("a", "v", "m", span=6), fold.rms_ew("a", "v", span=6, b=2.0), fold.xo_mean_ew_rms_ew("a", "v", 4, 12, 6), fold.xo_mean_ew_rms_ew("a", "v", 4, 12, 6, "pct")):
        xs = (x, m)[: len(rec.inputs)]
        state, want = None, []
        for start, *row in zip(new.tolist(), *(c.tolist() for c in xs)):
            state, y = rec.step(None if start else state, *(None if c != c else c for c in row))
            want.append(tuple(y.values()) if isinstance(y, dict) else (y,))
        for size in (7, 400, 1500):
            state, got = None, []
            for i in range(0, len(new), size):
                state, y = rec.scan(new[i : i + size], state, *(c[i : i + size] for c in xs))
                got += [tuple(None if z != z else z for z in row) for row in zip(*(c.tolist() for c in (y.values() if isinstance(y, dict) else (y,))))]
            assert got == want


def test_crossover_of_a_first_zero(spark, tmp_path):
    """A distance in units of no volatility is missing, as in the query's SQL."""
    from tideline import queries

    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, 1, "click", 0.0), (1, at + dt.timedelta(hours=1), 2, "click", 3.0), (2, at, 3, "click", 5.0)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert [r.xo is None for r in queries.QUERIES["xo_crossover"](spark, str(tmp_path)).orderBy("event_id").collect()] == [True, False, False]
