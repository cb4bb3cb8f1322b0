"""Operators on live streams in event time, against the same operators on the whole table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import fold, temporal
from tideline.series import Series
from tideline.streaming import ordered, stateful

S = Series.of("key", "ts", "id")
T0 = dt.datetime(2024, 1, 1)


def rows_of(n, seed, hot=0.5):
    """(key, ts, id, v, side), a hot key and ties in time."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if r.random() < hot else r.randrange(1, 6)
        out.append((key, T0 + dt.timedelta(seconds=r.randrange(4 * 3600)), i, None if r.random() < 0.2 else float(r.randrange(100)), r.randrange(2)))
    return sorted(out, key=lambda x: x[1])


SCHEMA = "key long, ts timestamp, id long, v double, side int"
LATE = dt.timedelta(minutes=20)


def fed(spark, tmp_path, rows, make, name, stretches=5, seed=7):
    """What a stream gives that gets ``rows`` in several micro-batches, each up to LATE late and in no order, and then a heartbeat."""
    r = random.Random(seed)
    arriving = sorted(((x[1] + LATE * r.random(), x) for x in rows), key=lambda x: x[0])
    size = -(-len(arriving) // stretches)
    seen, batches = [], []
    path = str(tmp_path / f"in-{name}")
    parts = [[x for _, x in arriving[i : i + size]] for i in range(0, len(arriving), size)]
    for part in [*parts, [(-1, T0 + dt.timedelta(days=9), -1, None, 0)]]:
        r.shuffle(part)
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(path)
        stream = make(spark.readStream.schema(SCHEMA).parquet(path))
        stateful.run_available(stream, lambda b, i: (batches.append(i), seen.extend(map(tuple, b.collect()))), str(tmp_path / f"state-{name}"))
    assert len(set(batches)) > stretches
    return sorted(seen, key=repr)


def test_asof(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "PART_ROWS", 7)  # many parts for each key
    rows = rows_of(300, 1)
    split = lambda d: (d.where("side = 1").select("key", "ts", "id", "v"), d.where("side = 0").select("key", "ts", F.col("id").alias("rid"), F.col("v").alias("w")))
    by = Series.of("key", "ts", "rid")
    whole = split(spark.createDataFrame(rows, SCHEMA))
    for skip in (False, True):
        want = sorted(map(tuple, temporal.asof(*whole, by, ["w", "rid"], skip, prefix="r_").collect()), key=repr)
        got = fed(spark, tmp_path, rows, lambda d, skip=skip: ordered.asof_in_order(*split(d), by, ["w", "rid"], "20 minutes", skip, prefix="r_"), f"asof-{skip}")
        assert got == want


def test_fold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "PART_ROWS", 7)
    rows = rows_of(300, 2)
    recs = [fold.mean_ew("mu", "v", span=4), fold.std_ew("sd", "v", "mu", span=4), fold.xo_mean_ew_rms_ew("xo", "v", 2, 4, 4)]
    want = sorted(map(tuple, fold.fold(spark.createDataFrame(rows, SCHEMA), S, recs).collect()), key=repr)
    assert fed(spark, tmp_path, rows, lambda d: ordered.fold_in_order(d, S, recs, "20 minutes", stretch="3 minutes"), "fold") == want


def test_last_n(spark, tmp_path):
    rows = rows_of(120, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, df.withColumn("last_n", temporal.last_n(S, F.col("v"), 3)).collect()), key=repr)
    assert fed(spark, tmp_path, rows, lambda d: ordered.last_n_in_order(d, S, "v", 3, "20 minutes"), "last", 2) == want


def test_forgotten_keys_start_anew(spark, tmp_path):
    """A pause of over an hour, within one micro-batch and between two."""
    at = lambda minutes, i: (1, T0 + dt.timedelta(minutes=minutes), i, float(i), 0)
    rows = [at(0, 1), at(10, 2), at(69, 3), at(140, 4), at(150, 5), at(400, 6), at(401, 7)]
    count = fold.Recurrence("n", (), lambda n: ((n or 0) + 1,) * 2, "int")
    got = fed(spark, tmp_path, rows, lambda d: ordered.fold_in_order(d, S, [count], "20 minutes", forget="1 hour"), "forget", 2)
    assert [(x[2], x[-1]) for x in got] == [(1, 1), (2, 2), (3, 3), (4, 1), (5, 2), (6, 1), (7, 2)]


def test_too_late_and_timeless_rows(spark, tmp_path):
    """A row behind the watermark goes, one without a time too; the others are as if they had never been."""
    path, seen = str(tmp_path / "in"), []
    count = fold.Recurrence("n", (), lambda n: ((n or 0) + 1,) * 2, "int")
    for part in ([(1, T0 + dt.timedelta(hours=2), 2, 1.0, 0), (1, None, 9, 1.0, 0)], [(1, T0, 1, 1.0, 0), (1, T0 + dt.timedelta(hours=3), 3, 1.0, 0)], [(2, T0 + dt.timedelta(days=2), 4, 1.0, 0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stateful.run_available(ordered.fold_in_order(spark.readStream.schema(SCHEMA).parquet(path), S, [count], "10 minutes"), lambda b, i: seen.extend(b.collect()), str(tmp_path / "state"))
    assert sorted((r.id, r.n) for r in seen) == [(2, 1), (3, 2)]


def test_durations():
    assert ordered.micros("3 hours") == 10_800_000_000 and ordered.micros("1 day") == 86_400_000_000
    with pytest.raises(KeyError):
        ordered.micros("2 fortnights")


def test_session_keeps_its_state_store(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    rows = rows_of(10, 4)
    fed(spark, tmp_path, rows, lambda d: ordered.last_n_in_order(d, S, "v", 2, "20 minutes"), "conf", 1)
    assert spark.conf.get(name) == before


def test_state_has_no_more_partitions_than_cores_use(spark, tmp_path, monkeypatch):
    """A session of many shuffle partitions keeps them; a stream's state has a few for each core."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    monkeypatch.setattr(stateful, "PER_CORE", 1, raising=False)
    monkeypatch.setattr(stateful, "LEAST_PARTITIONS", 3, raising=False)
    spark.conf.set(name, "64")
    try:
        rows = rows_of(10, 5)
        got = fed(spark, tmp_path, rows, lambda d: ordered.last_n_in_order(d, S, "v", 2, "20 minutes"), "few", 1)
        assert spark.conf.get(name) == "64"
    finally:
        spark.conf.set(name, before)
    assert len(got) == len(rows)
    stores = [p for p in (tmp_path / "state-few" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(stores) == max(3, spark.sparkContext.defaultParallelism)


def test_many_keys_take_few_parts():
    """A shard's rows of a thousand keys are written in sorted parts of many rows, whatever their keys, and merged back in order."""

    class Map(dict):
        updateValue, getValue, removeKey, containsKey = dict.__setitem__, dict.__getitem__, dict.pop, dict.__contains__

    class Value:
        now = None
        exists = lambda self: self.now is not None
        get = lambda self: self.now
        update = lambda self, x: setattr(self, "now", x)

    class Handle:
        getMapState = lambda self, *_: Map()
        getValueState = lambda self, *_: Value()
        registerTimer = deleteTimer = lambda self, _: None

    class Mark:
        getCurrentWatermarkInMs = lambda self: 3_000

    p = ordered._Fold(["key", "id", "_t"], ["key"], ["_t", "id"], ["key", "id", "_t", "n"], None, None)
    p.recurrences, p.loops, p.part_rows, p.run_rows = [fold.Recurrence("n", (), lambda n: ((n or 0) + 1,) * 2, "int")], False, 100, 1500
    p.init(Handle())
    r = random.Random(6)
    rows = [(i % 1000, i, r.randrange(6_000_000)) for i in range(4000)]
    list(p.handleInputRows((0,), iter(rows), None))
    assert len(p.parts) == 40
    got = [tuple(x) for x in p.handleExpiredTimer((0,), Mark(), None)]
    seen, want = {}, []
    for k, i, t in sorted((x for x in rows if x[2] <= 3_000_000), key=lambda x: (x[2], x[1])):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, i, t, seen[k]))
    assert got == want
    assert sum(len(ordered.loads(v[0])) for v in p.parts.values()) == len(rows) - len(want)
