"""Tables on storage, bars that are fetched once, archives member by member, ranges, numbers and splits."""

import datetime as dt
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tideline.operators import triggers
from tideline.series import Series
from tideline.sources import archives, gaps, stored, tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_life_of_a_table(spark, tmp_path):
    """Insert, widen, replace, delete by a join, read back; older versions stay readable."""
    t = stored.Stored(spark, str(tmp_path / "t"), ["k"])
    with pytest.raises(ValueError):
        t.read()
    assert t.create("k int, x string") == 1 == t.create("x string") and rows(t.read()) == []
    frame = lambda data, schema="k int, x string": spark.createDataFrame(data, schema)
    t.insert(frame([(1, "a"), (2, "b"), (2, "a")]))
    assert rows(t.read()) == [(1, "a"), (2, "a")]
    t.insert(frame([(2, "z", 1.0), (3, "c", 2.0)], "k int, x string, y double"))
    assert rows(t.read()) == [(1, "a", None), (2, "a", None), (3, "c", 2.0)]
    assert len(t.parts()[0]) == 2  # what is known is not written again
    t.insert(frame([(1, "A"), (4, "d")]), replace=True)
    assert rows(t.read()) == [(1, "A", None), (2, "a", None), (3, "c", 2.0), (4, "d", None)]
    other, more = frame([(2, "n"), (3, "y"), (3, "y"), (9, "y")], "id int, go string"), frame([("c", 1)], "x string, n int")
    n = t.delete("o.go = 'y' AND m.n > 0", {"o": (other, "o.id = t.k"), "m": (more, "m.x = t.x")})
    assert rows(t.read()) == [(1, "A", None), (2, "a", None), (4, "d", None)]
    t.delete("x = 'd' OR y > 100")
    assert rows(t.read()) == [(1, "A", None), (2, "a", None)]
    assert len(rows(t.read(n - 1))) == 4
    t.create("z date")
    assert rows(t.read()) == [(1, "A", None, None), (2, "a", None, None)]
    assert t.vacuum() > 0 and rows(t.read()) == [(1, "A", None, None), (2, "a", None, None)]


def test_failed_and_rival_writes(spark, tmp_path):
    """A write that fails leaves the version as it was; of two writers from one version the second fails."""
    t, u = (stored.Stored(spark, str(tmp_path / "t"), ["k"]) for _ in range(2))
    frame = spark.createDataFrame([(1, 2)], "k int, x int")
    t.insert(frame)
    with pytest.raises(Exception):
        t.insert(frame.select(F.lit(2).alias("k"), F.raise_error(F.lit("lost")).cast("int").alias("x")))
    assert t.version() == 1 and rows(t.read()) == [(1, 2)]
    base = t.version()
    u.insert(frame.withColumn("k", F.lit(5)))
    with pytest.raises(stored.Conflict):
        t._commit(base, [], t.parts()[1])
    assert rows(t.read()) == [(1, 2), (5, 2)]
    assert t.vacuum(9) >= 0 and rows(t.read()) == [(1, 2), (5, 2)]


def test_bars_are_fetched_once(spark, tmp_path):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    bars = spark.createDataFrame([(s, day(n), float(n)) for s in "AB" for n in range(0, 90, 2)], "symbol string, date date, close double")
    asked = []

    def fetch(ranges):
        got = ranges.collect()
        asked.extend((r["symbol"], r["start"] + dt.timedelta(days=i)) for r in got for i in range((r["end"] - r["start"]).days + 1))
        assert all((r["end"] - r["start"]).days < 20 for r in got)
        return bars.join(ranges, "symbol").where("date between start and end").select("symbol", "date", "close")

    want = lambda *x: spark.createDataFrame(x, "symbol string, start date, end date")
    path = str(tmp_path / "cache")
    one = stored.cached_bars(spark, path, want(("A", day(10), day(50))), fetch)
    assert rows(one) == sorted((("A", day(n), None if n % 2 else float(n)) for n in range(10, 51)), key=repr)
    two = stored.cached_bars(spark, path, want(("A", day(0), day(60)), ("B", day(5), day(6))), fetch)
    assert two.count() == 61 + 2
    assert len(asked) == len(set(asked)) == 63
    before = len(asked)
    assert stored.cached_bars(spark, path, want(("A", day(20), day(30))), fetch).count() == 11 and len(asked) == before

    def broken(ranges):
        return bars.select("symbol", "date", F.raise_error(F.lit("lost")).cast("double").alias("close"))

    with pytest.raises(Exception):
        stored.cached_bars(spark, path, want(("B", day(0), day(20))), broken).collect()
    assert rows(stored.cached_bars(spark, path, want(("B", day(0), day(8))), fetch)) == sorted((("B", day(n), None if n % 2 else float(n)) for n in range(9)), key=repr)


@pytest.fixture()
def zips(tmp_path):
    """Two archives; the member BAD can not be read."""
    body = lambda c: "".join(f"2024-01-{d:02d},{c},2,0.5,1.5,{d}\n" for d in range(1, 21))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("full/AA.txt", body(1))
        z.writestr("full/BB.txt", "2024-01-02,1,2,,1.5\n\n2024-01-03,1,2,3,4,5,6\n")
        z.writestr("full/BAD.txt", "no bars here\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("full/CC.txt", body(3))
        z.writestr("other/CC.md", "# notes\n")
    return str(tmp_path)


def test_archives(spark, zips, monkeypatch):
    """Members that nobody asks for are not opened: BAD would fail."""
    monkeypatch.setattr(archives, "ROWS", 7)
    got = archives.read_archives(spark, zips, "full/", symbols=["AA", "CC"], start="2024-01-05", end="2024-01-14")
    assert got.count() == 20 and {r[0] for r in got.select("symbol").distinct().collect()} == {"AA", "CC"}
    assert got.rdd.getNumPartitions() == 2
    assert rows(archives.read_archives(spark, f"{zips}/a.zip", symbols=["BB"])) == [("BB", dt.date(2024, 1, 2), 1.0, 2.0, None, 1.5, None, None), ("BB", dt.date(2024, 1, 3), 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)]
    with pytest.raises(Exception, match="no bars"):
        archives.read_archives(spark, zips, "full/").count()
    assert archives.read_archives(spark, zips, symbols=["ZZ"]).count() == 0
    assert archives.read_archives(spark, zips, "CC.txt", one=False).count() == 20
    with pytest.raises(Exception, match="not one"):
        archives.read_archives(spark, zips, "full/", one=True).count()


def test_conditions_reach_the_archives(spark, zips):
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        df = archives.read_archives(spark, zips, "full/")
        assert df.where("symbol = 'AA' and date >= '2024-01-19'").count() == 2  # BAD is not opened
        assert df.where("symbol in ('AA', 'BB') and date > '2024-01-02' and date < '2024-01-04'").count() == 2
        assert df.where("symbol = 'CC' and close > 5").count() == 0
    finally:
        spark.conf.set(name, before)


def test_many_ranges_of_one_key(spark):
    """Ten thousand wanted and done ranges of one key, in seconds; the same days as by counting."""
    n = 10_000
    start = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") * 7).cast("int"))
    wanted = spark.range(n).select(F.lit(1).alias("k"), start.alias("start"), F.date_add(start, 4).alias("end"))
    done = spark.range(n).select(F.lit(1).alias("k"), F.date_add(start, 2).alias("start"), F.date_add(start, 3).alias("end"))
    began = time.perf_counter()
    got = gaps.required_ranges(wanted, done, "k")
    assert got.agg(F.count(F.lit(1)), F.sum(F.datediff("end", "start") + 1)).first()[:2] == (2 * n, 3 * n)
    assert time.perf_counter() - began < 60


def test_long_and_empty_ranges(spark):
    d = lambda *x: dt.date(*x)
    wanted = spark.createDataFrame([("a", d(2000, 1, 1), d(2020, 12, 31)), ("a", d(2000, 1, 1), d(2020, 12, 31)), ("b", d(2024, 1, 1), d(2024, 1, 3)), ("c", d(2024, 1, 5), d(2024, 1, 4))], "k string, start date, end date")
    done = spark.createDataFrame([("a", d(1990, 1, 1), d(2010, 6, 30)), ("a", d(2010, 7, 2), d(2030, 1, 1))], "k string, start date, end date")
    assert rows(gaps.required_ranges(wanted, done, "k")) == [("a", d(2010, 7, 1), d(2010, 7, 1)), ("b", d(2024, 1, 1), d(2024, 1, 3))]


def test_numbers_of_equal_rows(spark):
    """One order value in all rows, and rows that are wholly equal: gapless, and dealt to several tasks."""
    df = spark.range(4000).select(F.lit(1).alias("o"), (F.col("id") % 2000).alias("x"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")  # a table as small as this would be one task's otherwise
    try:
        out = tables.with_id(df.repartition(8), ["o"])
    finally:
        spark.conf.set(name, before)
    assert sorted(r["id"] for r in out.collect()) == list(range(1, 4001))
    assert len(out.inputFiles()) > 1
    assert {tuple(r) for r in out.groupBy("x").count().select("count").distinct().collect()} == {(2,)}


def test_split_ahead(spark):
    s = Series.of("k", "t")
    df = spark.createDataFrame([(k, t, t in stops) for k, stops in ((1, {0, 2, 3}), (2, {4}), (3, set())) for t in range(5)], "k int, t int, stop boolean")
    got = {(r["k"], r["t"]): (r["a"], r["b"]) for r in df.withColumns({"a": triggers.split_ids(s, F.col("stop")), "b": triggers.split_ids(s, F.col("stop"), ahead=True)}).collect()}
    assert [got[1, t] for t in range(5)] == [(0, 0), (1, 0), (1, 1), (2, 2), (3, 2)]
    assert [got[2, t][1] for t in range(5)] == [0, 0, 0, 0, 1] and {got[3, t] for t in range(5)} == {(0, 0)}


def test_written_archives(spark, tmp_path):
    data = [(s, dt.date(2024, 1, d), 1.5, None, float(d)) for s in ("A1", "B1", "C2") for d in (3, 1, 2)]
    df = spark.createDataFrame(data, "symbol string, date date, open double, high double, low double")
    archives.write_archives(df.withColumn("a", F.substring("symbol", -1, 1)), str(tmp_path / "z"), "a", ["open", "high", "low"])
    assert sorted(p.name for p in (tmp_path / "z").iterdir()) == ["1.zip", "2.zip"]
    got = archives.read_archives(spark, str(tmp_path / "z"), symbols=["B1", "C2"])
    assert rows(got.select("symbol", "date", "open", "high", "low")) == sorted((x for x in data if x[0] != "A1"), key=repr)


def test_many_identifiers_share_folders(spark, tmp_path, monkeypatch):
    """Parts of few values keep a folder each, many symbols share buckets; all come back, and one opens its bucket alone."""
    from tideline.sources import bars

    monkeypatch.setattr(bars, "MOST_FOLDERS", 50)
    monkeypatch.setattr(bars, "BUCKETS", 8)
    n = 400
    data = spark.range(n * 3).select((F.col("id") % n).cast("string").alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / n).cast("int")).alias("date"), *[F.col("id").cast("double").alias(f) for f in bars.FIELDS])
    data = data.withColumn("symbol", F.when(F.col("symbol") != "7", F.col("symbol")))
    both = bars.identify(data, fx="EUR").unionByName(bars.identify(data, fx="EUR", adjust="back"))
    path, by = str(tmp_path / "both"), ("adjust", "symbol")
    bars.write_bars(both, path, by)
    assert len([p for p in (tmp_path / "both").rglob("*=*") if p.is_dir()]) == 2 + 2 * 8
    got = bars.read_bars(spark, path, by=by)
    assert rows(got) == rows(both.select(got.columns))
    assert bars.read_bars(spark, path, by=by, where={"adjust": "back", "symbol": None}).count() == 3
    some = bars.read_bars(spark, path, ["3", "400", "5"], "2024-01-02", by=by, where={"adjust": None})
    assert sorted((r["symbol"], r["adjust"], r["close"]) for r in some.collect()) == [("3", None, 403.0), ("3", None, 803.0), ("5", None, 405.0), ("5", None, 805.0)]
    bars.write_bars(data, str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*=*"))) == 8
    one = bars.read_bars(spark, str(tmp_path / "one"), ["11"])
    assert sorted(r["close"] for r in one.collect()) == [11.0, 411.0, 811.0]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(symbol,11)" in plan


def test_partitions_do_not_grow_with_members(spark, tmp_path):
    """Thousands of small members, in one archive and in an archive each, take about as many tasks as there are cores."""
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "all.zip", "w") as z:
        for i in range(2000):
            z.writestr(f"S{i}.txt", f"2024-01-02,{i},2,0.5,1.5\n")
    for i in range(50):
        with zipfile.ZipFile(tmp_path / "z" / f"one{i}.zip", "w") as z:
            z.writestr(f"T{i}.txt", "2024-01-03,1,2,0.5,1.5\n")
    got = archives.read_archives(spark, str(tmp_path / "z"))
    assert spark.sparkContext.defaultParallelism <= got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
    assert sorted((r["symbol"], r["open"]) for r in got.collect()) == sorted([(f"S{i}", float(i)) for i in range(2000)] + [(f"T{i}", 1.0) for i in range(50)])
    assert archives.read_archives(spark, str(tmp_path / "z"), start="2024-01-03").count() == 50


def test_folder_and_files(spark, tmp_path, monkeypatch):
    from tideline.sources import bars

    monkeypatch.setenv("TIDELINE_BARS", "/some/where")
    assert bars.bars_dir() == "/some/where" and bars.bars_dir("/else") == "/else"
    monkeypatch.delenv("TIDELINE_BARS")
    with pytest.raises(ValueError):
        bars.bars_dir()
    (tmp_path / "a.txt").write_text("x")
    assert [r["length"] for r in bars.modified_since(spark, str(tmp_path), "2020-01-01T00:00:00").collect()] == [1]
    assert bars.modified_since(spark, str(tmp_path), "2100-01-01T00:00:00").count() == 0
