"""What plans must not do: shuffle twice, multiply rows, read what is not asked for."""

import re

from pyspark.sql import functions as F

from tideline.operators import fold, rolling, signals, temporal, triggers
from tideline.plans.pipeline import Pipeline
from tideline.queries import EVENTS
from tideline.sources import bars


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, node):
    return len(re.findall(rf"(?m)^[\s:+*()0-9-]*{node}\b", plan(df)))


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("v", F.col("value"))


def test_frames_share_a_sort(spark, sf_dir):
    v = F.col("v")
    cols = [rolling.mean(EVENTS, v, 5), rolling.std(EVENTS, v, 20), rolling.max_(EVENTS, v, 3), rolling.quantile(EVENTS, v, 0.5, 7), rolling.abs_change(EVENTS, v), rolling.cum_sum(EVENTS, v), signals.pos_simple(EVENTS, v)]
    df = events(spark, sf_dir).select("user_id", "event_id", *[c.alias(f"c{i}") for i, c in enumerate(cols)])
    assert count(df, "Exchange") == 1 and count(df, "Sort") == 1


def test_columns_are_pruned(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", rolling.mean(EVENTS, F.col("v"), 5).alias("r"))
    assert "props" not in re.search(r"ReadSchema: (.*)", plan(df))[1]


def test_asof_joins_nothing(spark, sf_dir):
    df = events(spark, sf_dir)
    out = temporal.asof(df.where("event_type = 'click'").select("user_id", "ts", "event_id"), df.where("event_type = 'error'").select("user_id", "ts", "v"), EVENTS, ["v"])
    assert count(out, "Exchange") == 1 and "Join" not in plan(out)
    assert "PushedFilters" in plan(out) and "EqualTo(event_type,click)" in plan(out)


def test_recurrences_share_a_pass(spark, sf_dir):
    p = Pipeline(EVENTS).add("a", "mean_ew", "v", span=4).add("b", "std_ew", "v", "a", span=4).add("c", "max_ew", "v", "a", span=8)
    df = p.apply(events(spark, sf_dir).select("user_id", "ts", "event_id", "v"))
    assert count(df, "MapInArrow") == 1 and count(df, "Exchange") == 1
    one = fold.fold(events(spark, sf_dir), EVENTS, [fold.mean_ew("a", "v", span=4)])
    assert count(one, "MapInArrow") == 1


def test_gates_are_filters(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("d", F.to_date("o_orderdate"))
    df = triggers.on(orders, "month_end", "d")
    assert "Exchange" not in plan(df) and "Filter" in plan(df)


def test_bars_are_read_by_symbol_and_day(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 4).cast("string").alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 4).cast("int")).alias("date"), *[F.col("id").cast("double").alias(f) for f in bars.FIELDS])
    bars.write_bars(rows, str(tmp_path / "bars"))
    df = bars.read_bars(spark, str(tmp_path / "bars"), ["1"], "2024-01-03", "2024-01-05").select("date", "close")
    text = plan(df)
    assert re.search(r"PartitionFilters: \[.*symbol", text) and "GreaterThanOrEqual(date,2024-01-03)" in text
    assert re.search(r"ReadSchema: struct<date:date,close:double>", text)
    assert df.count() == 3
