"""Which parts of a date range are still to be fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days of a stretch of time in which wanted and done ranges are brought together.
MEET_DAYS = 64


def required_ranges(wanted: DataFrame, done: DataFrame, key: str, batch_days: int = 20) -> DataFrame:
    """(key, start, end): the days of each wanted [start, end] that no done range covers, in stretches of ``batch_days`` at most.

    Gaps and islands: a gap opens where a range begins after all before it have ended.
    Done ranges that touch are first made one. A wanted range meets those that reach
    into the same MEET_DAYS as it does, not all of its key.
    """
    of_key = Window.partitionBy(key).orderBy("start", "end")
    fresh = F.col("start") > F.date_add(F.max("end").over(of_key.rowsBetween(Window.unboundedPreceding, -1)), 1)
    islands = done.select(key, "start", "end").withColumn("_f", fresh.cast("int")).withColumn("_i", F.sum("_f").over(of_key.rowsBetween(Window.unboundedPreceding, 0)))
    done = islands.groupBy(key, F.coalesce("_i", F.lit(0)).alias("_i")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    # ranges meet in stretches of time, in the first one that both reach into
    first, last = (lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / MEET_DAYS)), (lambda a, z: F.explode(F.sequence(a, z)))
    asked = wanted.select(key, F.col("start").alias("_a"), F.col("end").alias("_z")).where("_a <= _z")
    asked = asked.distinct().withColumn("_m", last(first(F.col("_a")), first(F.col("_z"))))
    held = done.select(key, "start", "end").withColumn("_m", last(first(F.col("start")), first(F.col("end"))))
    clipped = (
        asked.join(held, [key, "_m"])
        .where(F.col("_m") == F.greatest(first(F.col("_a")), first(F.col("start"))))
        .withColumns({"s": F.greatest("start", "_a"), "e": F.least("end", "_z")})
        .where("s <= e")
    )
    # a day before the wanted range and one after it close the ends
    ends = wanted.select(key, F.col("start").alias("_a"), F.col("end").alias("_z"), F.explode(F.array(F.struct(F.date_sub("start", 1).alias("s"), F.date_sub("start", 1).alias("e")), F.struct(F.date_add("end", 1).alias("s"), F.date_add("end", 1).alias("e")))).alias("x"))
    rows = clipped.select(key, "_a", "_z", "s", "e").union(ends.select(key, "_a", "_z", "x.s", "x.e"))
    w = Window.partitionBy(key, "_a", "_z").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    gaps = rows.withColumn("_p", F.max("e").over(w)).where(F.col("s") > F.date_add("_p", 1))
    gaps = gaps.select(key, F.date_add("_p", 1).alias("start"), F.date_sub("s", 1).alias("end"))
    cut = gaps.withColumn("_s", F.explode(F.sequence("start", "end", F.make_interval(days=F.lit(batch_days)))))
    return cut.select(key, F.col("_s").alias("start"), F.least("end", F.date_add("_s", batch_days - 1)).alias("end"))


def fill_missing(bars: DataFrame, ranges: DataFrame, key: str, date: str = "date") -> DataFrame:
    """``bars`` and a row of NULLs for each day of the done ranges that has none."""
    days = ranges.select(key, F.explode(F.sequence("start", "end", F.make_interval(days=F.lit(1)))).alias(date)).distinct()
    return bars.unionByName(days.join(bars.select(key, date), [key, date], "left_anti"), allowMissingColumns=True)


def mark_done(queries: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``done`` set where the query's id is in ``ids``."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return queries.join(hit, key, "left").withColumn("done", F.coalesce("_hit", "done")).drop("_hit")
