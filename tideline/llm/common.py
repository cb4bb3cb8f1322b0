"""Shared helpers: the cluster's shared folder, written tables, connected components."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.folders import shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    Used where a result is read more than once or where an iteration would
    otherwise grow its plan. The shuffle files of the finished write are let go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def bucketed(df: DataFrame, by: str, buckets: int, name: str) -> DataFrame:
    """Like materialise(), dealt into ``buckets`` by the column ``by``: joins on it leave the table where it is.

    The table's entry in the catalogue goes at once; its files are dealt with by discard().
    """
    spark = df.sparkSession
    tag = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/{name}-{tag}"
    dealt = df.repartition(buckets, by).write.bucketBy(buckets, by).option("path", path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        dealt.saveAsTable(f"tideline_{tag}", format="parquet")
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.table(f"tideline_{tag}")
    spark.sql(f"DROP TABLE tideline_{tag}")
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() or bucketed() wrote for these tables; nothing may read them any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that operators wrote in this application; for the end of a job, when results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of whole texts that go to a Python worker at a time, at most.
TEXT_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends batches of TEXT_ROWS rows at most to Python workers.

    Spark's own number of rows suits numbers; of texts it holds several copies of
    tens of megabytes in a task, which a worker that is used again does not give back.
    """
    now = int(df.sparkSession.conf.get(_BATCH))
    if not 0 < now <= TEXT_ROWS:
        df.sparkSession.conf.set(_BATCH, str(TEXT_ROWS))
    return df


def sliced(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows at most: what a task makes of texts it holds for so many at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def kept_in_worker(name: str, make: Callable[[], object]) -> object:
    """An object that a Python worker makes once, however many tasks it runs; what ``make`` gives has a bounded size.

    This package's functions come to a worker with each task, so they have no module there that could hold it.
    """
    home = sys.modules.setdefault("tideline_kept", ModuleType("tideline_kept")).__dict__
    if name not in home:
        home[name] = make()
    return home[name]


def utf8(column: str | Column) -> Column:
    """The UTF-8 bytes of a text column; null stays null."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def row_count(df: DataFrame) -> int:
    return df.select(F.count(F.lit(1)).alias("n")).first()["n"]


#: Rows of narrow tables (a few longs each) that may be broadcast: some 10 MB.
BROADCAST_ROWS = 200_000


def join_counted(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` with a narrow table that is written and counted first."""
    return join_written(big, materialise(small, "side"), on, how, limit)


def join_written(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` with a narrow, written table.

    Up to ``limit`` rows it is broadcast, so a key that holds a large part of
    ``big`` needs no shuffle. Beyond, both sides are shuffled; as neither is the
    result of an aggregation in the same stage, adaptive execution can split hot keys.
    """
    return big.join(F.broadcast(small) if row_count(small) <= limit else small.hint("merge"), on, how)


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(a, b)`` edges over long ids -> ``(node, label)``, the smallest id reachable; a written table.

    Alternating large-star and small-star contraction, in which edges always lead
    to smaller ids. The edge list is written to the shared folder after each half
    round, the one before is deleted, and the loop ends when it consists of stars.
    Nodes without edges do not appear.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    step = materialise(edges.distinct(), "edges")
    for _ in range(max_rounds):
        if _are_stars(step):
            break
        # large star: each larger neighbour goes to the smallest of the closed neighbourhood
        both = step.select("u", "v").union(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "side")
        large = join_written(both, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "edges")
        discard(step, low)
        # small star: smaller neighbours and the node itself go to the smallest one
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "side")
        small = join_written(large, least, ["u"])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        step = materialise(small.where("u <> v").distinct(), "edges")
        discard(large, least)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = step.select(F.col("v").alias("node")).distinct()
    out = materialise(step.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots.select("node", F.col("node").alias("label"))), "labels")
    discard(step)
    return out


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node leads to one other at most, and only to such as lead nowhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("hub")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("hub").alias("hub"))
    return nodes.where("out > 1 or (out = 1 and hub = 1)").limit(1).count() == 0


def in_order(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` and at, their place in the order, gapless from 0; rows equal in the order stand side by side.

    Rows are dealt by ranges of the order and, where that is equal, by a row number,
    so no key is one task's work. A written table fixes partitions and places in
    them; one number for each partition shifts these.
    """
    marked = materialise(rows.withColumn("tie", F.monotonically_increasing_id()), name)
    by = [*(F.col(c).asc_nulls_first() for c in order), F.col("tie")]
    dealt = marked.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    table = materialise(dealt.drop("tie"), name)
    dealt = table.withColumn("part", F.shiftright("place", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    discard(marked)
    out = dealt.join(F.broadcast(starts), "part").withColumn("at", F.col("from") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "from", "place")
    out.written = table.written  # for discard()
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): a number of its own for every row, and the row's columns as a struct, whatever their names.

    Written, so that a task that runs again cannot change the numbers.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return materialise(docs.select(F.monotonically_increasing_id().alias("row"), row.alias("doc")), "rows")


def least_rows(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """One row of each part, as it was: the one of the smallest key, of these the one of the smallest number.

    rows: as from numbered(). parts: (row, key, part). Null keys come last.
    """
    first = parts.groupBy("part").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("least"))
    return join_counted(rows, first.select("least.row"), ["row"], "left_semi").select("doc.*")
