"""Spines, constants and seeded noise."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from pickle import dumps, loads

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.folders import shared_dir
from tideline.sources.tables import with_id


def times(spark: SparkSession, keys: int, n: int, step: float = 1.0, start: float = 0.0) -> DataFrame:
    """(key, i, t): n events for each of some keys, ``step`` apart."""
    return spark.range(keys * n).select((F.col("id") / n).cast("long").alias("key"), (F.col("id") % n).cast("int").alias("i")).withColumn("t", F.lit(start) + F.col("i") * F.lit(step))


def const(spine: DataFrame, value: float, name: str = "v") -> DataFrame:
    return spine.withColumn(name, F.lit(float(value)))


def calendar(spark: SparkSession, start: str, end: str, days: int = 1) -> DataFrame:
    """Dates from start to end, every ``days``; the last is not after ``end``."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.make_interval(days=F.lit(days)))).alias("date"))


def uniform(seed: int | str, *by: str) -> Column:
    """In (0, 1), from 52 bits of md5(seed:by:by...): a row's number depends on its key alone, wherever it is made."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in by])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def gaussian(seed: int, *by: str, mean: float = 0.0, std: float = 1.0, part: int = 0) -> Column:
    """Normal, by two uniform numbers of the row that ``by`` names; ``part`` tells the numbers of one row apart."""
    u, v = uniform(f"{seed}:{part}:r", *by), uniform(f"{seed}:{part}:a", *by)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v) * F.lit(float(std)) + F.lit(float(mean))


def gaussian_vec(seed: int, n: int, *by: str, mean: float = 0.0, std: float = 1.0, part: int = 0) -> Column:
    return F.array(*[gaussian(seed, *by, mean=mean, std=std, part=part + i) for i in range(n)])


def gaussian_mat(seed: int, rows: int, cols: int, *by: str, mean: float = 0.0, std: float = 1.0) -> Column:
    return F.array(*[gaussian_vec(seed, cols, *by, mean=mean, std=std, part=i * cols) for i in range(rows)])


def walk(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], noise: Column, name: str = "v", shape: Sequence[int] = ()) -> DataFrame:
    """The running sum of noise along each key, element by element for a vector's or matrix's shape."""
    names = lambda x: [x] if isinstance(x, str) else list(x)
    w = Window.partitionBy(*names(key)).orderBy(*names(order)).rowsBetween(Window.unboundedPreceding, 0)

    def summed(e: Column, shape: Sequence[int]) -> Column:
        return F.array(*[summed(F.get(e, F.lit(i)), shape[1:]) for i in range(shape[0])]) if shape else F.sum(e).over(w)

    return df.withColumn("_e", noise).withColumn(name, summed(F.col("_e"), shape)).drop("_e")


def gaussian_walk_vec(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], seed: int, n: int, *by: str, mean: float = 0.0, std: float = 1.0, name: str = "v") -> DataFrame:
    return walk(df, key, order, gaussian_vec(seed, n, *by, mean=mean, std=std), name, (n,))


def gaussian_walk_mat(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], seed: int, rows: int, cols: int, *by: str, mean: float = 0.0, std: float = 1.0, name: str = "v") -> DataFrame:
    return walk(df, key, order, gaussian_mat(seed, rows, cols, *by, mean=mean, std=std), name, (rows, cols))


def random_times(spark: SparkSession, keys: int, n: int, seed: int, mean: float = 1.0, std: float = 0.1) -> DataFrame:
    """Events whose distances are normal."""
    return walk(times(spark, keys, n).drop("t"), "key", "i", gaussian(seed, "key", "i", mean=mean, std=std), "t")


def every(keys: DataFrame, n: int, step: float = 1.0, start: float = 0.0) -> DataFrame:
    """``keys`` with i and t: n events for each row, ``step`` apart."""
    return keys.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.lit(start) + F.col("i") * F.lit(step))


def calendar_of(df: DataFrame, date: str, days: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Dates from a table's first to its last, every ``days``; of each key its own."""
    ends = df.groupBy(*keys).agg(F.min(F.col(date).cast("date")).alias("_a"), F.max(F.col(date).cast("date")).alias("_b")).where("_a is not null")
    return ends.select(*keys, F.explode(F.sequence("_a", "_b", F.make_interval(days=F.lit(days)))).alias("date"))


#: Draws between two states that are noted of a stream of normal numbers.
STATE_EVERY = 1 << 16


def shared_stream(df: DataFrame, order: Sequence[str], seed: int, names: Sequence[str], normal: bool = True, mean: float = 0.0, std: float = 1.0) -> DataFrame:
    """``df`` with a column for each of ``names``, drawn from numpy's ``default_rng(seed)`` as one stream.

    Rows draw in the given order, the names of a row one after the other, so the
    numbers are those of ``default_rng(seed).normal(mean, std, (rows, names))``, or
    of ``random`` where not ``normal``, bit by bit, however the rows are dealt; rows
    equal in the order are told apart as by with_id(). Uniform numbers take one step
    each, so a task jumps to its own. Normal ones take one or more: one task runs
    through the stream alone (some 10 ns a draw) and notes its state now and then,
    and others go on from there.
    """
    spark, m = df.sparkSession, len(names)
    rows = with_id(df, order, "_id")
    if normal:
        n = rows.select(F.count(F.lit(1)).alias("n"))

        def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for total in b.column(0).to_pylist():
                    rng = np.random.default_rng(seed)
                    for block in range(-(-total * m // STATE_EVERY)):
                        yield pa.RecordBatch.from_pydict({"_block": [block], "_state": [dumps(rng.bit_generator.state)]})
                        rng.standard_normal(STATE_EVERY)

        path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        n.mapInArrow(states, "_block long, _state binary").write.parquet(path)
        noted = spark.read.schema("_block long, _state binary").parquet(path)
        block = F.floor((F.col("_id") - 1) * m / STATE_EVERY).cast("long")
        # one row of some 200 bytes for each STATE_EVERY draws
        rows = rows.withColumn("_block", block).join(noted, "_block")
    kept = df.columns
    at = rows.columns.index("_id")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, reached = None, -1
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(at).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(ids) != 1) + 1).tolist(), len(ids)]
            got = np.empty((len(ids), m))
            for lo, hi in zip(edges, edges[1:]):
                first = (int(ids[lo]) - 1) * m
                if rng is None or first != reached:
                    rng = np.random.default_rng(seed)
                    if normal:
                        rng.bit_generator.state = loads(b.column("_state")[lo].as_py())
                        rng.standard_normal(first % STATE_EVERY)
                    else:
                        rng.bit_generator.advance(first)
                k = (hi - lo) * m
                got[lo:hi] = (rng.normal(mean, std, k) if normal else rng.random(k)).reshape(-1, m)
                reached = first + k
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(got[:, i]) for i in range(m))], [*kept, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{x}` double" for x in names)])
    return rows.sortWithinPartitions("_id").mapInArrow(draw, schema)
