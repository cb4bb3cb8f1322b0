"""Recurrences, last-n, barriers, bars and sessions over streams, with the state of each key kept by Spark.

Rows of a micro-batch are put in time order for each key; rows that are older
than what their key has already seen are dropped, as they have no place in an
ordered recurrence.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.operators.fold import Recurrence, passes
from tideline.series import Series

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State partitions for each core, and at least: every micro-batch opens, commits and hands to a Python worker each of them, with rows or without.
PER_CORE, LEAST_PARTITIONS = 2, 16


def _by_key(stream: DataFrame, s: Series, added: str, idle_ms: int | None, work: Callable[[pd.DataFrame, object], object]) -> DataFrame:
    """``stream`` with what ``work(frame, held)`` adds to each key's new rows in order; it returns what to hold.

    A frame has one key's rows of a micro-batch, which the source's limits on files
    or bytes for each trigger bound. Rows that are not later than what the key has
    seen are dropped. idle_ms: a key without rows for so long is forgotten, and
    starts anew with its next row; without it, keys are held for ever. It is for
    streams that stay up: one that is to stop when drained would wait for its keys.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema), added])
    order = list(s.order)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        df = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        seen, held = pickle.loads(state.get[0]) if state.exists else (None, None)
        if seen is not None:
            df = df[[tuple(r) > seen for r in df[order].itertuples(index=False)]].reset_index(drop=True)
        if len(df):
            held = work(df, held)
            state.update((pickle.dumps((tuple(df[order].iloc[-1]), held)),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if len(df):
            yield df

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(*s.keys).applyInPandasWithState(run, schema, "state binary", "append", timeout)


def fold_stream(stream: DataFrame, s: Series, recurrences: Sequence[Recurrence], idle_ms: int | None = None) -> DataFrame:
    """``stream`` with one column for each recurrence; equal to fold() on the same rows in order.

    For times that are no timestamps; recurrences that feed on each other are ordered.fold_in_order's.
    """
    if any(len(g) > 1 or recurrences[g[0]].name in recurrences[g[0]].inputs for g in passes(recurrences, stream.columns)):
        raise ValueError("recurrences feed on each other")

    def work(df: pd.DataFrame, states: object) -> object:
        states = states or [None] * len(recurrences)
        for i, r in enumerate(recurrences):
            got, st = [], states[i]
            for xs in zip(*(df[c].astype(object).where(df[c].notna(), None) for c in r.inputs)):
                st, x = r.step(st, *xs)
                got.append(x)
            states[i] = st
            df[r.name] = pd.Series(got, dtype="float64" if r.type == "double" else "object")
        return states

    return _by_key(stream, s, ", ".join(f"`{r.name}` {r.type}" for r in recurrences), idle_ms, work)


def last_n_stream(stream: DataFrame, s: Series, v: str, n: int, idle_ms: int | None = None) -> DataFrame:
    """``stream`` with last_n, the newest n values oldest first."""

    def work(df: pd.DataFrame, held: object) -> object:
        held, rows = held or [], []
        for x in df[v]:
            held = [*held, None if pd.isna(x) else float(x)][-n:]
            rows.append([None] * (n - len(held)) + held)
        df["last_n"] = rows
        return held

    return _by_key(stream, s, "last_n array<double>", idle_ms, work)


def barrier_stream(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """Inner join of two streams on keys and equal time; state older than ``delay`` is let go."""
    return left.withWatermark(time, delay).join(right.withWatermark(time, delay), [*keys, time])


def bars_stream(stream: DataFrame, keys: Sequence[str], time: str, value: str, width: str, delay: str) -> DataFrame:
    """High, low, sum and count of each key and time window; rows later than ``delay`` are dropped."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(*keys, F.window(time, width))
        .agg(F.max(value).alias("high"), F.min(value).alias("low"), F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "high", "low", "total", "n")
    )


def sessions_stream(stream: DataFrame, keys: Sequence[str], time: str, gap: str, delay: str) -> DataFrame:
    """Count of each key's stretches without a pause of ``gap``."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(*keys, F.session_window(time, gap))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Drain what is there, batch by batch, into ``sink(batch, id)``, then stop.

    State is kept by RocksDB, on local disk and in the checkpoint, so it need not fit in memory.
    It has as many partitions as the session's shuffles, but no more than the cores can use;
    a checkpoint that is there keeps its own number.
    """
    spark = stream.sparkSession
    conf, shuffles = spark.conf, "spark.sql.shuffle.partitions"
    most = max(LEAST_PARTITIONS, PER_CORE * spark.sparkContext.defaultParallelism)
    own = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, shuffles: str(min(most, int(conf.get(shuffles))))}
    before = {name: conf.get(name) for name in own}
    for name, value in own.items():  # a query takes the settings of its start along
        conf.set(name, value)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            conf.set(name, value)
    query.awaitTermination()
