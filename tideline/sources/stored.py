"""Keyed tables on storage: versions that are there as a whole or not at all, and a store of bars that fetches each day once.

A table is a folder of Parquet folders and of small version files, each of which
names the folders that make up the table. A change writes its own folder, then a
version file under a name of its own, and renames that into place: who reads sees
the version before or the one after, and of two writers from one version the second
fails. Columns that came later are NULL in older rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources import gaps


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class Stored:
    """A table of rows with a unique key at a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The number of the newest version, 0 for a table that is not there yet."""
        if not self._fs.exists(self._at("_versions")):
            return 0
        return max((int(n) for f in self._fs.listStatus(self._at("_versions")) if (n := f.getPath().getName()).isdigit()), default=0)

    def parts(self, version: int | None = None) -> tuple[list[str], str | None]:
        """The folders of a version, and its schema."""
        version = self.version() if version is None else version
        if not version:
            return [], None
        stream = self._fs.open(self._at(f"_versions/{version:08d}"))
        try:
            made = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return made["parts"], made["schema"]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        parts, schema = self.parts(version)
        if schema is None:
            raise ValueError(f"no table at {self.path}")
        kind = self.spark.createDataFrame([], "x int").schema.fromJson(json.loads(schema))
        if not parts:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{p}" for p in parts])

    def _commit(self, base: int, parts: Sequence[str], schema: str) -> int:
        held = self._at(f"_versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(held)
        try:
            stream.write(bytearray(json.dumps({"parts": list(parts), "schema": schema}).encode()))
        finally:
            stream.close()
        if self._fs.exists(self._at(f"_versions/{base + 1:08d}")) or not self._fs.rename(held, self._at(f"_versions/{base + 1:08d}")):
            self._fs.delete(held, False)
            raise Conflict(f"version {base + 1} of {self.path} is there")
        return base + 1

    def _write(self, df: DataFrame) -> str:
        """A folder of its own, which no version names yet."""
        name = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def create(self, schema: str) -> int:
        """Make the table if it is not there, and add those columns that it lacks; the version."""
        base = self.version()
        wanted = self.spark.createDataFrame([], schema)
        parts, now = self.parts(base)
        kept = self.read(base).limit(0) if now else wanted
        if now and not set(wanted.columns) - set(kept.columns):
            return base
        return self._commit(base, parts, kept.unionByName(wanted, allowMissingColumns=True).schema.json())

    def _schema(self, base: int, new: DataFrame) -> str:
        """The table's columns and those that ``new`` brings."""
        _, now = self.parts(base)
        return (self.read(base).limit(0).unionByName(new.limit(0), allowMissingColumns=True) if now else new).schema.json()

    def insert(self, new: DataFrame, replace: bool = False) -> int:
        """Rows whose keys are new; with ``replace`` those of known keys take the old ones' place. The version.

        Of several new rows of one key the least is taken. Without ``replace`` only
        the new rows are written.
        """
        base = self.version()
        parts, _ = self.parts(base)
        rest = [c for c in new.columns if c not in self.key]
        once = new.groupBy(*self.key).agg(F.min(F.struct(*rest)).alias("_r")).select(*self.key, "_r.*") if rest else new.distinct()
        schema = self._schema(base, once)
        if not parts:
            return self._commit(base, [self._write(once)], schema)
        old = self.read(base)
        if replace:
            whole = old.join(once.select(*self.key), self.key, "left_anti").unionByName(once, allowMissingColumns=True)
            return self._commit(base, [self._write(whole)], schema)
        return self._commit(base, [*parts, self._write(once.join(old.select(*self.key), self.key, "left_anti"))], schema)

    def delete(self, condition: str = "true", joins: Mapping[str, tuple[DataFrame, str]] | None = None) -> int:
        """Delete rows for which ``condition`` holds; the version.

        joins: other tables by name, each with the condition on which it is joined;
        columns are written t.column for this table's and name.column for others. A
        row goes if it meets the condition with any joined rows: a semi-join on the
        key, so nothing is deleted twice or multiplied.
        """
        base = self.version()
        t = self.read(base).alias("t")
        met = reduce(lambda df, x: df.join(x[1][0].alias(x[0]), F.expr(x[1][1])), (joins or {}).items(), t).where(condition)
        gone = met.select(*[F.col(f"t.`{k}`").alias(k) for k in self.key]).distinct()
        return self._commit(base, [self._write(self.read(base).join(gone, self.key, "left_anti"))], self.parts(base)[1])

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders that none of the newest ``keep`` versions names, and older versions; how many folders went.

        For times at which nobody writes or reads an older version.
        """
        newest = self.version()
        used = {p for v in range(max(1, newest - keep + 1), newest + 1) for p in self.parts(v)[0]}
        gone = 0
        for f in self._fs.listStatus(self._at("")) if newest else []:
            name = f.getPath().getName()
            if name.startswith("part-") and name not in used:
                gone += self._fs.delete(f.getPath(), True)
        for v in range(1, newest - keep + 1):
            self._fs.delete(self._at(f"_versions/{v:08d}"), False)
        return gone


def cached_bars(spark: SparkSession, path: str, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("symbol",), batch_days: int = 20) -> DataFrame:
    """Bars of wanted (keys, start, end), of which only days that were never fetched are fetched now.

    fetch: (key columns, start, end) in stretches of ``batch_days`` at most -> bars
    (keys, date, ...). Days of a range that it has no bar for get a row of NULLs, so
    they are known to be empty. Bars are stored before the ranges are noted as done,
    and known days are left as they are: a run that failed in between fetches again
    and stores nothing twice.
    """
    keys = list(keys)
    store, done = Stored(spark, f"{path}/bars", [*keys, "date"]), Stored(spark, f"{path}/done", [*keys, "start", "end"])
    id_ = F.to_json(F.struct(*keys))
    kinds = [f"`{k}` {wanted.schema[k].dataType.simpleString()}" for k in keys]
    done.create(", ".join([*kinds, "start date", "end date"]))
    ranges = gaps.required_ranges(wanted.withColumn("_id", id_), done.read().withColumn("_id", id_), "_id", batch_days).distinct()
    named = ranges.withColumn("_k", F.from_json("_id", ", ".join(kinds))).select(*[F.col(f"_k.`{k}`").alias(k) for k in keys], "start", "end")
    needed = Stored(spark, f"{path}/asked/{uuid.uuid4().hex}", done.key)  # fetch() may be no function of its input: it is asked once
    needed.insert(named)
    if needed.read().limit(1).count():
        bars = fetch(needed.read())
        days = needed.read().select(*keys, F.explode(F.sequence("start", "end")).alias("date")).distinct()
        store.insert(days.join(bars, [*keys, "date"], "left"))
        done.insert(needed.read())
    asked = wanted.select(*keys, F.explode(F.sequence("start", "end")).alias("date")).distinct()
    return store.read().join(asked, [*keys, "date"], "left_semi")
