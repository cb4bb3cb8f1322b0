"""Daily bars in zip archives as a Spark data source: members are dealt to partitions by their sizes and read line by line."""

from __future__ import annotations

import csv
import io
import os
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tideline.sources.bars import FIELDS, SCHEMA

#: Rows that are handed on at a time.
ROWS = 8_192
#: Unpacked bytes that a partition has at most, unless one member has more, and those that opening a member counts for.
PARTITION_BYTES, MEMBER_BYTES = 64 << 20, 64 << 10
_TYPES = pa.schema([("symbol", pa.string()), ("date", pa.date32()), *((f, pa.float64()) for f in FIELDS)])


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address that Arrow knows, or the local one."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _symbol(member: str) -> str:
    return os.path.splitext(os.path.basename(member))[0]


@dataclass
class Members(InputPartition):
    """(archive, member) pairs, those of an archive side by side."""

    names: list[tuple[str, str]]


class ArchiveReader(DataSourceReader):
    """Wanted symbols decide which members are opened, wanted days which lines become rows."""

    def __init__(self, options: dict[str, str]):
        self.path, self.pattern, self.one = options["path"], options.get("pattern", ""), options.get("one", "false").lower() == "true"
        self.format = options.get("dateformat", "%Y-%m-%d")
        self.cores = int(options.get("cores", "8"))
        self.symbols: set[str] | None = set(options["symbols"].split(",")) if options.get("symbols") else None
        self.start = date.fromisoformat(options["start"]) if options.get("start") else None
        self.end = date.fromisoformat(options["end"]) if options.get("end") else None

    def partitions(self) -> list[Members]:
        """Members whose names hold the pattern and whose symbols are wanted; only the archives' directories are read.

        As Spark does with files, as many partitions as there are cores are filled, of
        more bytes than one holds there are more: partitions grow with the bytes, not
        with the number of members.
        """
        system, path = _opened(self.path)
        found = system.get_file_info(path)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        sizes: dict[tuple[str, str], int] = {}
        for f in sorted((f.path for f in files if f.is_file and f.path.endswith(".zip"))):
            with system.open_input_file(f) as raw, zipfile.ZipFile(raw) as z:
                members = [(m.filename, m.file_size) for m in z.infolist() if self.pattern in m.filename and not m.is_dir()]
            if self.one and len(members) != 1:
                raise ValueError(f"{f}: {len(members)} members hold {self.pattern!r}, not one")
            sizes |= {(f, m): n + MEMBER_BYTES for m, n in members if self.symbols is None or _symbol(m) in self.symbols}
        most = min(PARTITION_BYTES, max(MEMBER_BYTES, sum(sizes.values()) // self.cores))
        out, room = [], 0
        for name, n in sizes.items():
            if not out or n > room:
                out.append(Members([]))
                room = most
            out[-1].names.append(name)
            room -= n
        return out

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no member is wanted
            return
        system, _ = _opened(self.path)
        rows = []
        for archive, names in groupby(partition.names, itemgetter(0)):
            with system.open_input_file(archive) as raw, zipfile.ZipFile(raw) as z:
                for _, name in names:
                    with z.open(name) as member:
                        for row in self._rows(_symbol(name), member):
                            rows.append(row)
                            if len(rows) == ROWS:
                                yield self._batch(rows)
                                rows = []
        if rows:
            yield self._batch(rows)

    def _rows(self, symbol: str, member: io.BufferedIOBase) -> Iterator[tuple]:
        for line in csv.reader(io.TextIOWrapper(member, "utf-8", newline="")):
            if not line:
                continue
            day = datetime.strptime(line[0].strip(), self.format).date()
            if (self.start is None or day >= self.start) and (self.end is None or day <= self.end):
                numbers = [float(x) if x.strip() else None for x in line[1 : 1 + len(FIELDS)]]
                yield symbol, day, *numbers, *[None] * (len(FIELDS) - len(numbers))

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TYPES)], schema=_TYPES)


class PushedReader(ArchiveReader):
    """Takes conditions of where(), too; Spark has such readers only where its setting for them is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equalities and lists of symbols, and bounds of days; returns the others."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "symbol" and isinstance(f, (EqualTo, In)):
                these = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = these if self.symbols is None else self.symbols & these
            elif column == "date" and isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual)):
                if not isinstance(f, LessThanOrEqual):
                    self.start = f.value if self.start is None else max(self.start, f.value)
                if not isinstance(f, GreaterThanOrEqual):
                    self.end = f.value if self.end is None else min(self.end, f.value)
            elif column == "date" and isinstance(f, (GreaterThan, LessThan)):
                if isinstance(f, GreaterThan):
                    self.start = f.value if self.start is None else max(self.start, f.value)
                else:
                    self.end = f.value if self.end is None else min(self.end, f.value)
                yield f  # the bound itself is left to Spark
            else:
                yield f


class BarArchives(DataSource):
    """``spark.read.format("bar_archives")``; options: path, pattern, one, dateFormat, symbols, start, end, cores (partitions are at least so many, if members are), and pushed (true: conditions are taken)."""

    @classmethod
    def name(cls) -> str:
        return "bar_archives"

    def schema(self) -> str:
        return f"symbol string, {SCHEMA}"

    def reader(self, schema) -> ArchiveReader:
        return (PushedReader if self.options.get("pushed") == "true" else ArchiveReader)(self.options)


def read_archives(spark: SparkSession, path: str, pattern: str = "", one: bool = False, symbols: Iterable[str] | None = None, start: str | None = None, end: str | None = None, date_format: str = "%Y-%m-%d") -> DataFrame:
    """(symbol, date, fields) of the headerless delimited members of zip archives; symbol is the member's name.

    path: an archive or a folder of them, on a file system that Arrow reads (local,
    s3, gs, hdfs). Members are dealt to partitions by their sizes and are streamed; archives
    are never read whole. Only members of ``symbols`` are opened. With
    spark.sql.python.filterPushdown.enabled conditions in where() count likewise.
    one: each archive must have exactly one member that holds ``pattern``.
    """
    spark.dataSource.register(BarArchives)
    given = {"pattern": pattern, "one": str(one).lower(), "dateFormat": date_format, "symbols": ",".join(symbols) if symbols is not None else None, "start": start, "end": end, "cores": str(spark.sparkContext.defaultParallelism), "pushed": spark.conf.get("spark.sql.python.filterPushdown.enabled")}
    return spark.read.format("bar_archives").options(**{k: v for k, v in given.items() if v is not None}).load(path)


def write_archives(bars: DataFrame, path: str, archive: str, fields: Sequence[str] = FIELDS) -> None:
    """Headerless members, one for each symbol, in one zip archive for each value of the column ``archive``.

    An archive is one task's work and is written symbol by symbol; a task that runs
    again writes the same file.
    """
    names = [archive, "symbol", "date", *fields]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _opened(path)
        system.create_dir(folder, recursive=True)
        now = opened = out = member = None
        n = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:2] != now:
                    if member is not None:
                        member.close()
                    if now is None or row[0] != now[0]:
                        if opened is not None:
                            out.close()
                            opened.close()
                        opened = system.open_output_stream(f"{folder}/{row[0]}.zip")
                        out = zipfile.ZipFile(opened, "w", zipfile.ZIP_DEFLATED)
                        n += 1
                    now, member = row[:2], out.open(f"{row[1]}.txt", "w")
                member.write((",".join("" if x is None else str(x) for x in row[2:]) + "\n").encode())
        for x in (member, out, opened):
            if x is not None:
                x.close()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows = bars.select(*names).repartition(archive).sortWithinPartitions(archive, "symbol", "date")
    rows.mapInArrow(write, "n long").agg({"n": "sum"}).collect()
