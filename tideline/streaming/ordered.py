"""Operators on live streams in the order of event time: rows wait until the watermark says that none can come before them.

Keys are dealt to shards, each of which is one group of the stateful operator, so a
micro-batch costs by its rows, not by a timer and a buffer for each key. A shard's
waiting rows are kept in sorted runs, cut into parts that are written once, and a
timer wakes the shard when the watermark reaches the first of them. Then the runs are
merged, so memory holds a part of each run, and what is held of the shard's keys. State is kept by RocksDB.

Rows later than the delay are dropped by Spark; rows without a time are left out.
A stream's last rows wait for later ones: a heartbeat, a row of any key whose time
lies beyond the delay, lets them go.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush, heapreplace
from itertools import islice
from pickle import dumps, loads
from zlib import crc32

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tideline.operators.fold import Recurrence, passes
from tideline.series import Series

#: Groups that keys are dealt to; a stream keeps this number for good.
SHARDS = 512
#: Rows of one part of a shard's buffer, and parts of one sorted run.
PART_ROWS, RUN_PARTS = 500, 100
#: Records that a shard's states are held in: one is read and written as a whole.
PAGES = 32
_TIME, _SIDE, _SHARD = "_t", "_side", "_shard"


def micros(duration: str) -> int:
    """Microseconds of ``3 hours``, ``90 seconds``, ``1 day`` and the like."""
    n, unit = duration.split()
    return int(float(n) * {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}[unit.rstrip("s")])


class InOrder(StatefulProcessor):
    """Hands a key's rows on in order of (time, side, tiebreak); see take().

    columns: of the input, among them _TIME in microseconds, which comes first in
    the order. width: the time that a part spans at most. forget: a row that comes so
    long after the one before it finds a new key, and what is held of keys that are
    silent for so long is cleared, an eighth of it later at most.
    """

    def __init__(self, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], out: Sequence[str], width: int | None, forget: int | None):
        self.columns, self.keys, self.order, self.out, self.width, self.forget = list(columns), list(keys), list(order), list(out), width, forget
        self.part_rows, self.run_rows = PART_ROWS, PART_ROWS * RUN_PARTS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "first long, part long", "rows binary")
        self.held = handle.getMapState("held", "page int", "states binary")
        self.marks = handle.getValueState("marks", "next_part long, timer long, sweep long")
        self.at = self.columns.index(_TIME)
        self.key_at = [self.columns.index(c) for c in self.keys]
        self.places = [self.columns.index(c) for c in self.order if c != _TIME]
        self.pick = [i for i, c in enumerate(self.columns) if c in self.out]
        self.row = Row(*self.out)
        self.open()

    def open(self) -> None:
        """Find the places of columns."""

    def take(self, state: object, row: tuple) -> tuple[object, tuple | None]:
        """A key's new state (None at first; never changed in place), and what to add to a row that has come to its turn; None: the row goes no further."""
        raise NotImplementedError

    def _rank(self, row: tuple) -> tuple:
        return row[self.at], *[(row[i] is not None, row[i]) for i in self.places]

    def _wake(self, timer: int, at: int | None) -> int:
        """Move the shard's timer from ``timer`` to ``at`` milliseconds; -1 is none."""
        if timer >= 0:
            self.handle.deleteTimer(timer)
        if at is None:
            return -1
        self.handle.registerTimer(at)
        return at

    def _store(self, rows: list[tuple], part: int) -> int:
        """Write sorted rows in parts; the next part's number."""
        start = 0
        while start < len(rows):
            end = start + self.part_rows
            if self.width is not None:
                end = min(end, bisect_right(rows, rows[start][self.at] + self.width, start, key=lambda r: r[self.at]))
            self.parts.updateValue((rows[start][self.at], part), (dumps(rows[start:end]),))
            start, part = end, part + 1
        return part

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        part, timer, sweep = self.marks.get() if self.marks.exists() else (0, -1, None)
        first = None
        rows = iter(rows)
        while run := sorted((tuple(r) for r in islice(rows, self.run_rows)), key=self._rank):
            part = self._store(run, part)
            first = run[0][self.at] if first is None else min(first, run[0][self.at])
        due = -(-first // 1000)
        if timer < 0 or due < timer:
            timer = self._wake(timer, due)
        self.marks.update((part, timer, sweep))
        return iter(())

    def _merged(self, due: list[tuple], limit: int, rest: list[tuple]) -> Iterator[tuple]:
        """Rows of parts up to ``limit`` in order; later ones are put into ``rest``."""
        heap: list[tuple] = []
        at = 0
        while True:
            while at < len(due) and (not heap or due[at][0] <= heap[0][0][0]):
                rows = loads(self.parts.getValue(due[at])[0])
                self.parts.removeKey(due[at])
                heappush(heap, (self._rank(rows[0]), at, 0, rows))
                at += 1
            if not heap or heap[0][0][0] > limit:
                break
            _, n, i, rows = heap[0]
            if i + 1 < len(rows):
                heapreplace(heap, (self._rank(rows[i + 1]), n, i + 1, rows))
            else:
                heappop(heap)
            yield rows[i]
        rest += sorted((r for _, _, i, rows in heap for r in rows[i:]), key=self._rank)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        part, _, sweep = self.marks.get()
        keys = sorted(tuple(k) for k in self.parts.keys())
        due = [k for k in keys if k[0] <= limit]
        later = [k[0] for k in keys[len(due) : len(due) + 1]]
        rest: list[tuple] = []
        pages: dict[int, dict[tuple, tuple]] = {}  # (newest, state) by key
        place: dict[tuple, dict[tuple, tuple]] = {}
        for r in self._merged(due, limit, rest):
            k = tuple(r[i] + 0.0 if isinstance(r[i], float) else r[i] for i in self.key_at)
            page = place.get(k)
            if page is None:
                n = crc32(repr(k).encode()) % PAGES
                if n not in pages:
                    pages[n] = loads(self.held.getValue((n,))[0]) if self.held.containsKey((n,)) else {}
                page = place[k] = pages[n]
            newest, state = page.get(k, (None, None))
            if self.forget is not None and newest is not None and r[self.at] - newest > self.forget:
                state = None
            state, more = self.take(state, r)
            page[k] = (r[self.at], state)
            if more is not None:
                yield self.row(*[r[i] for i in self.pick], *more)
        newest = [page[k][0] for k, page in place.items()]
        for n, page in pages.items():
            self.held.updateValue((n,), (dumps({k: x for k, x in page.items() if x[1] is not None}),))
        if rest:
            part = self._store(rest, part)
            later.append(rest[0][self.at])
        if self.forget is not None:
            sweep = self._swept(limit, sweep, newest)
            if sweep is not None:
                later.append(sweep)
            elif not later:
                self.marks.clear()
                return
        self.marks.update((part, self._wake(-1, -(-min(later) // 1000) if later else None), sweep))

    def _swept(self, limit: int, sweep: int | None, newest: list[int]) -> int | None:
        """Clear silent keys if it is time to; when it will be again, None if no key is held."""
        if sweep is None:
            if not newest:
                return None
            sweep = min(newest) + self.forget + 1000
        if limit < sweep:
            return sweep
        kept = []
        for n in [k[0] for k in self.held.keys()]:
            page = loads(self.held.getValue((n,))[0])
            left = {k: x for k, x in page.items() if x[0] + self.forget >= limit}
            kept += [x[0] for x in left.values()]
            if not left:
                self.held.removeKey((n,))
            elif len(left) < len(page):
                self.held.updateValue((n,), (dumps(left),))
        return max(min(kept) + self.forget + 1000, limit + self.forget // 8 + 1000) if kept else None


class _Fold(InOrder):
    """A key's state: that of each recurrence, and the row before where they feed on each other."""

    recurrences: Sequence[Recurrence]
    loops: bool

    def open(self) -> None:
        self.inputs = [[self.columns.index(c) if c in self.columns else c for c in r.inputs] for r in self.recurrences]

    def take(self, state: list | None, row: tuple) -> tuple[list, tuple]:
        states = list(state) if state is not None else [None] * (len(self.recurrences) + self.loops)
        made: dict[str, object] = dict(states[-1] or {}) if self.loops else {}  # at first the row before
        for i, r in enumerate(self.recurrences):
            states[i], made[r.name] = r.step(states[i], *[row[c] if isinstance(c, int) else made.get(c) for c in self.inputs[i]])
        if self.loops:
            states[-1] = made
        return states, tuple(Row(**x) if isinstance(x, dict) else x for x in made.values())


class _AsOf(InOrder):
    """A key's state: the newest right values and their time."""

    values: Sequence[str]
    skip_missing: bool

    def open(self) -> None:
        self.side = self.columns.index(_SIDE)
        self.from_ = [self.columns.index(v) for v in self.values]

    def take(self, state: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        if row[self.side]:
            return state, state or (None,) * (len(self.values) + 1)
        new = (*[row[i] for i in self.from_], row[self.at])
        if self.skip_missing and state:
            new = tuple(o if n is None else n for n, o in zip(new, state))
        return new, None


def _run(stream: DataFrame, s: Series, processor: InOrder, schema: str) -> DataFrame:
    dealt = stream.withColumn(_SHARD, F.pmod(F.xxhash64(*s.keys), F.lit(SHARDS)).cast("int"))
    return dealt.groupBy(_SHARD).transformWithState(processor, schema, "append", "eventTime")


def _fields(df: DataFrame, columns: Sequence[str], prefix: str = "") -> list[str]:
    return [f"`{prefix}{c}` {df.schema[c].dataType.simpleString()}" for c in columns]


def _timed(stream: DataFrame, s: Series, delay: str) -> DataFrame:
    return stream.where(F.col(s.time).isNotNull()).withColumn(_TIME, F.unix_micros(s.time)).withWatermark(s.time, delay)


def fold_in_order(stream: DataFrame, s: Series, recurrences: Sequence[Recurrence], delay: str, forget: str | None = None, stretch: str | None = None) -> DataFrame:
    """``stream`` with one column for each recurrence, equal to fold() on the same rows, in whatever order they come within ``delay``.

    The series' time is a timestamp. forget: keys without a row for so long (in
    event time) are forgotten. stretch: how much time a part of the rows that wait
    spans at most; by default only its number of rows is bounded.
    """
    timed = _timed(stream, s, delay)
    kept = [c for c in stream.columns if c != s.time]
    p = _Fold(timed.columns, s.keys, [_TIME, *s.tie], [*kept, _TIME, *(r.name for r in recurrences)], stretch and micros(stretch), forget and micros(forget))
    p.recurrences, place = list(recurrences), {r.name: i for i, r in enumerate(recurrences)}
    passes(recurrences, stream.columns)
    p.loops = any(place.get(c, -1) >= i for i, r in enumerate(recurrences) for c in r.inputs)
    out = _run(timed, s, p, ", ".join([*_fields(stream, kept), f"{_TIME} long", *(f"`{r.name}` {r.type}" for r in recurrences)]))
    return out.select(*[F.timestamp_micros(_TIME).alias(c) if c == s.time else F.col(f"`{c}`") for c in stream.columns], *[r.name for r in recurrences])


def last_n_in_order(stream: DataFrame, s: Series, v: str, n: int, delay: str, forget: str | None = None, name: str = "last_n") -> DataFrame:
    """``stream`` with the newest n values, oldest first, filled up with NULL on the left."""

    def step(held: tuple | None, x: object) -> tuple[tuple, list]:
        held = (*(held or (None,) * n), x)[-n:]
        return held, list(held)

    return fold_in_order(stream, s, [Recurrence(name, (v,), step, f"array<{stream.schema[v].dataType.simpleString()}>")], delay, forget)


def asof_in_order(left: DataFrame, right: DataFrame, s: Series, values: Sequence[str], delay: str, skip_missing: bool = False, prefix: str = "", forget: str | None = None, stretch: str | None = None) -> DataFrame:
    """Every left row with the newest right row at or before its time; temporal.asof() on two live streams.

    A left row waits until the watermark of both streams has passed its time, so a
    right row that comes after it within ``delay`` is still found; ``s.tie`` orders
    right rows of one time. Adds ``values`` under ``prefix`` and ``{prefix}at``.
    """
    ties = [t for t in s.tie if t in right.columns]
    clash = {v: f"_r{i}" for i, v in enumerate(values)}
    rest = [c for c in left.columns if c not in s.keys and c != s.time]
    sides = [
        left.select(*s.keys, s.time, *rest, *[F.lit(None).cast(right.schema[v].dataType).alias(n) for v, n in clash.items()], *[F.lit(None).cast(right.schema[t].dataType).alias(f"_tie{i}") for i, t in enumerate(ties)], F.lit(1).alias(_SIDE)),
        right.select(*s.keys, s.time, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in rest], *[F.col(v).alias(n) for v, n in clash.items()], *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(ties)], F.lit(0).alias(_SIDE)),
    ]
    timed = _timed(sides[0].unionByName(sides[1]), s, delay)
    kept = [*s.keys, *rest, _TIME]
    found = [*(f"_v{i}" for i in range(len(values))), "_vat"]
    p = _AsOf(timed.columns, s.keys, [_TIME, _SIDE, *(f"_tie{i}" for i in range(len(ties)))], [*kept, *found], stretch and micros(stretch), forget and micros(forget))
    kinds = [f"_v{i} {right.schema[v].dataType.simpleString()}" for i, v in enumerate(values)]
    p.values, p.skip_missing = list(clash.values()), skip_missing
    # columns stand in the order of the input
    placed = [c for c in timed.columns if c in kept]
    p.out = [*placed, *found]
    out = _run(timed, s, p, ", ".join([*(f"`{c}` {timed.schema[c].dataType.simpleString()}" for c in placed), *kinds, "_vat long"]))
    return out.select(
        *[F.timestamp_micros(_TIME).alias(c) if c == s.time else F.col(f"`{c}`") for c in left.columns],
        *[F.col(f"_v{i}").alias(f"{prefix}{v}") for i, v in enumerate(values)],
        F.timestamp_micros("_vat").alias(f"{prefix}at"),
    )
