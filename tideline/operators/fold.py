"""Recurrences over ordered series: what a row is depends on what the row before became.

A frame is dealt by key, sorted, and streamed through each task: the state of a
series is carried from one Arrow batch to the next, so memory does not grow with
a series' length and several recurrences take one pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.series import Series

Step = Callable[..., tuple[object, object]]


@dataclass(frozen=True)
class Recurrence:
    """A named output: step(state, *inputs) -> (state, output), state None at a series' start.

    inputs: columns, or outputs of recurrences. Of one that stands before it a
    recurrence reads the same row, of itself or one that stands after it the row
    before (missing at a series' start), so several can feed on each other.
    scan(new, state, *inputs) -> (state, outputs) does the same for a batch of rows
    at once, where there is a way: new tells where a series starts, missing values
    are NaN, and states are those of step.
    """

    name: str
    inputs: tuple[str, ...]
    step: Step
    type: str = "double"
    scan: Callable[..., tuple[object, object]] | None = None


def passes(recurrences: Sequence[Recurrence], columns: Sequence[str]) -> list[list[int]]:
    """Which recurrences must go row by row together, as they feed on each other; the others stand alone."""
    place = {r.name: i for i, r in enumerate(recurrences)}
    out: list[list[int]] = []
    for i, r in enumerate(recurrences):
        for c in r.inputs:
            if c not in place and c not in columns:
                raise ValueError(f"{r.name} reads {c}, which is neither a column nor a recurrence of the same pass")
        out.append([i])
        reach = max((place[c] for c in r.inputs if c in place), default=-1)
        if reach >= i:  # all up to the one it reads belong to its loop
            out[-1] = [i, *range(i + 1, reach + 1)]
    merged: list[list[int]] = []
    for group in out:
        if merged and group[0] <= merged[-1][-1]:
            merged[-1] = list(range(merged[-1][0], max(merged[-1][-1], group[-1]) + 1))
        else:
            merged.append(group)
    return merged


def fold(df: DataFrame, s: Series, recurrences: Sequence[Recurrence]) -> DataFrame:
    """``df`` with one column for each recurrence."""
    names = list(df.columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{r.name}` {r.type}" for r in recurrences)])
    keys = list(s.keys)
    groups = passes(recurrences, names)
    looped = {i for g in groups for i in g if len(g) > 1 or recurrences[i].name in recurrences[i].inputs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states = None, [None] * len(recurrences)
        befores: list[dict[str, object]] = [{} for _ in groups]  # what loops gave in the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _starts(batch, [names.index(k) for k in keys])
            first = [batch.column(names.index(k))[0].as_py() for k in keys]
            new[0] = first != key
            key = [batch.column(names.index(k))[-1].as_py() for k in keys]
            lists: dict[str, list] = {}
            made: dict[str, np.ndarray] = {}

            def rows_of(c: str) -> list:
                if c not in lists:
                    lists[c] = _array(made[c], "double").to_pylist() if c in made else batch.column(names.index(c)).to_pylist()
                return lists[c]

            def numbers_of(c: str) -> np.ndarray:
                if c not in made:
                    source = pa.array(lists[c], pa.float64()) if c in lists else batch.column(names.index(c)).cast(pa.float64())
                    made[c] = source.to_numpy(zero_copy_only=False)
                return made[c]

            out: dict[str, pa.Array] = {}
            for group, before in zip(groups, befores):
                if group[0] not in looped:
                    r = recurrences[group[0]]
                    if r.scan:
                        states[group[0]], got = r.scan(new, states[group[0]], *(numbers_of(c) for c in r.inputs))
                        out[r.name] = _array(got, r.type)
                        if r.type == "double":
                            made[r.name] = got
                        else:
                            lists[r.name] = out[r.name].to_pylist() if any(r.name in x.inputs for x in recurrences) else []
                        continue
                    state, step, got = states[group[0]], r.step, []
                    for start, *xs in zip(new.tolist(), *(rows_of(c) for c in r.inputs)):
                        if start:
                            state = None
                        state, x = step(state, *xs)
                        got.append(x)
                    states[group[0]] = state
                    lists[r.name] = got
                    out[r.name] = _array(got, r.type)
                    continue
                mine = {recurrences[i].name for i in group}
                outside = {c: rows_of(c) for i in group for c in recurrences[i].inputs if c not in mine}
                got = {n: [] for n in mine}
                for at, start in enumerate(new.tolist()):
                    if start:
                        before.update(dict.fromkeys(mine))
                        for i in group:
                            states[i] = None
                    for i in group:
                        r = recurrences[i]
                        states[i], before[r.name] = r.step(states[i], *(outside[c][at] if c in outside else before[c] for c in r.inputs))
                        got[r.name].append(before[r.name])
                for i in group:
                    lists[recurrences[i].name] = got[recurrences[i].name]
                    out[recurrences[i].name] = _array(got[recurrences[i].name], recurrences[i].type)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(out[r.name] for r in recurrences)], [*names, *(r.name for r in recurrences)])

    return df.repartition(*keys).sortWithinPartitions(*keys, *s.order).mapInArrow(run, schema)


def _starts(batch: pa.RecordBatch, keys: Sequence[int]) -> np.ndarray:
    """Which rows have another key than the row before."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        codes = batch.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _array(got: object, kind: str) -> pa.Array:
    """Outputs, or arrays of them by field, as an Arrow array of a column's type; NaN in arrays is missing."""
    if isinstance(got, dict):
        return pa.StructArray.from_arrays([pa.array(x, from_pandas=True) for x in got.values()], list(got))
    return pa.array(got, from_pandas=True) if isinstance(got, np.ndarray) else pa.array(got, _arrow(kind))


def _arrow(kind: str) -> pa.DataType:
    """A column type as an Arrow type: simple ones, arrays of them, and structs of either."""
    kind = kind.strip()
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind.removeprefix("array<").removesuffix(">")))
    if kind.startswith("struct<"):
        fields = [x.split(":", 1) for x in re.split(r",(?![^<]*>)", kind.removeprefix("struct<").removesuffix(">"))]
        return pa.struct([(f.strip(), _arrow(t)) for f, t in fields])
    return {"double": pa.float64(), "float": pa.float32(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "date": pa.date32()}[kind]


def running(new: np.ndarray, ok: np.ndarray, keep: float, add: np.ndarray, first: np.ndarray, p0: float | None, root: bool = False) -> np.ndarray:
    """p = keep * p + add at every row where ok holds, p = first at a series' first such row; other rows carry p.

    root: p = sqrt(keep * p * p + add) instead. p0: p of the series that goes on from
    the batch before. Each value is taken from the one before it, as step() does: to
    the last bit it depends neither on where batches end nor on a batch's other rows.
    NaN until a series has a p.
    """
    n = len(new)
    series = np.cumsum(new)
    at = np.flatnonzero(ok)
    mine = series[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = mine[1:] != mine[:-1]
    if len(at) and mine[0] == 0 and p0 is not None:
        fresh[0] = False
    p, got = p0, []
    for starts, a, x in zip(fresh.tolist(), add[at].tolist(), first[at].tolist()):
        p = x if starts else sqrt(keep * p * p + a) if root else keep * p + a
        got.append(p)
    out = np.full(n, np.nan if p0 is None else p0)
    out[series > 0] = np.nan
    newest = np.maximum.accumulate(np.where(ok, np.arange(n), -1)) if n else np.zeros(0, int)
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else newest
    there = (newest >= 0) & (newest >= starts)
    full = np.empty(n)
    full[at] = got
    out[there] = full[newest[there]]
    return out


def first_ok(new: np.ndarray, ok: np.ndarray, held: bool) -> np.ndarray:
    """A series' first row where ok holds; held: the series that goes on from the batch before has had one."""
    series = np.cumsum(new)
    out = np.zeros(len(new), bool)
    at = np.flatnonzero(ok)
    mine = series[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = mine[1:] != mine[:-1]
    if len(at) and mine[0] == 0 and held:
        fresh[0] = False
    out[at] = fresh
    return out


#: Series of a batch that are stepped through side by side, at least; fewer are stepped through row by row.
ABREAST = 8


def abreast(new: np.ndarray, held: tuple | None, width: int, move: Callable, xs: Sequence[np.ndarray]) -> tuple[tuple | None, np.ndarray]:
    """What recurrences without a closed form give: all series of a batch move together, each by its next row.

    move(state, *values) -> (state, outputs) over arrays of one place for each series
    (state: of ``width`` arrays, NaN where there is none). A batch takes as many moves
    as its longest series has rows.
    """
    starts = np.flatnonzero(new)
    if not new[0]:
        starts = np.concatenate([[0], starts])
    lengths = np.diff(np.append(starts, len(new)))
    longest_first = np.argsort(-lengths, kind="stable")
    at, sizes = starts[longest_first], lengths[longest_first]
    state = np.full((width, len(starts)), np.nan)
    if not new[0] and held is not None:
        state[:, np.flatnonzero(longest_first == 0)[0]] = held
    out = np.empty(len(new))
    for k in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -k))  # series that have more than k rows
        rows = at[:n] + k
        state[:, :n], out[rows] = move(state[:, :n], *(x[rows] for x in xs))
    end = state[:, np.flatnonzero(longest_first == len(starts) - 1)[0]]
    return None if np.isnan(end[0]) else tuple(end.tolist()), out


def _many(new: np.ndarray) -> bool:
    """Whether series are many and short enough to go side by side."""
    starts = np.append(np.flatnonzero(new), len(new))
    return len(starts) > ABREAST and int(np.diff(starts, prepend=0).max()) * ABREAST <= len(new)


def _one_by_one(new: np.ndarray, state: object, step: Step, xs: Sequence[np.ndarray]) -> tuple[object, np.ndarray]:
    out = np.empty(len(new))
    for i, (start, *values) in enumerate(zip(new.tolist(), *(x.tolist() for x in xs))):
        state, got = step(None if start else state, *(None if v != v else v for v in values))
        out[i] = np.nan if got is None else got
    return state, out


def _end(x: float) -> float | None:
    return None if np.isnan(x) else float(x)


def alpha_of(span: float | None = None, alpha: float | None = None) -> float:
    """The weight of the newest value; span and alpha must agree if both are given."""
    if span is None and alpha is None:
        raise ValueError("span or alpha is needed")
    if span is not None and alpha is not None and abs(2.0 / (span + 1.0) - alpha) > 1e-9:
        raise ValueError("span and alpha disagree")
    return alpha if alpha is not None else 2.0 / (span + 1.0)


def memory(span: float | None = None, alpha: float | None = None, weight: float = 1e-17) -> int:
    """Values after which what was before weighs less than ``weight``, by default less than a double can tell.

    An EW mean or rms over a hot series can be taken by blocks that look back so
    far: over_blocks(df, s, memory(span), lambda d, b: fold(d, b, recurrences), n,
    v.isNotNull()). Where recurrences feed on each other, their memories add up.
    """
    a = alpha_of(span, alpha)
    return 1 if a >= 1 else ceil(log(weight) / log(1.0 - a))


def mapped(name: str, inputs: Sequence[str], fn: Callable, type: str = "double") -> Recurrence:
    """A row's own function of its inputs, to take part in a loop."""
    return Recurrence(name, tuple(inputs), lambda _, *xs: (None, fn(*xs)), type)


def feedback(name: str, v: str, back: str, a: float = 0.0, b: float = 1.0, c: float = 1.0) -> Recurrence:
    """a + b * v + c * back; ``back`` may come later, or be this output itself: then it is of the row before.

    Missing where v is; a missing ``back`` counts as zero.
    """
    return mapped(name, (v, back), lambda x, y: None if x is None else a + b * x + c * (y or 0.0))


def mean_ew(name: str, v: str, span: float | None = None, alpha: float | None = None) -> Recurrence:
    """Starts at the first value; a missing value leaves it as it was."""
    a = alpha_of(span, alpha)

    def step(p, x):
        p = x if p is None else p if x is None else (1.0 - a) * p + a * x
        return p, p

    def scan(new, p, x):
        out = running(new, ~np.isnan(x), 1.0 - a, a * x, x, p)
        return _end(out[-1]), out

    return Recurrence(name, (v,), step, scan=scan)


def mean_ew_from(name: str, v: str, a: float, start: float) -> Recurrence:
    """mean_ew() that is ``start`` before a series' first value; missing until there is one."""

    def step(p, x):
        p = p if x is None else (1.0 - a) * (start if p is None else p) + a * x
        return p, p

    def scan(new, p, x):
        out = running(new, ~np.isnan(x), 1.0 - a, a * x, (1.0 - a) * start + a * x, p)
        return _end(out[-1]), out

    return Recurrence(name, (v,), step, scan=scan)


def count_of(name: str, v: str) -> Recurrence:
    """How many values there were; missing until there is one."""

    def step(n, x):
        n = n if x is None else (n or 0.0) + 1.0
        return n, n

    def scan(new, n, x):
        out = running(new, ~np.isnan(x), 1.0, np.ones(len(x)), np.ones(len(x)), n)
        return _end(out[-1]), out

    return Recurrence(name, (v,), step, scan=scan)


def std_ew(name: str, v: str, mu: str, span: float | None = None, alpha: float | None = None) -> Recurrence:
    """Deviation from ``mu``. First event: v - mu, signed; without a state: v; else the recurrence."""
    a = alpha_of(span, alpha)

    def step(state, x, m):
        first, p = state is None, None if state is None else state[0]
        if x is None or m is None:
            return (p,), None
        out = x - m if first else x if p is None else sqrt((1.0 - a) * p * p + a * ((x - m) * (x - m)))
        return (out,), out

    def scan(new, state, x, m):
        ok, p = ~(np.isnan(x) | np.isnan(m)), None if state is None else state[0]
        starts = new.copy()
        starts[0] |= state is None
        first = np.where(starts, x - m, x)
        out = np.where(ok, running(new, ok, 1.0 - a, a * ((x - m) * (x - m)), first, p, root=True), np.nan)
        tail = out[np.flatnonzero(new)[-1] if new.any() else 0 :]
        tail = tail[~np.isnan(tail)]
        return (float(tail[-1]) if len(tail) else None if new.any() else p,), out

    return Recurrence(name, (v, mu), step, scan=scan)


def rms_ew(name: str, v: str, span: float | None = None, alpha: float | None = None, b: float = 1.0) -> Recurrence:
    """Missing where v is; the state lives on."""
    a = alpha_of(span, alpha)

    def step(p, x):
        if x is None:
            return p, None
        p = x * x if p is None else (1.0 - a) * p + a * x * x
        return p, b * sqrt(p)

    def scan(new, p, x):
        ok = ~np.isnan(x)
        q = running(new, ok, 1.0 - a, a * x * x, x * x, p)
        return _end(q[-1]), np.where(ok, b * np.sqrt(q), np.nan)

    return Recurrence(name, (v,), step, scan=scan)


def _extreme_ew(name: str, v: str, mu: str | None, a: float, beyond: Callable) -> Recurrence:
    def step(p, x, m=None):
        if x is None:
            return p, None
        p = x if p is None or beyond(x, p) else (1.0 - a) * p + (a * m if m is not None else 0.0)
        return p, p

    def move(state, x, m=None):
        p, ok = state[0], ~np.isnan(x)
        decayed = (1.0 - a) * p + (0.0 if m is None else a * np.where(np.isnan(m), 0.0, m))
        p = np.where(ok, np.where(np.isnan(p) | beyond(x, p), x, decayed), p)
        return p[None], np.where(ok, p, np.nan)

    def scan(new, p, *xs):
        if not _many(new):
            return _one_by_one(new, p, step, xs)
        end, out = abreast(new, None if p is None else (p,), 1, move, xs)
        return None if end is None else end[0], out

    return Recurrence(name, (v,) if mu is None else (v, mu), step, scan=scan)


def max_ew(name: str, v: str, mu: str | None = None, span: float | None = None, alpha: float | None = None) -> Recurrence:
    """Jumps to a new maximum, else decays towards mu (towards zero without one)."""
    return _extreme_ew(name, v, mu, alpha_of(span, alpha), lambda x, p: x > p)


def min_ew(name: str, v: str, mu: str | None = None, span: float | None = None, alpha: float | None = None) -> Recurrence:
    return _extreme_ew(name, v, mu, alpha_of(span, alpha), lambda x, p: x < p)


def quantile_ew(name: str, v: str, q: float, span: float | None = None, alpha: float | None = None) -> Recurrence:
    """A stochastic estimate: each value moves it towards its side by alpha times the mean step so far."""
    a = alpha_of(span, alpha)

    def step(state, x):
        if x is None:
            return state, None if state is None else state[0]
        if state is None:
            return (x, abs(x) or 1.0), x
        p, scale = state
        scale = (1.0 - a) * scale + a * abs(x - p)
        p += a * scale * (q if x > p else q - 1.0 if x < p else 0.0)
        return (p, scale), p

    def move(state, x):
        (p, scale), ok = state, ~np.isnan(x)
        fresh = ok & np.isnan(p)
        wider = (1.0 - a) * scale + a * np.abs(x - p)
        moved = p + a * wider * np.where(x > p, q, np.where(x < p, q - 1.0, 0.0))
        p, scale = np.where(fresh, x, np.where(ok, moved, p)), np.where(fresh, np.where(x == 0, 1.0, np.abs(x)), np.where(ok, wider, scale))
        return np.stack([p, scale]), p

    def scan(new, state, x):
        return abreast(new, state, 2, move, (x,)) if _many(new) else _one_by_one(new, state, step, (x,))

    return Recurrence(name, (v,), step, scan=scan)


def xo_mean_ew_rms_ew(name: str, v: str, span_f: float, span_s: float, span_v: float, rx: str = "abs") -> Recurrence:
    """Struct (xo, fast, slow, vol): two EW means and their distance in units of the EW rms change.

    Changes are against the last value that was not missing, so a gap does not
    silence the volatility.
    """
    if rx not in ("abs", "pct"):
        raise ValueError("rx is abs or pct")
    af, as_, av = alpha_of(span_f), alpha_of(span_s), alpha_of(span_v)

    def step(state, x):
        if x is None:
            _, f, sl, vol = state or (None,) * 4
            return state, {"xo": None, "fast": f, "slow": sl, "vol": vol}
        if state is None:
            return (x, x, x, abs(x)), {"xo": 0.0, "fast": x, "slow": x, "vol": abs(x)}
        p, f, sl, vol = state
        f, sl = (1.0 - af) * f + af * x, (1.0 - as_) * sl + as_ * x
        change = x - p if rx == "abs" else x / p - 1.0 if p else None
        if change is not None:
            vol = sqrt((1.0 - av) * vol * vol + av * (change * change))
        return (x, f, sl, vol), {"xo": (f - sl) / vol if vol else None, "fast": f, "slow": sl, "vol": vol}

    def scan(new, state, x):
        ok, (x0, f0, s0, v0) = ~np.isnan(x), state or (None,) * 4
        fresh = first_ok(new, ok, x0 is not None)
        fast, slow = running(new, ok, 1.0 - af, af * x, x, f0), running(new, ok, 1.0 - as_, as_ * x, x, s0)
        held = running(new, ok, 0.0, x, x, x0)  # the newest value
        p = np.concatenate([[np.nan if x0 is None else x0], held[:-1]])
        change = x - p if rx == "abs" else np.divide(x, p, out=np.full(len(x), np.nan), where=p != 0) - 1.0
        vol = running(new, fresh | (ok & ~np.isnan(change)), 1.0 - av, av * (change * change), np.abs(x), v0, root=True)
        xo = np.where(fresh, 0.0, np.divide(fast - slow, vol, out=np.full(len(x), np.nan), where=vol != 0))
        end = tuple(_end(y[-1]) for y in (held, fast, slow, vol))
        return None if end[0] is None else end, {"xo": np.where(ok, xo, np.nan), "fast": fast, "slow": slow, "vol": vol}

    return Recurrence(name, (v,), step, "struct<xo:double,fast:double,slow:double,vol:double>", scan)


def pos_linear(name: str, scale: str, date: str | None = None, signal: str | None = None, upper: float | None = None, lower: float | None = None, delta: float | None = None, freq: str | None = None, const: float | None = None) -> Recurrence:
    """Struct (pos, sig, scl): a position of signal over scale.

    The first event has none. The signal is cut to [-3, 3]. Where signal or scale is
    missing, its former value goes on; until all three parts have been there once,
    the triple is what the event gives. freq sets when a new scale is taken: always,
    "M" on a new month, "D15" on the 15th; it is the newest that was not missing.
    With lower, upper or freq a new signal is taken only if it is more than ``delta``
    away, or crosses upper from below or lower from above; a signal that was at the
    bound has not come from beyond it.
    """
    if freq not in (None, "M", "D15"):
        raise ValueError("freq is M or D15")
    simple = lower is None and upper is None and freq is None

    def triple(sig, scl):
        return sig / scl if sig is not None and scl else None, sig, scl

    def step(state, scl, *more):
        more = list(more)
        sig = more.pop(0) if signal else float(const or 1.0)
        day = more.pop(0) if date else None
        former, seen, last_day = state or ((None,) * 3, None, None)
        seen = seen if scl is None else scl
        sig = None if sig is None else min(3.0, max(-3.0, sig))
        if state is None:
            out = (None,) * 3
        elif None in former:
            out = triple(sig, scl)
        else:
            _, was, out_scl = former
            sig = was if sig is None else sig
            if freq is None or (day is not None and (day.day == 15 if freq == "D15" else last_day is not None and day.month != last_day.month)):
                out_scl = seen
            moves = delta is not None and abs(sig - was) > delta
            crosses = (upper is not None and was < upper < sig) or (lower is not None and was > lower > sig)
            out = triple(sig if simple or moves or crosses else was, out_scl)
        former = tuple(b if b is not None else a for a, b in zip(former, out))
        return (former, seen, day), dict(zip(("pos", "sig", "scl"), out))

    return Recurrence(name, (scale, *([signal] if signal else []), *([date] if date else [])), step, "struct<pos:double,sig:double,scl:double>")
