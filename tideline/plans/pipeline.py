"""Named steps over one series frame, compiled into one lazy DataFrame.

A step names an operator, its inputs (earlier steps or columns) and parameters.
Window operators become columns, neighbouring recurrences share one ordered pass,
gates drop rows. Nothing runs until the result does.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import scalar, vectors
from tideline.operators import aggregates, factors, fold, rolling, signals, temporal, triggers
from tideline.series import Series


@dataclass(frozen=True)
class Operator:
    """kind: column (pure), window (needs the series), fold (a recurrence), aggregate (numpy arrays of the newest n rows) or gate (drops rows)."""

    name: str
    fn: Callable
    kind: str
    inputs: tuple[str, ...]
    params: tuple[str, ...]


REGISTRY: dict[str, Operator] = {}


def register(name: str, fn: Callable, kind: str, inputs: Sequence[str]) -> Callable:
    """Makes an operator known by name; its other arguments are parameters."""
    rest = [p for p in inspect.signature(fn).parameters if p not in inputs and p not in ("s", "df", "name")]
    rest = ["n", *(p for p in rest if p != "n")] if kind == "aggregate" else rest
    REGISTRY[name] = Operator(name, fn, kind, tuple(inputs), tuple(rest))
    return fn


def operator(name: str, kind: str = "column", inputs: Sequence[str] = ("v",)) -> Callable[[Callable], Callable]:
    """Decorator form of register."""
    return lambda fn: register(name, fn, kind, inputs)


for _name, _inputs in {
    "absolute": ("v",), "signed_sqrt": ("v",), "signed_sq": ("v",), "add": ("left", "right"), "subtract": ("left", "right"), "ratio": ("left", "right"),
    "pct_diff": ("left", "right"), "truncate": ("v", "bound"), "norm_range_pct": ("left", "right", "v"), "corr": ("cov", "s1", "s2"), "beta": ("corr", "s1", "s2"),
}.items():
    register(_name, getattr(scalar, _name), "column", _inputs)
for _name, _inputs in {
    "to_vec": ("vs",), "mean_vec": ("v",), "sum_vec": ("v",), "sum_mat": ("m",), "mat_entry": ("m",), "subtract_vec_i": ("left", "right"), "dot": ("x", "y"),
    "v_x_vec_i": ("v", "vec"), "vec_x_mat_i": ("v", "m"), "norm_mid_vec": ("v",), "norm_mid_pct_vec": ("v",), "norm_mid_inner_vec": ("v",),
}.items():
    register(_name, getattr(vectors, _name), "column", _inputs)
for _name, _inputs in {
    "sum_": ("v",), "mean": ("v",), "std": ("v",), "rms": ("v",), "max_": ("v",), "min_": ("v",), "skew": ("v",), "kurtosis": ("v",), "quantile": ("v",),
    "cov": ("v1", "v2", "mu_1", "mu_2"), "lag": ("v",), "abs_change": ("v",), "pct_change": ("v",), "cum_sum": ("v",), "cum_prod": ("v",), "mean_w": ("v",),
    "std_w": ("v",), "rms_w": ("v",), "max_w": ("v",), "min_w": ("v",), "quantile_w": ("v",),
}.items():
    register(_name.rstrip("_"), getattr(rolling, _name), "window", _inputs)
register("last_n", temporal.last_n, "window", ("v",))
register("pnl_linear", signals.pnl_linear, "window", ("pos", "px"))
register("pca", factors.pca, "window", ("vec",))
for _name, _inputs in {
    "mean_ew": ("v",), "std_ew": ("v", "mu"), "rms_ew": ("v",), "max_ew": ("v", "mu"), "min_ew": ("v", "mu"), "quantile_ew": ("v",), "xo_mean_ew_rms_ew": ("v",),
    "pos_linear": ("scale", "date", "signal"),
}.items():
    register(_name, getattr(fold, _name), "fold", _inputs)
register("gp_incremental", factors.gp_incremental, "fold", ("x", "y"))
register("feedback", fold.feedback, "fold", ("v", "back"))
register("trimmed_mean", aggregates.trimmed_mean, "aggregate", ("v",))
for _name in ("on", "not_missing", "sign_change"):
    register(_name, getattr(triggers, _name), "gate", ("v", "date"))


@dataclass(frozen=True)
class Step:
    name: str
    op: str
    inputs: Mapping[str, object]
    params: Mapping[str, object] = field(default_factory=dict)


class Pipeline:
    """Steps by name. add() returns a new pipeline; the old one stays as it was."""

    def __init__(self, series: Series, steps: Sequence[Step] = ()):
        self.series, self.steps = series, tuple(steps)

    def add(self, name: str, op: str, *inputs: str, **params: object) -> Pipeline:
        """A step: inputs by place or by name, each the name of a column or of a step before it."""
        if op not in REGISTRY:
            raise KeyError(f"no operator {op}")
        spec = REGISTRY[op]
        if name in (s.name for s in self.steps):
            raise ValueError(f"step {name} is there already")
        given = dict(zip(spec.inputs, inputs)) if op != "to_vec" else {"vs": tuple(inputs)}
        given |= {k: params.pop(k) for k in list(params) if k in spec.inputs}
        if unknown := set(params) - set(spec.params):
            raise TypeError(f"{op} has no parameter {sorted(unknown)}")
        return Pipeline(self.series, [*self.steps, Step(name, op, given, params)])

    def pipe(self, fn: Callable[..., Pipeline], *args: object, **kwargs: object) -> Pipeline:
        return fn(self, *args, **kwargs)

    def describe(self) -> list[dict[str, object]]:
        """The steps as rows of the declarative form."""
        return [{"label": s.name, "func": s.op, **{f"kw-{i}": _cell(k, v) for i, (k, v) in enumerate([*s.inputs.items(), *s.params.items()])}} for s in self.steps]

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with a column for each step, less the rows that gates drop."""
        pending: list[fold.Recurrence] = []

        def flush(frame: DataFrame) -> DataFrame:
            if not pending:
                return frame
            out = fold.fold(frame, self.series, list(pending))
            pending.clear()
            return out

        for step in self.steps:
            spec = REGISTRY[step.op]
            if spec.kind == "fold":
                pending.append(spec.fn(step.name, **{k: v for k, v in step.inputs.items() if v}, **step.params))
                continue
            df = flush(df)
            if spec.kind == "gate":
                args = {k: v for k, v in step.inputs.items() if k in inspect.signature(spec.fn).parameters}
                df = spec.fn(df, **({"s": self.series} if "s" in inspect.signature(spec.fn).parameters else {}), **args, **step.params)
                continue
            if spec.kind == "aggregate":
                rest = {k: v for k, v in step.params.items() if k != "n"}
                value = aggregates.over_last(self.series, spec.fn, int(step.params["n"]), *[F.col(step.inputs[i]) for i in spec.inputs if step.inputs.get(i)], **rest)
            elif step.op == "to_vec":
                value = spec.fn(*[F.col(c) for c in step.inputs["vs"]])
            else:
                cols = {k: F.col(v) for k, v in step.inputs.items() if v}
                value = spec.fn(self.series, **cols, **step.params) if spec.kind == "window" else spec.fn(**cols, **step.params)
            df = df.withColumn(step.name, value)
        return flush(df)


def signatures() -> list[dict[str, object]]:
    """What operators there are, their kinds, inputs and parameters."""
    return [{"func": o.name, "kind": o.kind, "inputs": list(o.inputs), "params": list(o.params)} for _, o in sorted(REGISTRY.items())]


def signatures_frame(spark: SparkSession) -> DataFrame:
    """signatures() as a table."""
    return spark.createDataFrame([tuple(x.values()) for x in signatures()], "func string, kind string, inputs array<string>, params array<string>")


def _cell(k: str, v: object) -> str:
    return f"{k}:ref={','.join(v) if isinstance(v, tuple) else v}" if k in {i for o in REGISTRY.values() for i in o.inputs} else f"{k}:{type(v).__name__}={v}"


CASTS: dict[str, Callable[[str], object]] = {
    "str": str,
    "int": int,
    "float": float,
    "bool": lambda x: {"true": True, "false": False, "1": True, "0": False}[x.strip().lower()],
    "date": lambda x: next(d for f in ("%Y-%m-%d", "%Y%m%d", "%Y-%m", "%Y") for d in _try_date(x.strip(), f)),
    "tuple": lambda x: tuple(float(y) for y in x.strip("()[] ").split(",") if y.strip()),
}


def _try_date(x: str, f: str) -> list[date]:
    try:
        return [datetime.strptime(x, f).date()]
    except ValueError:
        return []


def parse_cell(cell: str) -> tuple[str | None, object, bool]:
    """(name or None, value, whether it names a step) of ``k=v``, ``k:type=v``, ``k:ref=label`` or a bare label."""
    head, eq, value = cell.partition("=")
    if not eq:
        return None, cell.strip(), True
    name, _, kind = (x.strip() for x in head.partition(":"))
    if kind == "ref":
        return name, value.strip(), True
    if kind:
        return name, CASTS[kind](value), False
    for cast in (int, float):
        try:
            return name, cast(value), False
        except ValueError:
            pass
    return name, value.strip(), False


def compile_rows(rows: Sequence[Mapping[str, object]], series: Series) -> Pipeline:
    """A pipeline of rows (label, func, kw-0, kw-1, ...), in an order in which inputs come first.

    Rows without a label or function are left out; a cell "." ends a row.
    Recurrences may feed on each other: they stay in the order of the rows, and read
    of those that come later the value of the row before.
    """
    parsed = []
    for row in rows:
        if not row.get("label") or not row.get("func"):
            continue
        args, kwargs, refs = [], {}, set()
        for k in sorted((k for k in row if k.startswith("kw-")), key=lambda k: int(k[3:])):
            cell = str(row[k] or "").strip()
            if cell == ".":
                break
            if not cell:
                continue
            name, value, is_ref = parse_cell(cell)
            if is_ref:
                refs.update(str(value).split(","))
            if name == "vs":
                args += str(value).split(",")
            elif name is None:
                args.append(value)
            else:
                kwargs[name] = value
        parsed.append((str(row["label"]), str(row["func"]), args, kwargs, refs))
    labels = {p[0] for p in parsed}
    out, done = Pipeline(series), set()
    while parsed:
        ready = next((p for p in parsed if not (p[4] & labels) - done), None)
        for p in [ready] if ready else _loop(parsed, labels - done):
            parsed.remove(p)
            out = out.add(p[0], p[1], *p[2], **p[3])
            done.add(p[0])
    return out


def _loop(parsed: Sequence[tuple], open_: set[str]) -> list[tuple]:
    """Rows that wait for each other and for nothing else, in their order; they must all be recurrences."""
    needs = {p[0]: p[4] & open_ for p in parsed}
    reach = {k: set(v) for k, v in needs.items()}
    for _ in parsed:
        reach = {k: v.union(*(reach[x] for x in v)) for k, v in reach.items()}
    loop = min((reach[k] for k in reach if k in reach[k]), key=len)
    rows = [p for p in parsed if p[0] in loop]
    if any(REGISTRY[p[1]].kind != "fold" for p in rows):
        raise ValueError(f"inputs form a cycle: {sorted(p[0] for p in rows)}")
    return rows


def plot_frame(df: DataFrame, series: Series, spec: Sequence[Mapping[str, object]], start: object = None, end: object = None, frames: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The columns that plot rows (label, name, expr, slot, align, x, y2) ask for, between two times.

    expr: ``identity`` or ``cumsum``, each with ``:trim=k`` to leave out the first k.
    align: the name of one of ``frames`` that the label is a column of; it is put on
    the rows of ``df`` as temporal.align does: the newest value since the row before.
    A row with x names the column that others are drawn over; it is taken as it is.
    """
    plot_axes(spec)
    cols = {}
    for i, row in enumerate(spec):
        label = str(row["label"])
        if row.get("align"):
            df = temporal.align(df, (frames or {})[str(row["align"])], series, label, f"_aligned_{i}")
            label = f"_aligned_{i}"
        kind, _, trim = str(row.get("expr") or "identity").partition(":trim=")
        v = F.col(label)
        v = v[int(row["slot"])] if row.get("slot") is not None else v
        out = rolling.cum_sum(series, v) if kind == "cumsum" else v
        cols[_name_of(row)] = v if row.get("x") else rolling.trimmed(series, v, out, int(trim or 0))
    df = df.select(*series.keys, *series.order, *[c.alias(n) for n, c in cols.items()])
    if start is not None:
        df = df.where(F.col(series.time) >= F.lit(start))
    return df if end is None else df.where(F.col(series.time) <= F.lit(end))


def _name_of(row: Mapping[str, object]) -> str:
    return str(row.get("name") or row["label"])


def plot_axes(spec: Sequence[Mapping[str, object]]) -> dict[str, object]:
    """Which of plot_frame()'s columns is x (None: the rows' order), and which are drawn on the left (y) and on the right (y2)."""
    xs = [_name_of(r) for r in spec if r.get("x")]
    if len(xs) > 1:
        raise ValueError(f"more than one x: {xs}")
    return {"x": xs[0] if xs else None, "y": [_name_of(r) for r in spec if not r.get("x") and not r.get("y2")], "y2": [_name_of(r) for r in spec if r.get("y2")]}
