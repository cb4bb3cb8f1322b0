"""Rolling principal components and Gaussian-process regression, by Arrow batches of whole frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.fold import Recurrence
from tideline.series import Series

PCA = "struct<e:array<double>,u:array<array<double>>>"


def svd_pca(x: np.ndarray, keep: int, centre: bool = False, mus: np.ndarray | None = None, anchor: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and loadings (features by factors) of stacked frames of observations by features, without gaps.

    anchor: the last feature's loading on each factor is not negative.
    """
    if mus is not None:
        x = x - mus
    elif centre:
        x = x - x.mean(axis=-2, keepdims=True)
    u, e, _ = np.linalg.svd(np.swapaxes(x, -1, -2), full_matrices=False)
    u, e = u[..., :keep], e[..., :keep]
    if anchor:
        u = u * np.where(u[..., -1:, :] < 0, -1.0, 1.0)
    return e, u


def _frames(frames: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Observations by features of all frames one after the other, and where each frame begins and the last ends."""
    starts = frames.offsets.to_numpy()
    vectors = frames.values[starts[0] : starts[-1]]
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    width = len(vectors.value_lengths()) and vectors.value_lengths()[0].as_py()
    return values.reshape(len(vectors), width or 0), starts - starts[0]


def _lists(values: pa.Array, size: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, size), pa.int32()), values)


def pca(s: Series, vec: Column, n: int, factors: int, centre: bool = False, anchor: bool = True, weights: Sequence[float] | None = None, gate: Column | None = None) -> Column:
    """Struct (e, u) of the last n vectors: singular values and loadings by rows.

    Vectors with a gap are left out; NULL where fewer are left than a vector has
    parts. Frames with as many vectors are decomposed together. weights: one for
    each place of the frame, oldest first; a missing vector fills no place. gate: factors are taken only where it
    holds, and stay until it holds again.
    """
    roots = None if weights is None else np.sqrt(np.array(weights, float))

    @F.arrow_udf(PCA)
    def solve(frames: pa.Array) -> pa.Array:
        x, starts = _frames(frames)
        if roots is not None:
            place = np.arange(len(x)) - np.repeat(starts[1:], np.diff(starts)) + n
            x = x * roots[place][:, None]
        whole = ~np.isnan(x).any(axis=1)
        at, before = np.flatnonzero(whole), np.r_[0, np.cumsum(whole)]
        first, counts = before[starts[:-1]], np.diff(before[starts])
        features, keep = x.shape[1], min(factors, x.shape[1])
        e, u = np.zeros((len(frames), keep)), np.zeros((len(frames), features, keep))
        solved = (counts >= features) & (counts > 0)
        for c in np.unique(counts[solved]):
            which = np.flatnonzero(counts == c)
            e[which], u[which] = svd_pca(x[at[first[which, None] + np.arange(c)]], keep, centre, anchor=anchor)
        if not keep:  # no vector in the batch
            return pa.nulls(len(frames), pa.struct([("e", pa.list_(pa.float64())), ("u", pa.list_(pa.list_(pa.float64())))]))
        parts = [_lists(pa.array(e.ravel()), keep), _lists(_lists(pa.array(u.ravel()), keep), features)]
        return pa.StructArray.from_arrays(parts, ["e", "u"], mask=pa.array(~solved))

    frame = F.collect_list(vec).over(s.last(n))
    if gate is None:
        return solve(frame)
    return F.last(solve(F.when(gate, frame)), ignorenulls=True).over(s.upto())


def unit_norm_beta(s: Series, vec: Column, n: int, weights: Sequence[float] | None = None) -> Column:
    """The vector of length one along which the last n vectors have the largest (weighted) mean square.

    It is the first factor of frames that are not centred; its last part is not negative.
    """
    return F.transform(pca(s, vec, n, 1, weights=weights)["u"], lambda row: F.get(row, F.lit(0)))


def rbf(a: np.ndarray, b: np.ndarray, length: float, scale: float) -> np.ndarray:
    """Of points that are broadcast against each other."""
    return scale**2 * np.exp(-0.5 * (a - b) ** 2 / length**2)


def gp_regression(df: DataFrame, s: Series, x: str, y: str, n: int, length: float = 1.0, scale: float = 1.0, noise: float = 0.1) -> DataFrame:
    """Adds gp_mean and gp_var: what a Gaussian process on the n rows before expects at the present x."""
    frame = F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).over(s.ordered().rowsBetween(-n, -1))

    @F.pandas_udf("struct<gp_mean:double,gp_var:double>")
    def solve(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for past, at in frames:
            points = [np.array([(p["x"], p["y"]) for p in f if p["x"] is not None and p["y"] is not None], float).reshape(-1, 2) for f in past]
            at, counts = at.to_numpy(float), np.array([len(p) for p in points])
            mean, var = np.zeros(len(at)), np.full(len(at), scale**2)
            for c in np.unique(counts[counts > 0]):  # frames with as many points are solved together
                which = np.flatnonzero(counts == c)
                pts = np.stack([points[i] for i in which])
                k = rbf(pts[:, :, None, 0], pts[:, None, :, 0], length, scale) + noise**2 * np.eye(c)
                ks = rbf(at[which, None], pts[:, :, 0], length, scale)
                got = np.linalg.solve(k, np.stack([pts[:, :, 1], ks], axis=-1))
                mean[which] = (ks * got[..., 0]).sum(axis=1)
                var[which] -= (ks * got[..., 1]).sum(axis=1)
            none = np.isnan(at)
            yield pd.DataFrame({"gp_mean": np.where(none, np.nan, mean), "gp_var": np.where(none, np.nan, var)}).astype(object).where(lambda d: d.notna(), None)

    return df.withColumn("_g", solve(frame, F.col(x).cast("double"))).select(*df.columns, "_g.gp_mean", "_g.gp_var")


def gp_incremental(name: str, x: str, y: str, n: int, length: float = 1.0, scale: float = 1.0, noise: float = 0.1) -> Recurrence:
    """gp_regression() as a recurrence: struct (gp_mean, gp_var), each row in n^2 steps.

    The state is the inverse covariance of the points among the n rows before: a new
    point borders it by a row, the oldest is taken out by what it leaves (both
    without a solve), and after every n points it is made anew, so rounding does not
    add up. noise is above zero. A row with x or y missing is no point, but counts
    among the n rows.
    """
    own = scale**2 + noise**2

    def step(state, at, value):
        rows, inverse, since = state or ([], np.zeros((0, 0)), 0)
        points = np.array([r for r in rows if r is not None], float).reshape(-1, 2)
        out = {"gp_mean": None, "gp_var": None}
        if at is not None:
            near = rbf(points[:, 0], at, length, scale)
            weights = inverse @ near
            out = {"gp_mean": float(weights @ points[:, 1]), "gp_var": float(scale**2 - weights @ near)}
        rows = [*rows, (at, value) if at is not None and value is not None else None]
        if rows[-1] is not None:
            left = own - weights @ near  # what the new point has of its own
            column = np.append(-weights, 1.0) / left
            grown = np.zeros((len(points) + 1,) * 2)
            grown[:-1, :-1] = inverse
            inverse = grown + np.outer(column, column) * left
            since += 1
        if len(rows) > n:
            if rows[0] is not None:
                inverse = inverse[1:, 1:] - np.outer(inverse[1:, 0], inverse[0, 1:]) / inverse[0, 0]
            rows = rows[1:]
        if since >= n:
            xs = np.array([r[0] for r in rows if r is not None], float)
            inverse, since = np.linalg.inv(rbf(xs[:, None], xs[None, :], length, scale) + noise**2 * np.eye(len(xs))), 0
        return (rows, inverse, since), out

    return Recurrence(name, (x, y), step, "struct<gp_mean:double,gp_var:double>")
