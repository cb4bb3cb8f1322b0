"""Exact top-k search by inner product over KD-trees, one for each shard of the vectors.

Shards are cells of space: median splits of a bounded sample cut it, every vector
goes to its cell, and a cell that holds too many is dealt out. A shard's tree is built by median splits and keeps the tight box of each node.
The inner product of a query with any vector in a box is at most
sum(max(q * low, q * high)), so a query descends into the child of the larger
bound first and leaves out every node whose bound is below its k-th best score.
That score is handed on from shard to shard: a query first searches the shard of its
own cell, and is then sent only to shards whose box can still hold something better.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import discard, materialise, row_count

#: Vectors in a tree, about, as long as there are no more than SHARDS trees; beyond, trees grow up to
#: GROWTH times as large, but not beyond SHARD_BYTES of components, before there are more of them.
SHARD_ROWS, SHARDS, GROWTH, SHARD_BYTES = 8_192, 64, 8, 32 << 20
#: Bytes of the sample that cuts space into cells, and of the boxes that the driver holds at a time, at most.
SAMPLE_BYTES, BOX_BYTES = 8 << 20, 32 << 20
#: Vectors in a leaf at most.
LEAF_ROWS = 256
#: Queries that one task holds, and that step through a tree together, at most.
QUERY_ROWS = 65_536
QUERY_BLOCK = 1024
SCALE = 256
K = 5


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of each component, x as double.

    Rows whose key or vector is null, or whose vector holds a null or a
    component that is not finite, are left out, as they have no place in a search.
    """
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).where(sound).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


class KDTree:
    """Median splits on the widest side; nodes in arrays, leaves as ranges of the reordered rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        low, high, left, right, ranges = [], [], [], [], []
        perm = np.arange(len(ids))

        def build(a: int, b: int) -> int:
            rows = self.x[perm[a:b]]
            n = len(low)
            low.append(rows.min(axis=0))
            high.append(rows.max(axis=0))
            left.append(-1)
            right.append(-1)
            ranges.append((a, b))
            spread = high[n] - low[n]
            if b - a > leaf and spread.any():
                side = rows[:, int(spread.argmax())]
                perm[a:b] = perm[a:b][np.argsort(side, kind="stable")]
                m = (a + b) // 2
                left[n] = build(a, m)
                right[n] = build(m, b)
            return n

        build(0, len(ids))
        self.ids, self.x = self.ids[perm], self.x[perm]
        self.low, self.high = np.array(low), np.array(high)
        self.left, self.right, self.ranges = left, right, ranges

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and node, the most that an inner product with a vector in its box can be."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, qids: np.ndarray, q: np.ndarray, best: Best) -> None:
        """Puts what this tree has into ``best``, best node first for each query.

        The queries of a block step together: in each step every open query takes
        its open node of the largest bound, and queries that take the same node
        are scored in one product.
        """
        bound = self.bounds(q)
        is_leaf = np.array(self.left) < 0
        left, right = np.array(self.left), np.array(self.right)
        open_ = np.full(bound.shape, -np.inf)
        open_[:, 0] = bound[:, 0]
        live = np.arange(len(q))
        while len(live):
            node = open_[live].argmax(axis=1)
            top = open_[live, node]
            going = top >= best.kth(live)  # equal scores may win by a smaller id
            going &= np.isfinite(top)
            live, node = live[going], node[going]
            open_[live, node] = -np.inf
            inner = ~is_leaf[node]
            for child in (left, right):
                open_[live[inner], child[node[inner]]] = bound[live[inner], child[node[inner]]]
            for n in np.unique(node[~inner]):
                mine = live[node == n]
                a, b = self.ranges[n]
                best.offer(mine, qids[mine], self.ids[a:b], q[mine] @ self.x[a:b].T)


class Best:
    """The k best (score, id) of each query of a block so far, score falling, then id rising."""

    def __init__(self, n: int, k: int, start: np.ndarray):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.start = start  # k-th best scores that are known from elsewhere

    def kth(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.start[rows])

    def offer(self, rows: np.ndarray, qids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.where(ids[None, :] == qids[:, None], -np.inf, scores)
        s = np.concatenate([self.score[rows], scores], axis=1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        i = np.where(np.isneginf(s), np.iinfo(np.int64).max, i)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(s, order, axis=1)
        self.id[rows] = np.take_along_axis(i, order, axis=1)


def _as_matrix(column: pd.Series) -> np.ndarray:
    # doubles: sums of products of such integers stay exact below 2^53, and matrix products are fast
    return np.stack(column.to_numpy()).astype(np.float64)


class Cells:
    """Median splits of a sample into cells: a vector goes left where its component is at most the threshold."""

    def __init__(self, x: np.ndarray, count: int):
        self.side, self.threshold, self.left, self.right, self.cell = [], [], [], [], []
        self.count = 0
        self._build(x, count)

    def _build(self, x: np.ndarray, count: int) -> int:
        n = len(self.side)
        for column, value in ((self.side, 0), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.cell, -1)):
            column.append(value)
        spread = x.max(axis=0) - x.min(axis=0) if len(x) > 1 and x.shape[1] else np.zeros(1)
        if count > 1 and spread.any():
            side = int(spread.argmax())
            v = np.sort(x[:, side])
            half = count // 2
            t = v[len(v) * half // count - 1] if len(v) * half // count else v[0]
            if t == v[-1]:  # ties up to the end: cut before them
                t = v[np.searchsorted(v, t) - 1]
            self.side[n], self.threshold[n] = side, float(t)
            low = x[:, side] <= t
            self.left[n] = self._build(x[low], half)
            self.right[n] = self._build(x[~low], count - half)
        else:
            self.cell[n], self.count = self.count, self.count + 1
        return n

    def of(self, x: np.ndarray) -> np.ndarray:
        side, threshold, left, right, cell = map(np.array, (self.side, self.threshold, self.left, self.right, self.cell))
        node = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(cell[node] < 0)).size:
            at = node[inner]
            node[inner] = np.where(x[inner, side[at]] <= threshold[at], left[at], right[at])
        return cell[node]


def _in_cells(vectors: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """(id, v, cell): the vector's length and its cell as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            size = np.array(v.value_lengths())
            out = size.astype(np.int64) << 40
            for d in np.unique(size).tolist():
                if d in cells:
                    own = np.flatnonzero(size == d)
                    out[own] |= cells[d].of(v.take(pa.array(own)).flatten().to_numpy().reshape(len(own), d).astype(np.float64)) << 20
            yield pa.RecordBatch.from_arrays([b.column(0), v, pa.array(out, pa.int64())], ["id", "v", "cell"])

    return vectors.select("id", "v").mapInArrow(run, "id long, v array<long>, cell long")


def _dealt(rows: DataFrame, slices: DataFrame) -> DataFrame:
    """Adds shard: the cell, and one of its slices."""
    k = F.coalesce("slices", F.lit(1))
    return rows.join(F.broadcast(slices), "cell", "left").withColumn("shard", F.col("cell") + F.pmod(F.xxhash64("id"), k)).drop("cell", "slices")


FOUND = "shard long, qid long, id long, score long, low array<double>, high array<double>"


def _search_shards(asked: DataFrame, shards: DataFrame, k: int, all_shards: bool) -> DataFrame:
    """What each shard's k best are at most for the queries sent to it, and (with ``all_shards``) each shard's box.

    asked: (shard, qid, q, kth), written; shards: (shard, id, v). A task has one
    shard and at most QUERY_ROWS queries, about; more are dealt into blocks.
    """
    blocks = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks"))
    blocks = F.broadcast(materialise(blocks, "blocks"))
    left = asked.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("qid", F.lit(1)), F.col("blocks")).cast("int")).drop("blocks")
    right = shards.join(blocks, "shard", "left" if all_shards else "inner").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")

    names = [c.split()[0] for c in FOUND.split(", ")]

    def table(columns: list, n: int) -> pd.DataFrame:
        """Nullable numbers, and boxes or none."""
        out = {c: pd.array(x if x is not None else [None] * n, "Int64") for c, x in zip(names, columns[:4])}
        return pd.DataFrame(out | {c: pd.Series(x if x is not None else [None] * n, dtype=object) for c, x in zip(names[4:], columns[4:])})

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return table([None] * 6, 0)
        tree, shard = KDTree(right["id"].to_numpy(np.int64), _as_matrix(right["v"])), int(right["shard"].iloc[0])
        parts = [table([[shard], None, None, None, [tree.low[0]], [tree.high[0]]], 1)] if all_shards else []
        left = left.sort_values("qid", kind="stable", ignore_index=True)
        for i in range(0, len(left), QUERY_BLOCK):
            part = left.iloc[i : i + QUERY_BLOCK]
            qids, start = part["qid"].to_numpy(np.int64), part["kth"].to_numpy(np.float64)
            best = Best(len(part), k, np.where(np.isnan(start), -np.inf, start))
            tree.search(qids, _as_matrix(part["q"]), best)
            r, c = np.nonzero(np.isfinite(best.score) & (best.score >= best.start[:, None]))
            parts.append(table([np.full(len(r), shard), qids[r], best.id[r, c], best.score[r, c].astype(np.int64), None, None], len(r)))
        return pd.concat(parts, ignore_index=True) if parts else table([None] * 6, 0)

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(run, FOUND)


def _within_reach(asked: DataFrame, boxes: pd.DataFrame) -> DataFrame:
    """(shard, qid, q, kth): each query with every shard but its home whose box can hold a score of kth or more."""
    by_length = {d: (g["shard"].to_numpy(np.int64), np.stack(g["low"].to_numpy()), np.stack(g["high"].to_numpy())) for d, g in boxes.groupby(boxes["shard"] // 2**40)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, kth = b.column(0).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
            size = np.array(b.column(2).value_lengths())
            for d in set(size.tolist()) & set(by_length):
                shards, low, high = by_length[d]
                own = np.flatnonzero(size == d)
                for i in range(0, len(own), QUERY_BLOCK):
                    rows = own[i : i + QUERY_BLOCK]
                    q = b.column(2).take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), d).astype(np.float64)
                    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    near = (bound >= np.where(np.isnan(kth[rows]), -np.inf, kth[rows])[:, None]) & (shards[None, :] != home[rows][:, None])
                    r, c = np.nonzero(near)
                    for j in range(0, len(r), QUERY_BLOCK):
                        part = b.take(pa.array(rows[r[j : j + QUERY_BLOCK]]))
                        yield pa.RecordBatch.from_arrays([pa.array(shards[c[j : j + QUERY_BLOCK]]), *part.columns[1:]], ["shard", "qid", "q", "kth"])

    return asked.select("shard", "qid", "q", "kth").mapInArrow(run, "shard long, qid long, q array<long>, kth double")


def shard_count(rows: int, shard_rows: int = SHARD_ROWS, most_rows: int | None = None) -> int:
    most = min(GROWTH * shard_rows, most_rows or GROWTH * shard_rows)
    return max(1, -(-rows // most), min(-(-rows // min(shard_rows, most)), SHARDS))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    queries and vectors: (id, v) as from integer_vectors. Vectors of another length
    than the query's are no candidates. A query's own id is no candidate; a query
    with fewer than k candidates has them all, one with none has no row. Vectors
    with equal ids are each a candidate; a query id that repeats is asked once, with
    its least vector. An empty table on either side gives an empty result.

    Two passes: first every query searches the shard of its cell, which gives it a
    k-th score; then it goes to those shards whose box reaches that score. The k-th
    score only grows, so nothing that belongs to the result is lost. A task holds
    one shard and one block of queries. Cells come from a sample of SAMPLE_BYTES at
    most (rows of certain hashes); every row is in a shard whatever the sample was.
    """
    vectors, queries = materialise(vectors, "vectors"), materialise(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
    stats = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    rows, length = stats["n"], max(1, stats["d"] or 1)
    n = shard_count(rows, shard_rows, max(1, SHARD_BYTES // (8 * length)))
    most = max(64, SAMPLE_BYTES // (8 * length))
    sample = vectors.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(max(1, rows // most))) == 0).select("v").limit(2 * most).toPandas()["v"]
    cells = {d: Cells(np.stack(g.to_numpy()).astype(np.float64), n) for d, g in sample.groupby(sample.map(len)) if d}
    placed = materialise(_in_cells(vectors, cells), "cells")
    # a cell of over twice the mean is dealt out; one row for each cell
    mean = max(1, -(-rows // n))
    slices = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 2 * mean).select("cell", F.ceil(F.col("c") / mean).alias("slices"))
    slices = materialise(slices, "slices")
    shards = materialise(_dealt(placed, slices), "shards")
    asked = materialise(_dealt(_in_cells(queries, cells), slices).select("shard", F.col("id").alias("qid"), F.col("v").alias("q")), "asked")
    discard(vectors, queries, placed, slices)
    first = materialise(_search_shards(asked.withColumn("kth", F.lit(None).cast("double")), shards, k, True), "first")
    known = first.where("qid is not null").groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    known = asked.join(known.select("qid", F.when(F.col("n") >= k, F.col("low")).cast("double").alias("kth")), "qid", "left")
    known = materialise(known.select("shard", "qid", "q", "kth"), "known")
    # boxes by part, so that the driver never has more than BOX_BYTES of them
    boxes = first.where("low is not null").dropDuplicates(["shard"]).select("shard", "low", "high")
    boxes = materialise(boxes.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(1 + row_count(boxes) * length * 16 // BOX_BYTES))), "boxes")
    near = [_within_reach(known, boxes.where(F.col("part") == r["part"]).drop("part").toPandas()) for r in boxes.select("part").distinct().collect()]
    found = first.where("qid is not null").select("qid", "id", "score")
    if near:
        pairs = materialise(reduce(DataFrame.union, near), "pairs")
        found = found.union(_search_shards(pairs, shards, k, False).select("qid", "id", "score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
    out = materialise(out, "top")
    discard(shards, asked, first, known, boxes, *([pairs] if near else []))
    return out


QUERY_STEP = 50


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors.where(F.col("id") % QUERY_STEP == 0), vectors)


ORACLE = f"""
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_STEP} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
