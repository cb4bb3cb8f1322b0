"""Exact top-k against all products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.llm import topk


def brute(rows, queries, k):
    out = []
    for qid in sorted({q[0] for q in queries}):
        q = min(v for i, v in queries if i == qid)
        found = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qid)[:k]
        out += [(qid, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return out


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(3)
    rows = [(i, [r.randint(-40, 40) for _ in range(8)]) for i in range(600)]
    rows += [(i, [7] * 8) for i in range(600, 900)]  # one very common vector
    rows += [(i, [0] * 8) for i in range(900, 905)]
    return rows


@pytest.mark.parametrize("shard_rows, leaf", [(10_000, 256), (100, 8), (900, 2), (5, 4)])
def test_against_all_products(spark, vectors, shard_rows, leaf, monkeypatch):
    monkeypatch.setattr(topk, "LEAF_ROWS", leaf)
    monkeypatch.setattr(topk, "QUERY_ROWS", 40)
    df = spark.createDataFrame(vectors, "id long, v array<long>").repartition(7)
    queries = [x for x in vectors if x[0] % 9 == 0]
    got = sorted(map(tuple, topk.top_k(df.where("id % 9 = 0"), df, 5, shard_rows).collect()))
    assert got == brute(vectors, queries, 5)


def test_shards_grow_before_they_multiply():
    counts = [topk.shard_count(n, 10) for n in (0, 1, 10, 11, 640, 641, 5120, 5121, 51_200)]
    assert counts == [1, 1, 1, 2, 64, 64, 64, 65, 640]


def test_few_candidates_and_repeats(spark):
    rows = [(1, [1, 2]), (2, [3, 4]), (2, [3, 4]), (3, [0, -1])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    assert sorted(map(tuple, topk.top_k(df, df, 5).collect())) == brute(rows, rows, 5)
    assert topk.top_k(df.where("false"), df, 5).count() == 0
    assert topk.top_k(df, df.where("false"), 5).count() == 0
    assert topk.top_k(df.where("id = 1"), df.where("id = 1"), 5).count() == 0


def test_integer_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [-inf, 0.0]), (None, [1.0, 1.0]), (7, [0.1, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "v": F.lit("y")})
    got = {r.id: list(r.v) for r in topk.integer_vectors(df).collect()}
    assert got == {1: [128, -1], 7: [math.floor(256 * 0.10000000149011612), 768]}


def test_unequal_lengths(spark):
    """A query is compared with vectors of its length; those of no components have a product of zero."""
    rows = [(i, [i, -i, 3]) for i in range(20)] + [(i, [i - 25, 2]) for i in range(20, 40)] + [(40, []), (41, []), (42, [7])]
    df = spark.createDataFrame(rows, "id long, v array<long>").repartition(3)
    want = [x for d in range(4) for x in brute([r for r in rows if len(r[1]) == d], [r for r in rows if len(r[1]) == d], 3)]
    assert sorted(map(tuple, topk.top_k(df, df, 3, 5).collect())) == sorted(want)


def test_far_shards_are_left_out(spark, monkeypatch):
    """On vectors in clusters a query goes to few of the shards, and the result is that of all products."""
    r = random.Random(5)
    rows = []
    for c in range(16):
        centre = [r.choice([-900, 900]) for _ in range(6)]
        rows += [(c * 100 + i, [x + r.randint(-20, 20) for x in centre]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, v array<long>").repartition(5)
    sent = []
    search = topk._search_shards
    monkeypatch.setattr(topk, "_search_shards", lambda asked, shards, k, first: (sent.append((first, asked.count(), shards.select("shard").distinct().count())), search(asked, shards, k, first))[1])
    queries = [x for x in rows if x[0] % 7 == 0]
    assert sorted(map(tuple, topk.top_k(df.where("id % 7 = 0"), df, 5, 50).collect())) == brute(rows, queries, 5)
    (_, home, shards), (_, more, _) = sent
    assert home == len(queries) and shards >= 16 and more < 0.25 * len(queries) * shards


def test_hot_cell_is_dealt_out(spark, monkeypatch):
    """Half of all vectors are one: their cell becomes several shards."""
    rows = [(i, [i % 50, 3]) for i in range(500)] + [(i, [9, 9]) for i in range(500, 1000)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    seen = []
    search = topk._search_shards
    monkeypatch.setattr(topk, "_search_shards", lambda asked, shards, k, first: (seen.append(shards.groupBy("shard").count().agg({"count": "max"}).first()[0]), search(asked, shards, k, first))[1])
    assert sorted(map(tuple, topk.top_k(df.where("id < 40"), df, 5, 100).collect())) == brute(rows, rows[:40], 5)
    assert seen[0] <= 250


def test_bounds_are_tight():
    """Best-first traversal leaves out most of a tree whose vectors lie apart."""
    import numpy as np

    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(-5, 6, (256, 4)) + c for c in (0, 200, 400, 800)]).astype(float)
    tree = topk.KDTree(np.arange(len(x)), x, 16)
    seen = []
    best = topk.Best(1, 5, np.array([-np.inf]))
    offer = best.offer
    best.offer = lambda rows, q, ids, s: (seen.extend(ids), offer(rows, q, ids, s))
    tree.search(np.array([-1]), np.ones((1, 4)), best)
    want = sorted(zip(-x.sum(axis=1), range(len(x))))[:5]
    assert best.id[0].tolist() == [i for _, i in want]
    assert len(seen) < len(x) / 4
