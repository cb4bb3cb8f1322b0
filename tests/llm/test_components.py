"""Connected components against a plain union of sets."""

import random

import pytest

from tideline.llm.common import connected_components


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((x, find(x)) for x in root)


def chain(n):
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    return list(zip(ids, ids[1:]))


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(1, 1)],
        [(2, 1), (3, 1), (5, 4)],
        [(1, 2), (2, 1), (1, 2)],
        chain(150),
        [(i, i + 1) for i in range(60)],
        [(0, i) for i in range(1, 300)] + [(-5, 299), (400, 401)],
        [(random.Random(i).randrange(200), random.Random(i + 999).randrange(200)) for i in range(120)],
        [(-(2**63), 2**63 - 1), (2**63 - 1, 0)],
    ],
    ids=range(9),
)
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert sorted(map(tuple, connected_components(df).collect())) == plain(edges)
