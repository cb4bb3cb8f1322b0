"""SimHash near-dedup against fingerprints of every shingle and all pairs."""

import random
import re
from itertools import pairwise

import numpy as np
import pytest
import xxhash

from tideline.llm import jaccard, simhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, fps, budget):
    root = list(range(len(keys)))
    moved = True
    while moved:
        moved = False
        for i in range(len(keys)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= budget and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    moved = True
    least = {}
    for k, r in zip(keys, root):
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    return [least[r] for r in root]


def test_fingerprints(odd_rows):
    for row in odd_rows:
        if len(row[1] or "") < 5000:
            assert simhash.fingerprint(None if row[1] is None else row[1].encode()) == fingerprint(row[1])


@pytest.mark.parametrize("budget", [0, 1, 3, 7])
def test_components(spark, odd, odd_rows, clashing, sorted_rows, budget):
    fps = [simhash.fingerprint(None if r[1] is None else r[1].encode()) for r in odd_rows]
    want = sorted(((r[0], int(np.uint64(f).astype(np.int64)), c) for r, f, c in zip(odd_rows, fps, components([r[0] for r in odd_rows], fps, budget))), key=repr)
    assert sorted_rows(simhash.near_components(odd, budget=budget)) == want
    if budget == 3:
        assert sorted_rows(simhash.near_components(clashing, budget=budget)) == want


@pytest.mark.parametrize("n, near, exact", [(400, 6, 0), (400, 6, 16), (3000, 300, 16)])
def test_walk_finds_all_pairs(n, near, exact):
    r = random.Random(n)
    centres = [r.getrandbits(64) for _ in range(n - near * 5)]
    fps = sorted({*centres, *(c ^ sum(1 << r.randrange(64) for _ in range(r.randint(1, 4))) & (2**64 - 1) for c in centres[:near] for _ in range(5))})
    v = np.array(fps, np.uint64)
    found = {(int(i), int(j)) for i, j in ((a, b) for x, y in simhash.walk_pairs(v, v, 0, 3, exact, leaf=2, block=64) for a, b in zip(x, y)) if i < j}
    want = {(i, j) for i in range(len(v)) for j in range(i) if (int(v[i]) ^ int(v[j])).bit_count() <= 3}
    want = {(j, i) for i, j in want if not exact or v[i] >> np.uint64(64 - exact) == v[j] >> np.uint64(64 - exact)}
    assert {(i, j) for i, j in want} <= found
    assert all((fps[i] ^ fps[j]).bit_count() <= 3 for i, j in found)


def test_links_of_hot_prefix(spark):
    """Most fingerprints in one subtrie, in chains of single bits: slices and all four tries."""
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(300)}
    for i in range(20):
        x = 0xABCD << 48 | r.getrandbits(48)
        for _ in range(40):
            fps.add(x)
            x ^= 1 << r.randrange(64 if i % 2 else 48)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    links = simhash.near_links(df, 3, subtrie=16)
    edges = [(int(np.int64(a).astype(np.uint64)), int(np.int64(b).astype(np.uint64))) for a, b in links.collect()]
    assert all((a ^ b).bit_count() >= 1 for a, b in edges)
    label = {x: x for x in fps}
    for _ in range(len(fps)):
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    assert [label[x] for x in fps] == components(fps, fps, 3)


def test_keep_one(spark, odd, odd_rows, clashing, none):
    for df in (odd, clashing):
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        keys = [r.doc_id for r in kept.collect()]
        comps = {r.component_id for r in simhash.near_components(df).collect()}
        assert sorted(keys, key=repr) == sorted(comps, key=repr)
    assert simhash.near_components(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("keep", [simhash.keep_one, jaccard.keep_one])
def test_keep_one_of_each_component(spark, keep, sorted_rows):
    """Rows are chosen, not keys: a key may stand in several components, and twice in one."""
    r = random.Random(4)
    a, b, c = (" ".join(r.choices([f"v{i}" for i in range(500)], k=80)) for _ in range(3))
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "y"), (5, b, "z"), (None, c, "x"), (None, c, "x"), (7, c, "x"), (None, None, None), (None, "", "x")]
    df = spark.createDataFrame(rows, "_key long, text string, _n string").repartition(3)
    kept = sorted_rows(keep(df, "_key"))
    assert [r[:2] for r in kept] == sorted([(3, a), (5, b), (7, c), kept[-1][:2]], key=repr)
    assert kept[-1][0] is None and not kept[-1][1]


def test_links_are_real(spark):
    """Without stars each edge is a link within the budget, and the components are the same."""
    r = random.Random(2)
    fps = set()
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            x ^= 1 << r.randrange(64)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    edges = [(int(np.int64(a).astype(np.uint64)), int(np.int64(b).astype(np.uint64))) for a, b in simhash.near_links(df, 3, 16, stars=False).collect()]
    assert all(1 <= (a ^ b).bit_count() <= 3 for a, b in edges) and len(edges) < 4 * len(fps)
    label = {x: x for x in fps}
    for _ in fps:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    assert [label[x] for x in fps] == components(fps, fps, 3)


@pytest.mark.parametrize("block, bits, deeper", [(16, 6, 0), (16, 6, 12), (16, 16, 5), (16, 10, 6)])
def test_flips(block, bits, deeper):
    got = simhash.flips(block, bits, deeper, 3)
    want = [m for m in range(1 << deeper) if m.bit_count() <= 3 and not m >> max(0, bits + deeper - block)]
    assert sorted(got) == want


def test_query(spark, sf_dir):
    """The registered query on whole tables against all pairs of fingerprints."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = np.array([fingerprint(r.text) for r in docs], np.uint64)
    got = {r.doc_id: r for r in simhash.op2_simhash_dedup(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    assert [int(got[r.doc_id].fingerprint, 16) for r in docs] == fps.tolist()
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.array([r.doc_id for r in docs])
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert [got[r.doc_id].component_id for r in docs] == label.tolist()
    assert all(a <= b for a, b in pairwise(sorted(set(label.tolist()))))
