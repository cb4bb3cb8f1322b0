"""Near-dedup by Jaccard similarity against all pairs of shingle sets."""

import random
import re

import numpy as np
import pytest
from test_simhash import fingerprint

import corpus_pipeline
from tideline.llm import jaccard


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def components(rows):
    """The smallest key of each row's component: equal sets are linked, and those of similarity 0.8 or more."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), k) if x is not None), default=None)
    return [least[find(i)] for i in range(len(rows))]


def edited(words, n, r):
    """The words with n of them replaced, far from each other."""
    out = list(words)
    for i in r.sample(range(0, len(out) - 6, 6), n):
        out[i + 3] = f"new{r.random()}"
    return " ".join(out)


@pytest.fixture(scope="module")
def near_rows():
    """Copies from 0.6 to 1 around the limit, chains of copies, a large group of near copies and a passage that many share."""
    r = random.Random(3)
    vocab = [f"v{i}" for i in range(2000)]
    texts = []
    for _ in range(30):
        words = r.choices(vocab, k=r.randint(40, 400))
        texts += [" ".join(words)] + [edited(words, k, r) for k in range(len(words) // 60, len(words) // 25 + 2)]
    hot = r.choices(vocab, k=300)
    texts += [edited(hot, r.randint(0, 9), r) for _ in range(60)]
    passage = " ".join(r.choices(vocab, k=60))
    texts += [f"{' '.join(r.choices(vocab, k=r.randint(3, 80)))} {passage}" for _ in range(60)]
    chain = r.choices(vocab, k=200)
    for _ in range(12):
        chain = edited(chain, 3, r).split()
        texts.append(" ".join(chain))
    texts += ["a b c d e", "A b  c d e", "a b c d f", "a", "b", "", None, " \n"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("frequent", [10, 10**9])
def test_components(spark, near_rows, monkeypatch, frequent):
    """With and without shingles known to be frequent."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    docs = spark.createDataFrame(near_rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(docs).collect()}
    assert [got[k] for k, _ in near_rows] == components(near_rows)


def test_parity_bounds():
    """Never less than what two texts have in common, and far less than their sizes if that is little."""
    r = np.random.default_rng(5)
    for n, m, common in [(0, 0, 0), (1, 1, 1), (300, 280, 0), (300, 280, 250), (5000, 300, 200), (90_000, 100_000, 50), (70_000, 70_000, 69_000)]:
        s = r.integers(-(2**63), 2**63 - 1, n + m - common)
        a, b = np.sort(s[:n]), np.sort(s[n - common :])
        bound = jaccard.most_common(jaccard.parity(a), jaccard.parity(b), n, m)
        assert common <= bound <= common + 0.5 * (n + m - 2 * common) + 2
        assert bound == jaccard.most_common(jaccard.parity(b), jaccard.parity(a), m, n)


def test_odd_rows(spark, odd, odd_rows, clashing, none, sorted_rows):
    want = sorted(((r[0], c) for r, c in zip(odd_rows, components([r[:2] for r in odd_rows]))), key=repr)
    assert sorted_rows(jaccard.similar_components(odd)) == want
    assert sorted_rows(jaccard.similar_components(clashing)) == want
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted({c for _, c in want}, key=repr)
    assert jaccard.similar_components(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_stage_finds_edited_copies(spark):
    """Copies of Jaccard 0.8 and more whose fingerprints are more than 3 bits apart."""
    r = random.Random(11)
    words = r.choices([f"v{i}" for i in range(500)], k=300)
    copy = next(t for t in (edited(words, 6, r) for _ in range(100)) if (fingerprint(t) ^ fingerprint(" ".join(words))).bit_count() > 3)
    a, b = shingle_set(" ".join(words)), shingle_set(copy)
    assert len(a & b) / len(a | b) >= 0.8
    rows = [(1, " ".join(words), "en", "s", 1), (2, copy, "en", "s", 1), (3, edited(words, 12, r), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_prefixes_of_many_texts(spark, monkeypatch):
    """Passages of ten texts each come last in the order, however many texts there are, so no prefix has them."""
    most = {}

    def watched(*args, prefixes=jaccard.prefixes):
        out = prefixes(*args)
        most[0] = out.groupBy("h").count().agg({"count": "max"}).first()[0]
        return out

    monkeypatch.setattr(jaccard, "prefixes", watched)
    text = "concat_ws(' ', transform(sequence(1, 40), x -> concat('w', id, '_', x)), transform(sequence(1, 14), x -> concat('p', id % 2400, '_', x)))"
    assert jaccard.similar_components(spark.range(24_000).selectExpr("id AS doc_id", f"{text} AS text")).where("doc_id = component_id").count() == 24_000
    assert most[0] < 8


def test_order_levels(spark, monkeypatch):
    """Levels by the number of texts, from several hash ranges; of more shingles than are told apart, the most frequent."""
    monkeypatch.setattr(jaccard, "COUNTED", 500)
    texts = spark.range(64).selectExpr("id", "CAST(concat_ws(' ', transform(sequence(0, 80), x -> IF(id % (1 + x div 20) = 0, concat('c', x), concat('o', id, '_', x)))) AS BINARY) AS b").repartition(3)
    n = {}
    for r in texts.collect():
        for h in jaccard.shingles(bytes(r.b))[1].view(np.uint64).tolist():
            n[h] = n.get(h, 0) + 1
    want = {(h >> 32, int(1 + 8 * np.log2(k / 8))) for h, k in n.items() if k >= 8}
    for power in (0, 4):
        frequent = jaccard.frequent_shingles(texts, 5, power).cache()
        assert {tuple(r) for r in frequent.collect()} == want and len({k for _, k in want}) > 2
    levels = jaccard.order_levels(frequent)
    bits = len(levels).bit_length() - 1
    assert all(levels[top >> 32 - bits] >= k for top, k in want) and np.count_nonzero(levels) <= len(want)
    monkeypatch.setattr(jaccard, "MOST_FREQUENT", 20)
    assert set(jaccard.order_levels(frequent).tolist()) == {0, max(k for _, k in want)}
    assert jaccard.order_levels(frequent.limit(0)).tolist() == [0]
