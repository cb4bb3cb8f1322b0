"""Near words against all pairs."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tideline.llm import variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    """{word: (n, n_near, form, form_n, root)}"""
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root)
    return out


def ours(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def some_words(n, seed=1):
    r = random.Random(seed)
    roots = ["".join(r.choices("abcé", k=r.randint(1, 7))) for _ in range(n)]
    words = Counter()
    for w in roots:
        words[w] += r.choice([1, 2, 4, 9, 40])
        for _ in range(r.randint(0, 4)):
            i = r.randrange(len(w) + 1)
            v = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcdé") + w[i:], w[:i] + r.choice("abcdé") + w[i + 1 :]])
            words[v] += r.choice([1, 2, 3, 8])
    return dict(words)


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)


def test_trie():
    words = dict(sorted(some_words(200).items()))
    trie = variants.Trie.unpack(variants.Trie.of(list(words), list(words.values())).pack())
    for w in [*words, "", "zzz", "abab"]:
        assert trie.near(w) == {v: n for v, n in words.items() if v != w and one_edit(v, w)}
    assert variants.Trie.of([], []).near("a") == {}


def test_groups(spark):
    words = some_words(250)
    assert ours(variants.group_variants(frame(spark, words))) == plain(words)


def test_shards_and_rounds(spark, monkeypatch):
    """Many tries, a broadcast for each few, and links that are merged."""
    words = some_words(250, 2)
    monkeypatch.setattr(variants, "SHARD_WORDS", 40)
    monkeypatch.setattr(variants, "ROUND_BYTES", 3000)
    monkeypatch.setattr(variants, "LINK_BYTES", 0)
    assert ours(variants.group_variants(frame(spark, words))) == plain(words)


def test_long_chain(spark):
    """A chain of forms as long as counts allow, and a form of many words."""
    words = {"a" * (i + 3): 2**i for i in range(30)} | {"b" * i + "x" + "b" * (20 - i): 1 for i in range(20)} | {"b" * 21: 50}
    assert ours(variants.group_variants(frame(spark, words))) == plain(words)


def test_very_long_words(spark):
    long = "ab" * 20_000
    words = {long: 5, long + "c": 50, long[1:]: 2, "x" + long: 100}
    got = ours(variants.group_variants(frame(spark, words)))
    assert got[long] == (5, 3, "x" + long, 100, "x" + long)
    assert got[long[1:]] == (2, 1, long, 5, "x" + long)


def expected_counts(rows):
    words = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def test_counts(odd, clashing, none, monkeypatch):
    rows = odd.collect()
    assert {r["word"]: r["n"] for r in variants.count_words(odd, spelled=variants.misspelled).collect()} == expected_counts(rows)
    assert {r["word"]: r["n"] for r in variants.count_words(clashing, spelled=variants.misspelled).collect()} == expected_counts(rows)
    assert ours(variants.group_variants(variants.count_words(none))) == {}
    monkeypatch.setattr(variants, "HELD", 5)
    more = {r["word"]: r["n"] for r in variants.count_words(odd, least_length=1, least_count=1).collect()}
    assert more["menu"] == 24 and more["a"] >= 1


@pytest.mark.parametrize("text", ["Ünder", "×÷abc"])
def test_letters(spark, text):
    df = spark.createDataFrame([(1, f"{text} {text}-{text}9{text}")], "doc_id long, text string")
    got = variants.count_words(df.withColumn("text", F.col("text"))).collect()
    assert [(r["word"], r["n"]) for r in got] == [("".join(c.lower() if c.isascii() else c for c in text), 4)]


def test_query(spark, sf_dir):
    words = expected_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = ours(variants.op13_spelling_variants(spark, sf_dir))
    assert set(got) == set(words)
    by_letters = sorted(words)[:: max(1, len(words) // 400)]
    truth = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in by_letters}
    assert {w: got[w][:2] for w in by_letters} == {w: (words[w], len(truth[w])) for w in by_letters}
