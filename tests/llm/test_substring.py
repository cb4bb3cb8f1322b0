"""Substring dedup against a table of every 20-word window."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tideline.llm import substring

KEY = lambda k: (k is not None, k or 0)


def brute(rows, n=20):
    """rows: (key, text) -> (key, n_words, n_removed, kept)."""
    texts = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    first = {}
    for k, w in texts:
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, (KEY(k), i)), (KEY(k), i))
    out = []
    for k, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (KEY(k), i):
                gone[i : i + n] = [True] * n
        out.append((k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def make(seed, n):
    """Texts that share passages, with copies, edits, runs of one word and periodic stretches."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(seed % 3 * 40 + 6)]
    passages = [r.choices(vocab, k=r.randint(15, 120)) for _ in range(8)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(r.randint(0, 6)):
            kind = r.random()
            if kind < 0.4:
                words += r.choices(vocab, k=r.randint(1, 60))
            elif kind < 0.75:
                p = list(r.choice(passages))
                if r.random() < 0.5:
                    p[r.randrange(len(p))] = "edit"
                a = r.randrange(len(p))
                words += p[a if r.random() < 0.3 else 0 :]
            elif kind < 0.9:
                words += [r.choice(vocab)] * r.randint(1, 50)
            else:
                words += r.choices(vocab, k=r.randint(1, 4)) * r.randint(1, 20)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed, sorted_rows):
    rows = list(enumerate(make(seed, 120)))
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted_rows(substring.drop_repeats(df), "doc_id", "n_words", "n_removed", "kept") == brute(rows)


def test_odd_rows(odd_rows, odd, clashing, none, sorted_rows):
    want = brute([r[:2] for r in odd_rows])
    for df in (odd, clashing):
        assert sorted_rows(substring.drop_repeats(df), "doc_id", "n_words", "n_removed", "kept") == want
    assert substring.drop_repeats(none).count() == 0


@pytest.mark.parametrize("key", ["doc", "body", "row"])
def test_names(spark, key, sorted_rows):
    text = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (2, text)], f"{key} long, text string")
    assert sorted_rows(substring.drop_repeats(df, key), key, "n_removed") == [(1, 0), (2, 30)]


def mixed(*lists):
    """(key, text): each text's words out of a list, and a repeat of some of them."""
    r = random.Random(8)
    out = []
    for k, words in enumerate(lists):
        out += [(k, " ".join(words)), (50 + k, " ".join(["before", *words[3:], "after"])), (90 + k, " ".join(r.sample(words, len(words))))]
    return out


def test_equal_hashes(spark, sorted_rows):
    """Words whose hashes are equal are told apart, alone and inside of longer repeats."""
    one, two = "R得ᇥ", "=it\x18(\x0enb"
    assert len(set(substring.word_hashes([one.encode(), two.encode()])[0].tolist())) == 1
    words = [f"w{i}" for i in range(60)]
    for at in (5, 30):
        a, b = ([*words[:at], x, *words[at + 1 :]] for x in (one, two))
        for rows in ([(1, " ".join(a[:20])), (2, " ".join(b[:20]))], mixed(b, a, b, a)):
            df = spark.createDataFrame(rows, "doc_id long, text string")
            assert sorted_rows(substring.drop_repeats(df), "doc_id", "n_words", "n_removed", "kept") == brute(rows)


def test_own_repeats(spark, sorted_rows):
    """Repeats inside of one text leave no edges: a long periodic text has as many as one of its periods."""
    words = [f"p{i}" for i in range(7)] * 3000
    texts = substring.Texts(spark.createDataFrame([(1, " ".join(words)), (2, "q " + " ".join(words[:50]))], "doc_id long, text string"), "doc_id", "text")
    rows = substring.edges(texts.docs).collect()
    assert len(rows) < 30 and [(r.place, r.label) for r in rows if r.kmer is None and r.doc == 1] == [(7, len(words) - 26)]


def test_weak_hashes(spark, sorted_rows, monkeypatch):
    """Even where nearly all words have one of a few hashes, results are those of the words."""
    strong = substring.word_hashes
    monkeypatch.setattr(substring, "word_hashes", lambda bodies: (strong(bodies)[0] % 3, strong(bodies)[1]))
    rows = list(enumerate(make(3, 40)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted_rows(substring.drop_repeats(df), "doc_id", "n_words", "n_removed", "kept") == brute(rows)


def test_equal_keys(spark, sorted_rows):
    """Rows of one key and of different texts each keep what is no repeat; equal windows count by their starts."""
    r = random.Random(6)
    texts = [" ".join(f"y{r.randrange(400)}" for _ in range(42)) for _ in range(300)]
    rows = [(5, t) for t in texts] + [(5, f"a b {texts[0]}"), (4, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted_rows(substring.drop_repeats(df), "doc_id", "n_words", "n_removed", "kept") == brute(rows)


def test_paths_are_compacted(spark):
    """Two copies of a long text are one path, a shared passage is one in each text, branches part paths."""
    words = [f"z{i}" for i in range(2000)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(["x"] + words[500:900] + ["y"]))]
    texts = substring.Texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    found = substring.vertices(texts, substring.edges(texts.docs))
    got = sorted((r.doc, r.start, r.size) for r in substring.paths(found).collect())
    n = 900 - 500 - 19
    assert got == [(d, a, b) for d in (1, 2) for a, b in ((0, 500), (500, n), (500 + n, 1981 - 500 - n))] + [(3, 1, n)]
    assert found.count() > 10 * len(got)


def test_spans(spark):
    text = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (2, f"a b {text} c"), (3, " ".join(f"x{i}" for i in range(5, 24)))], "doc_id long, text string")
    got = {r.doc_id: r for r in substring.drop_repeats(df).collect()}
    assert [(s.start, s.stop) for s in got[2].removed] == [(2, 32)] and got[2].kept == "a b c"
    assert got[1].n_removed == 0 and got[3].n_removed == 0


def test_repeated_rows(spark, sorted_rows):
    text = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted_rows(substring.drop_repeats(df), "doc_id", "n_removed") == [(1, 0), (1, 0), (2, 30)]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, substring.op6_substring_dedup(spark, sf_dir).collect()))
    want = [(k, n, g, hashlib.sha256(kept.encode()).hexdigest()) for k, n, g, kept in brute([tuple(r) for r in docs.collect()])]
    assert got == sorted(want)


def test_partitioning_does_not_matter(spark, sorted_rows):
    rows = list(enumerate(make(7, 60)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (substring.drop_repeats(d).withColumn("kept", F.md5(F.col("kept").cast("binary"))) for d in (df.coalesce(1), df.repartition(9)))
    assert sorted_rows(a) == sorted_rows(b)


def test_word_hashes():
    """Equal words have equal hashes wherever they stand, others have not; words are counted for each text."""
    r = random.Random(9)
    words = {"".join(r.choices("abé♞", k=r.choice([1, 2, 7, 8, 9, 16, 17, 40, 63, 64, 65, 200]))) for _ in range(3000)}
    words |= {"a" * k for k in range(1, 200)} | {"a\0", "a\0\0"}
    texts = [" ".join(r.choices(sorted(words), k=r.randint(0, 200))) + r.choice(["", "\n", " \t"]) for _ in range(100)] + ["", None, "  ", "x"]
    hashes, counts = substring.word_hashes([None if t is None else t.encode() for t in texts])
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert counts.tolist() == [len(s) for s in split]
    flat = [w for s in split for w in s]
    seen = dict(zip(flat, hashes.tolist()))
    assert [seen[w] for w in flat] == hashes.tolist() and len(set(seen.values())) == len(seen)
    assert substring.word_hashes([])[0].size == 0
