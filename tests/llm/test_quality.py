"""Quality rules: statistics by plain code, rules on planted and held-out labels."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import quality


def stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit)


def test_statistics(odd_rows):
    for row in odd_rows:
        assert quality.text_stats(None if row[1] is None else row[1].encode())[:5] == stats(row[1])


def test_verdicts(spark, odd, odd_rows, clashing, none, sorted_rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    judged, _ = quality.quality_rules(odd, labels)
    rows = judged.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        n, repeat = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert r.kept == (not r.base_failed and r.rule is None)
    assert sorted_rows(quality.quality_rules(clashing, labels)[0]) == sorted_rows(judged)
    kept = quality.filter_documents(clashing, labels)
    assert kept.columns == clashing.columns
    assert kept.count() == sum(r.kept for r in rows)
    assert quality.quality_rules(none, labels)[0].count() == 0
    assert quality.quality_rules(odd, labels.where("false"))[1] == []


def test_rules_find_planted_conjunction():
    r = np.random.default_rng(0)
    x = r.random((4000, 4))
    bad = (x[:, 1] > 0.8) & (x[:, 2] <= 0.4)
    rules = quality.learn_rules(x, bad, list("abcd"))
    hit = np.zeros(len(x), bool)
    for rule in rules:
        hit |= quality._cover(rule.tests, x, list("abcd"))
    assert (hit & bad).sum() > 0.95 * bad.sum() and (hit & ~bad).sum() < 0.02 * bad.sum()
    assert quality.learn_rules(x[:0], bad[:0], list("abcd")) == []
    assert quality.learn_rules(x, np.zeros(len(x), bool), list("abcd")) == []


def test_noise_gives_no_rules():
    r = np.random.default_rng(0)
    assert quality.learn_rules(r.random((2000, 4)), r.random(2000) < 0.3, list("abcd")) == []


def test_expression_equals_numpy(spark):
    """The ordered Spark expression gives each row the first rule that numpy says covers it."""
    r = np.random.default_rng(4)
    names = list(quality.FEATURES)
    cols = {n: r.integers(0, 20, 500) for n in quality._NAMES}
    df = spark.createDataFrame([tuple(int(cols[n][i]) for n in quality._NAMES) for i in range(500)], quality.STATS)
    x = np.column_stack([np.where(cols[b] > 0, cols[a] / np.maximum(cols[b], 1), 0.0) for a, b in quality.FEATURES.values()])
    rules = [quality.Rule((quality.Test(names[0], True, 2.0), quality.Test(names[1], False, 0.7)), 0, 0), quality.Rule((quality.Test(names[3], True, 1.5),), 0, 0)]
    got = [r.n for r in df.select(quality.rejected_by(rules).alias("n")).collect()]
    want = [next((k for k, rule in enumerate(rules, 1) if quality._cover(rule.tests, x[i : i + 1], names)[0]), None) for i in range(500)]
    assert got == want


@pytest.mark.parametrize("fold", [0, 1])
def test_held_out(spark, sf_dir, fold):
    """Rules learned on one half of the labels, judged on the other."""
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == fold
    judged, _ = quality.quality_rules(docs, labels.where(half))
    rows = judged.join(labels.where(~half), "doc_id").select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [not r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) > 0.95


def test_query(spark, sf_dir):
    """Statistics, base limits and verdicts; the learned rules are applied by plain code."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rules = quality.learn_rules(*quality.labelled_sample(docs, labels, "doc_id", "text"))
    got = quality.op3_quality_rules(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats(text)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        counts = dict(zip(quality._NAMES, quality.text_stats(None if text is None else text.encode()), strict=True))
        values = {k: counts[a] / counts[b] if counts[b] else 0.0 for k, (a, b) in quality.FEATURES.items()}
        hit = [all(values[t.feature] > t.threshold if t.above else values[t.feature] <= t.threshold for t in rule.tests) for rule in rules]
        assert (r.base_failed, r.kept) == (failed, not failed and not any(hit))
        assert r.rule == (hit.index(True) + 1 if any(hit) else None)
