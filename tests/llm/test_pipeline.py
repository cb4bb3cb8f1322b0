"""The corpus pipeline against the brute-force versions of its stages, one after the other."""

import numpy as np
import public_tokenizers
from test_jaccard import components
from test_native import drop_lines, poisson, uniform
from test_packing import check, pieces
from test_quality import stats
from tokenizers import Tokenizer

import corpus_pipeline
from tideline.llm import linededup, mixing, quality


def judged(docs, rows, labels):
    """Documents that the base limits and the learned rules keep; the rules are applied by plain code."""
    rules = quality.learn_rules(*quality.labelled_sample(docs, labels, "doc_id", "text"))
    names, kept = list(quality.FEATURES), []
    for r in rows:
        got = dict(zip(quality._NAMES, quality.text_stats(None if r[1] is None else r[1].encode()), strict=True))
        n, *_, repeat = stats(r[1])
        x = np.array([[got[a] / got[b] if got[b] else 0.0 for a, b in quality.FEATURES.values()]])
        if n >= 50 and 100 * repeat <= 50 * n and not any(quality._cover(rule.tests, x, names)[0] for rule in rules):
            kept.append(r)
    return kept


def test_run(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
    rows = judged(docs, rows, labels)
    texts = {k: t for k, t, *_ in drop_lines(rows, linededup.MAX_SHARE, linededup.MIN_PAGES)}
    comps = dict(zip((r[0] for r in rows), components([(r[0], texts[r[0]]) for r in rows])))
    rows = [r for r in rows if comps[r[0]] == r[0]]
    n = {}
    for r in rows:
        n[r[3] or ""] = n.get(r[3] or "", 0) + 1
    mass = sum(float(c) ** mixing.ALPHA for c in n.values())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in rows:
        c = n[r[3] or ""]
        copies = poisson(float(c) ** mixing.ALPHA / mass * len(rows) / c, uniform(f"{mixing.SEED}:{r[0]}"))
        want += [(r[0], *p) for p in pieces(tokenizer.encode(texts[r[0]] or "", add_special_tokens=False).ids)] * copies
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert check(got) <= 1.05 * sum(r.length for r in got) / 2048 + 2


def test_near_dedup_of_equal_keys(spark, sorted_rows):
    """A doc_id that stands for two texts keeps both, one that repeats a text keeps it once."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(3, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted_rows(corpus_pipeline.near_dedup(spark, docs, ""), "doc_id", "text") == [(3, a), (5, b)]


def test_stages_on_odd_rows(spark, odd, none, sf_dir, tmp_path):
    """Each stage on nulls, repeats and empty texts, and on no rows; all but the last keep the columns."""
    for name, docs in (("odd", odd), ("none", none)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == corpus_pipeline.COLUMNS
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            if k and name == "odd":
                assert spark.read.parquet(str(tmp_path / f"{name}{k}")).count() > 0
