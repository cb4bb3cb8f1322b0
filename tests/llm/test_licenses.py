"""Licence scan against plain search; the expression parser against its grammar."""

import re
import time

import pytest

from tideline.llm import licenses


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None,
    "",
    "cc by",
    "CC-BY-SA 4.0, all rights  reserved. GNU General Public License",
    "general public\nlicense general public license cc by cc by",
    "xcc by cc byx café cc by é",
    "all rights reserved " * 3000,
    "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0 */",
    "spdx-license-identifier: GPL-3.0-or-later\nSPDX-License-Identifier: MIT",
    "SPDX-License-Identifier:",
    "SPDX-License-Identifier: AND OR",
    "cc\x80by cc\x7fby",
]


def test_scan(spark, none):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([*enumerate(TEXTS), (None, "cc by"), (3, TEXTS[3])], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "labels", "_b")})
    rows = licenses.scan_licenses(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "cc by" if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in rows}
    assert by[7].expression == "MIT GPL-2.0-only Classpath-exception-2.0 WITH OR Apache-2.0 AND" and by[7].permitted and by[7].score == 1
    assert by[7].labels == "apache-2.0,gpl-2.0-only,mit"
    assert by[8].permitted is False and by[9].expression is None and by[10].expression is None
    assert licenses.scan_licenses(none).count() == 0


@pytest.mark.parametrize(
    "text, postfix, value",
    [
        ("MIT", "MIT", True),
        ("MIT OR GPL-2.0 AND GPL-3.0", "MIT GPL-2.0 GPL-3.0 AND OR", True),
        ("(MIT or GPL-2.0) and GPL-3.0", "MIT GPL-2.0 OR GPL-3.0 AND", False),
        ("((MIT))", "MIT", True),
        ("GPL-2.0 WITH x OR MIT", "GPL-2.0 x WITH MIT OR", True),
        ("MIT AND", "MIT", True),
        ("(MIT OR GPL-2.0", "", None),
        ("MIT some prose", "MIT", True),
        (")", "", None),
        ("", "", None),
    ],
)
def test_expressions(text, postfix, value):
    got = licenses.parse_expression(text)
    assert " ".join(got) == postfix
    assert licenses.evaluate(got, licenses._permissive) is value


def test_long_expressions():
    """Time in proportion: half a million terms, and as many brackets."""
    n = 500_000
    began = time.perf_counter()
    assert licenses.parse_expression("MIT" + " OR MIT" * n).count("OR") == n
    assert len(licenses.parse_expression("(" * n + "MIT" + ")" * n)) == 1
    assert len(licenses.parse_expression("(" * n + "MIT OR ISC" + ")" * (n - 1))) == 0
    assert time.perf_counter() - began < 15


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = licenses.op10_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
