"""Mixing, line dedup and sharding against plain code, and every SQL against its query."""

import hashlib
import math
import os
import re
import time
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tideline.llm import linededup, mixing, queries, sharding


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df, rel = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert sorted(map(tuple, df.select(cols).collect()), key=repr) == sorted(rel.select(*cols).fetchall(), key=repr)


def uniform(text):
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < 10_000:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mixing(odd, odd_rows, clashing, none, monkeypatch):
    for weights in (None, {"big": 1.0, "small": 3.0}, {"big": 0.0, "small": 0.0}):
        mixed = mixing.mix_sources(odd, weights=weights)
        n = Counter(r[3] or "" for r in odd_rows)
        w = {s: float(c) ** mixing.ALPHA for s, c in n.items()} if weights is None else {s: weights.get(s, 0.0) for s in n}
        rate = {s: w[s] / sum(w.values()) * len(odd_rows) / n[s] if sum(w.values()) else 0.0 for s in n}
        want = Counter()
        for r in odd_rows:
            want[r[0], r[1]] += poisson(rate[r[3] or ""], uniform(f"{mixing.SEED}:{'' if r[0] is None else r[0]}")) if rate[r[3] or ""] else 0
        assert Counter((r.doc_id, r.text) for r in mixed.collect()) == +want
    assert mixing.mix_sources(none).count() == 0
    other = mixing.mix_sources(clashing)
    assert set(clashing.columns) <= set(other.columns) and other.where("_source = 'other' and _u = 'other'").count() == other.count() > 0
    beyond = Counter(map(tuple, mixing.mix_sources(odd).select("doc_id", "copy", "shuffle_key").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_TERMS", 0)
    assert Counter(map(tuple, mixing.mix_sources(odd).select("doc_id", "copy", "shuffle_key").collect())) == beyond
    with pytest.raises(ValueError):
        mixing.mix_sources(odd, weights={"big": -1.0})


def test_mix_meets_weights(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("source"))
    got = {r.source: r["count"] for r in mixing.mix_sources(docs, weights={"a": 1, "b": 1, "c": 2}).groupBy("source").count().collect()}
    for s, share in (("a", 0.25), ("b", 0.25), ("c", 0.5)):
        assert abs(got[s] - share * 20_000) < 5 * math.sqrt(share * 20_000 * 5)


def test_large_rates(spark):
    df = spark.createDataFrame([(str(r), r) for r in (0.0, 0.3, 50.0, 2000.0)], ["_source", "_rate"])
    terms = defaultdict(list)
    for x in mixing.poisson_terms(df).orderBy("k").collect():
        terms[x._source].append(x.c)
    for r, cdf in ((float(s), c) for s, c in terms.items()):
        assert cdf == sorted(cdf) and abs(cdf[-1] - 1) < 1e-9
        assert abs(sum(1 - c for c in cdf) - r) < 1e-6 * max(1, r)
    us = [i / 97 for i in range(97)]
    asked = spark.createDataFrame([(u,) for u in us], ["u"]).crossJoin(mixing.poisson_cdf(df)).select("_source", "u", mixing.draw(F.col("u")).alias("n")).collect()
    assert all(x.n == sum(c <= x.u for c in terms[x._source]) for x in asked)


def test_rate_of_100_000(spark):
    """Few rows that are repeated very often: time grows with the rate, not with its square."""
    docs = spark.createDataFrame([(i, "s") for i in range(3)], "doc_id long, source string")
    began = time.perf_counter()
    got = mixing.mix_sources(docs, total=300_000.0).groupBy("doc_id").count().collect()
    assert time.perf_counter() - began < 60
    assert all(abs(r["count"] - 100_000) < 6 * math.sqrt(100_000) for r in got) and len({r["count"] for r in got}) > 1


def test_positions(odd):
    mixed = mixing.positions(mixing.mix_sources(odd).select("doc_id", "copy", "shuffle_key")).collect()
    assert sorted(r.position for r in mixed) == list(range(len(mixed)))
    keys = [r.shuffle_key for r in sorted(mixed, key=lambda r: r.position)]
    assert keys == sorted(keys)


def drop_lines(rows, share, least):
    pages, on = Counter(r[3] or "" for r in rows), defaultdict(set)
    for i, r in enumerate(rows):
        for line in (r[1] or "").split("\n") if r[1] is not None else []:
            if line.strip(" \t\r"):
                on[r[3] or "", line].add(i)
    bad = {k for k, v in on.items() if len(v) >= least and len(v) > share * pages[k[0]]}
    out = []
    for r in rows:
        lines = r[1].split("\n") if r[1] is not None else []
        kept = [x for x in lines if (r[3] or "", x) not in bad]
        out.append((r[0], "\n".join(kept) if r[1] is not None else None, len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share, least", [(0.02, 2), (0.1, 5), (0.0, 1), (1.0, 1)])
def test_line_dedup(odd, odd_rows, clashing, none, sorted_rows, share, least):
    got = linededup.drop_boilerplate(odd, max_share=share, min_pages=least)
    assert sorted_rows(got, "doc_id", "text", "n_lines", "n_dropped") == drop_lines(odd_rows, share, least)
    if share == 0.1:
        other = linededup.drop_boilerplate(clashing, max_share=share, min_pages=least)
        assert set(clashing.columns) <= set(other.columns) and other.where("_site = 'other' and _bad = 'other' and kept = 'other'").count() == len(odd_rows)
        assert sorted_rows(other, "doc_id", "text", "n_lines", "n_dropped") == drop_lines(odd_rows, share, least)
        assert linededup.drop_boilerplate(none).count() == 0


def test_many_boilerplate_lines(odd, sorted_rows, monkeypatch):
    """Beyond the broadcast limit the rows are the same."""
    want = sorted_rows(linededup.drop_boilerplate(odd, max_share=0.0, min_pages=1), "doc_id", "text")
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 0)
    assert sorted_rows(linededup.drop_boilerplate(odd, max_share=0.0, min_pages=1), "doc_id", "text") == want


def test_hosts(spark, sf_dir, sorted_rows):
    """Pages by the hosts of their addresses; addresses without one are a site of their own."""
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html", "url").collect()]
    pages += [(-1, "a\nb", "no address"), (-2, "a\nb", None), (-3, "a\nc", "HTTP://Example.ORG:80/x?y=http://other.org"), (-4, "a\nc", "https://example.org")]
    df = spark.createDataFrame(pages, "page_id long, html string, url string")
    host = lambda url: (m := re.match(r"[A-Za-z]+://([^/:?#]+)", url or "")) and m[1].lower()
    got = sorted_rows(linededup.drop_boilerplate(df, linededup.host("url"), "html", 0.1, 2), "page_id", "html", "n_lines", "n_dropped")
    assert got == drop_lines([(i, t, None, host(u)) for i, t, u in pages], 0.1, 2)
    assert any(r[3] for r in got)


def test_many_lines(spark):
    """Look-ups do not take longer on a site of many boilerplate lines."""
    text = "\n".join(f"line {i}" for i in range(4000))
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(text).alias("text"))
    began = time.perf_counter()
    assert {tuple(r) for r in linededup.drop_boilerplate(df).select("text", "n_lines", "n_dropped").collect()} == {("", 4000, 4000)}
    assert time.perf_counter() - began < 60


def winner(key, weights):
    return min((-math.log(uniform(f"{key}:{i}")) / w, i) for i, w in enumerate(weights))[1]


def test_sharding(odd, odd_rows, clashing, none):
    weights = [1.0, 2.0, 0.5, 1.0]
    for df in (odd, clashing):
        rows = sharding.number_slots(sharding.assign_shards(df, "doc_id", weights, grow_by=1.0).drop("text"), "doc_id").collect()
        assert len(rows) == len(odd_rows)
        assert df is odd or all(r._order == r._range == r._start == r._scores == "other" for r in rows)
        slots = defaultdict(list)
        for r in rows:
            key = "" if r.doc_id is None else r.doc_id
            assert r.shard == winner(key, weights)
            assert r.grown_shard == winner(key, [*weights, 1.0]) and r.grown_shard in (r.shard, 4)
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.number_slots(sharding.assign_shards(none, "doc_id", weights).drop("text"), "doc_id").count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(odd, "doc_id", [1.0, 0.0])


def test_shards_follow_weights(spark):
    df = spark.range(20_000).withColumn("text", F.lit(None).cast("string"))
    got = {r.shard: r["count"] for r in sharding.assign_shards(df, "id", [1.0, 2.0, 5.0]).groupBy("shard").count().collect()}
    assert all(abs(got[i] - 2500 * w) < 5 * math.sqrt(2500 * w) for i, w in enumerate((1, 2, 5)))
