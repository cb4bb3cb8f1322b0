"""Manifests against a plain tree."""

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tideline.llm import merkle


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, change=False):
    out = ""
    for c in merkle.COLUMNS:
        v = r[c]
        if c == "text" and change and v is not None:
            v = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in v)
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(out)


def tree(nodes):
    """The root, and of each leaf (before, after) level by level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for x, i in enumerate(where):
            at = i // 8 * 8
            paths[x].append(("".join(nodes[at:i]), "".join(nodes[i + 1 : at + 8])))
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        where = [i // 8 for i in where]
    return nodes[0], paths


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault("" if r["lang"] is None else "=" + r["lang"], []).append(r)
    made = {}
    for g, rs in groups.items():
        rs.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        made[g] = (rs, *tree([leaf(r) for r in rs]))
    names = sorted(made, key=lambda g: g.encode())
    root, above = tree([made[g][1] for g in names]) if names else (None, [])
    out = []
    for g, up in zip(names, above):
        rs, sub, paths = made[g]
        for r, path in zip(rs, paths):
            path = [*path, *up]
            key = r["doc_id"]
            node = leaf(r, key is not None and crc32(str(key).encode()) % 3 == 0)
            for a, b in path:
                node = H(a, node, b)
            out.append((key, leaf(r), sub, root, H(*(a + b for a, b in path)), node))
    return sorted(out, key=repr)


def ours(docs, spark, tmp_path):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    rows = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in rows)
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in rows), key=repr)


def test_odd_rows(spark, odd, tmp_path):
    assert ours(odd, spark, tmp_path) == plain(odd.collect())


def test_other_columns(odd, clashing, sorted_rows):
    names = ["g", "pos", "n", "node", "item", "leaf", "path", "root", "subroot", "at", "block", "levels", "items", "whole", "i", "first"]
    more = clashing.withColumns({c: F.lit("x") for c in names})
    one, two = (merkle.manifest(d, merkle.leaf_digest(merkle.COLUMNS)) for d in (odd, more))
    assert sorted_rows(one, "doc_id", "leaf", "root", "path") == sorted_rows(two, "doc_id", "leaf", "root", "path")


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64, 65, 511, 512, 513, 600])
def test_sizes(spark, tmp_path, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert ours(docs, spark, tmp_path) == plain(docs.collect())


def test_many_rounds(spark, tmp_path, monkeypatch):
    """Blocks of one run, so that 700 rows and 70 groups take several rounds each."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    lang = F.when(F.col("id") < 600, "en").when(F.col("id") % 90 > 0, F.concat(F.lit("l"), F.col("id") % 90))
    docs = spark.range(750).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), lang.alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert ours(docs, spark, tmp_path) == plain(docs.collect())
    monkeypatch.setattr(merkle, "BROADCAST_PATHS", 0)  # as where paths are too many to broadcast
    assert ours(docs, spark, tmp_path) == plain(docs.collect())


def test_proofs_tell_tampering(spark, odd):
    rows = merkle.manifest(odd, merkle.leaf_digest(merkle.COLUMNS))
    path = F.col("path")
    right = rows.select((merkle.fold_path(F.col("leaf"), path) == F.col("root")).alias("ok"), (merkle.fold_path(F.sha2("leaf", 256), path) == F.col("root")).alias("bad")).collect()
    assert all(r["ok"] for r in right) and not any(r["bad"] for r in right)
