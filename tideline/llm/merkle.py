"""A Merkle manifest of a dataset: a digest of every row, of every group and of the whole, with proofs.

Leaves are numbered in order, dealt into blocks of fixed size, and each block's
array is collapsed level by level with higher-order functions. Blocks' roots are
the leaves of the next round, so a group of any size takes a few rounds, and no
task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import discard, in_order, join_written, materialise, row_count

FANOUT, LEVELS = 8, 3
#: Nodes of one block: its array of digests has some 32 KB.
BLOCK = FANOUT**LEVELS
#: Rows of paths (some 4 KB each) that may be broadcast.
BROADCAST_PATHS = 4_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def leaf_digest(columns: Sequence[str | Column]) -> Column:
    """Lowercase hex sha256 of the columns' values: each ``-`` if null, else UTF-8 byte count, ``:``, value."""
    parts = []
    for c in columns:
        value = (F.col(f"`{c}`") if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(p["before"], node, p["after"]), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings of a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def _above(nodes: Column) -> Column:
    """The next level: the digest of every FANOUT consecutive nodes, the last ones fewer."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), ""), 256))


def _collapse(nodes: DataFrame, name: str) -> DataFrame:
    """(g, pos, n, node, item) -> a written row for each block: (g, block, n, items, levels, node).

    n is how many nodes g has. A block of several collapses by all LEVELS, whatever
    it holds; a group's only block until one node is left.
    """
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    dealt = nodes.groupBy("g", block.alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "node", "item"))).alias("rows"))
    height = sum((F.when((F.col("n") > BLOCK) | (F.size("rows") > FANOUT**k), 1).otherwise(0) for k in range(LEVELS)), F.lit(0))
    first = F.array(F.transform("rows", lambda r: r["node"])).cast("array<array<string>>")
    steps = F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), height)
    levels = F.aggregate(steps, first, lambda done, _: F.concat(done, F.array(_above(F.element_at(done, -1)))))
    out = dealt.select("g", "block", "n", F.transform("rows", lambda r: r["item"]).alias("items"), levels.alias("levels"))
    return materialise(out.withColumn("node", F.element_at(F.element_at("levels", -1), 1)), name)


def _climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The blocks of every round. A round's nodes are the roots of the one before, of groups that had more than one block."""
    rounds = [_collapse(nodes, name)]
    none = F.lit(None).cast(nodes.schema["item"].dataType)
    while True:
        more = rounds[-1].where(F.col("n") > BLOCK)
        if not more.limit(1).count():
            return rounds
        rounds.append(_collapse(more.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), "node", none.alias("item")), name))


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """(g, node): the one node that is left of each group."""
    out = None
    for r in rounds:
        done = r.where(F.col("n") <= BLOCK).select("g", "node")
        out = done if out is None else out.union(done)
    return out


def _descend(rounds: list[DataFrame], tops: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every leaf's (g, leaf, item, subroot, root, path), and the tables it reads.

    tops: (g, subroot, root, path), what lies above each group's root. From the last
    round to the first a block's path is joined to the block, and its nodes' own
    paths are put before it.
    """
    used, lower = [], None
    powers = F.array(*[F.lit(FANOUT**k) for k in range(LEVELS)])
    for r in reversed(rounds):
        above = tops.withColumns({"block": F.lit(0).cast("long"), "whole": F.lit(True)})
        if lower is not None:
            above = above.unionByName(lower.select("g", F.col("pos").alias("block"), "subroot", "root", "path", F.lit(False).alias("whole")))
        above = materialise(above, "merkle-paths")
        used.append(above)
        met = join_written(r.drop("node").withColumn("whole", F.col("n") <= BLOCK), above, ["g", "block", "whole"], "inner", BROADCAST_PATHS)
        rows = met.select("g", "block", "subroot", "root", "path", "levels", F.posexplode("items").alias("i", "item"))

        def step(k: Column) -> Column:
            at = F.floor(F.col("i") / F.element_at(powers, k + 1)).cast("int")
            run = F.slice(F.element_at("levels", k + 1), F.floor(at / FANOUT).cast("int") * FANOUT + 1, FANOUT)
            place = at % FANOUT
            return F.struct(F.array_join(F.slice(run, F.lit(1), place), "").alias("before"), F.array_join(F.slice(run, place + 2, FANOUT), "").alias("after"))

        own = F.transform(F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), F.size("levels") - 1), step)
        pos = (F.col("block") * BLOCK + F.col("i")).alias("pos")
        lower = rows.select("g", pos, F.element_at(F.element_at("levels", 1), F.col("i") + 1).alias("leaf"), "item", "subroot", "root", F.concat(own.cast(PATH), F.col("path")).alias("path"))
    return lower.drop("pos"), used


def manifest(rows: DataFrame, leaf: Column, group: str = "lang", key: str = "doc_id", carry: Sequence[Column] = ()) -> DataFrame:
    """For every row: key, ``leaf``, ``carry``, ``subroot`` (its group's), ``root`` and ``path`` (siblings, from the leaf to the root).

    In a group leaves ascend by key (null first; equal keys by leaf); while there
    are several nodes, every FANOUT consecutive ones become the sha256 of their hex
    texts. Groups' subroots, ordered by group (null first, by bytes), give the root
    in the same way. path: (before, after) of each level, the siblings' texts on
    either side, see fold_path(). A group is told by its text. Repeated rows are
    leaves of their own. The result is lazy and reads written tables. An empty
    table gives an empty result.
    """
    g = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    item = F.struct(F.col(f"`{key}`").alias("key"), *[c.alias(f"c{i}") for i, c in enumerate(carry)])
    leaves = in_order(rows.select(g.alias("g"), F.col(f"`{key}`").alias("key"), leaf.alias("node"), item.alias("item")), ["g", "key", "node"], "leaves")
    groups = materialise(leaves.groupBy("g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    numbered = join_written(leaves, groups, ["g"]).select("g", (F.col("at") - F.col("first")).alias("pos"), "n", "node", "item")
    rounds = _climb(numbered, "merkle")
    discard(leaves, groups)
    tops = in_order(_roots(rounds), ["g"], "subroots")
    n = F.lit(row_count(tops)).cast("long")
    top_rounds = _climb(tops.select(F.lit("").alias("g"), F.col("at").alias("pos"), n.alias("n"), "node", F.struct("g").alias("item")), "merkle-top")
    discard(tops)
    root = _roots(top_rounds).select("g", F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"), F.array().cast(PATH).alias("path"))
    above, used = _descend(top_rounds, root)
    tops = materialise(above.select(F.col("item.g").alias("g"), F.col("leaf").alias("subroot"), "root", "path"), "merkle-groups")
    discard(*used, *top_rounds)
    out, _ = _descend(rounds, tops)
    return out.select(F.col("item.key").alias(key), "leaf", *[F.col(f"item.c{i}") for i in range(len(carry))], "subroot", "root", "path")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = leaf_digest(COLUMNS)
    changed = leaf_digest([*COLUMNS[:-1], F.translate("text", UPPER, LOWER)])
    picked = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = manifest(docs, plain, "lang", "doc_id", [F.when(picked, changed)])
    folded = fold_path(F.coalesce("c0", "leaf"), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(depth: int = 7, top: int = 2) -> str:
    """The same by joins, for up to 8^depth rows a group and 8^top groups."""

    def tree(t: str, levels: int) -> str:
        """t0 has (g, pos, n, node); of each level the runs' digests, and of each node what stands beside it."""
        out = ""
        for k in range(levels):
            out += f""", {t}{k + 1} AS (SELECT g, pos // 8 AS pos, any_value((n + 7) // 8) AS n, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM {t}{k} WHERE n > 1 GROUP BY g, pos // 8)
, {t}s{k} AS (SELECT g, pos, coalesce(string_agg(node, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
    coalesce(string_agg(node, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {t}{k} WHERE n > 1)"""
        return out + f", {t}root AS ({' UNION ALL '.join(f'SELECT g, node FROM {t}{k} WHERE n = 1' for k in range(levels + 1))})"

    def steps(src: str, t: str, levels: int, g: str, pos: str) -> tuple[str, str]:
        """A chain of queries, one for each level: the digest folded and the siblings gathered so far."""
        out = ""
        for k in range(levels):
            out += f""", {t}f{k + 1} AS (SELECT c.* EXCLUDE (f, sib), CASE WHEN s.pos IS NULL THEN f ELSE sha256(s.b || f || s.a) END AS f, sib || coalesce(s.b || s.a, '') AS sib
  FROM {src} c LEFT JOIN {t}s{k} s ON s.g = {g} AND s.pos = {pos} // {8**k})"""
            src = f"{t}f{k + 1}"
        return out, src

    def digest(text: str) -> str:
        cols = [*(f"{c}::VARCHAR" for c in COLUMNS[:-1]), text]
        return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in cols) + ")"

    low, last = steps("start", "l", depth, "c.g", "c.pos")
    high, end = steps("mid", "t", top, "''", "c.gpos")
    return f"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(i))
), d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {digest("text")} AS leaf, {digest(f"translate(text, '{UPPER}', '{LOWER}')")} AS changed,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) % 3 = 0 AS picked
  FROM documents, crc_table
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d
), l0 AS (SELECT g, pos, n, leaf AS node FROM leaves)
{tree("l", depth)}
, t0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, node, g AS name FROM lroot)
{tree("t", top)}
, start AS (SELECT doc_id, g, pos, leaf, CASE WHEN picked THEN changed ELSE leaf END AS f, '' AS sib FROM leaves)
{low}
, mid AS (SELECT c.*, t0.pos AS gpos, t0.node AS subroot FROM {last} c JOIN t0 ON t0.name = c.g)
{high}
SELECT doc_id, leaf, subroot, r.node AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = r.node AS verified FROM {end}, troot r
"""


ORACLE = _oracle()
