"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each document is repeated a Poisson number of times whose mean is its source's
target rate, so expected totals meet the weights and every document is drawn
independently of all others. The draw inverts the distribution at a uniform
number that is hashed from the seed and the document's key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import in_order, materialise

SEED = 20
#: Weights that are not given: a source's share of the documents to this power.
ALPHA = 0.5
#: Terms of all sources' distributions up to which they are broadcast: 8 bytes each, and 100 terms for a source's name.
BROADCAST_TERMS = 2_000_000
#: Terms in a block.
BLOCK = 256


def uniform(name: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of md5(seed:name)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), name)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def poisson_terms(rates: DataFrame) -> DataFrame:
    """(_source, k, c): c = P(X <= k), k = 0, 1, ... up to where less than the finest uniform number is left.

    One row for each term, summed by a window of each source: time grows with the
    rates themselves. Logarithms are summed first, so a large rate does not underflow.
    """
    last = F.ceil(F.col("_rate") + 12 * F.sqrt("_rate") + 40).cast("int")
    terms = rates.select("_source", "_rate", F.explode(F.sequence(F.lit(0), F.when(F.col("_rate") > 0, last).otherwise(0))).alias("k"))
    upto = Window.partitionBy("_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log = F.sum(F.when(F.col("k") > 0, F.log(F.col("_rate") / F.col("k"))).otherwise(0.0)).over(upto)
    p = F.when(F.col("_rate") > 0, F.exp(log - F.col("_rate"))).otherwise(1.0)
    return terms.withColumn("p", p).select("_source", "k", F.sum("p").over(upto).alias("c"))


def poisson_cdf(rates: DataFrame) -> DataFrame:
    """(_source, _cdf): the terms of each source in blocks of BLOCK, each with the last term of the block.

    A draw looks for its block, then inside of it, so it touches some square root of the terms.
    """
    blocks = poisson_terms(rates).groupBy("_source", F.floor(F.col("k") / BLOCK).alias("_i")).agg(F.sort_array(F.collect_list("c")).alias("cs"))
    blocks = blocks.groupBy("_source").agg(F.sort_array(F.collect_list(F.struct("_i", "cs"))).alias("_b"))
    return blocks.select("_source", F.col("_b.cs").alias("_cdf"), F.transform("_b.cs", lambda c: F.element_at(c, -1)).alias("_last"))


def draw(u: Column) -> Column:
    """The number of terms of _cdf that are u or less: the least k with P(X <= k) > u."""
    full = F.size(F.filter("_last", lambda c: c <= u))
    return (full * BLOCK + F.coalesce(F.size(F.filter(F.get("_cdf", full), lambda c: c <= u)), F.lit(0))).cast("int")


def source_rates(docs: DataFrame, source: str = "source", weights: Mapping[str, float] | None = None, total: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """(_source, _rate): mean copies per document, weight * total / documents of the source.

    weights: relative, by source; sources that are not named get none. Without
    weights, a source weighs its number of documents to the power ``alpha``.
    total: expected documents in the mix, by default as many as there are.
    """
    counts = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    counts = materialise(counts, "sources")
    if weights is None:
        weight = F.pow("_n", F.lit(float(alpha)))
    else:
        if any(not w >= 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.col("_source")), F.lit(0.0))
    counts = counts.withColumn("_w", weight)
    # sums over sources in a fixed order, so that rates are the same on every run
    sums = counts.agg(F.aggregate(F.array_sort(F.collect_list("_w")), F.lit(0.0), lambda a, x: a + x).alias("_all"), F.sum("_n").alias("_docs")).first()
    mass, n = sums["_all"] or 0.0, total if total is not None else (sums["_docs"] or 0.0)
    rate = F.col("_w") / F.lit(float(mass)) * F.lit(float(n)) / F.col("_n") if mass > 0 else F.lit(0.0)
    return counts.select("_source", rate.alias("_rate"))


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: Mapping[str, float] | None = None, total: float | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` as often as its draw says, in globally shuffled order.

    Adds copy (from 0), n_copies and shuffle_key; the table is dealt into
    partitions by shuffle_key and sorted by it inside each. A draw depends on
    seed and key alone: rows with equal keys get equal counts, null keys count as
    the empty string. A null source is the source named by the empty string.
    Texts are carried whatever they hold, null too. All columns stay, but columns
    of the three added names are replaced. Rows that share a key and copy share a
    shuffle_key, but are dealt out by a hash of all their columns too, as far as
    these can be hashed. An empty table, or weights that are all zero, give an
    empty result.
    """
    rates = materialise(poisson_cdf(source_rates(docs, source, weights, total, alpha)), "rates")
    terms = rates.agg(F.sum(F.aggregate("_cdf", F.lit(0), lambda n, c: n + F.size(c))).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    few = (terms["n"] or 0) + 100 * terms["rows"] <= BROADCAST_TERMS
    kept = [c for c in docs.columns if c not in ("copy", "n_copies", "shuffle_key")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_name"),
    )
    drawn = rows.join(F.broadcast(rates) if few else rates.hint("merge"), "_source").select("_doc", "_name", draw(uniform(F.col("_name"), seed)).alias("n_copies")).where("n_copies > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}s"), "_name", F.col("copy").cast("string"))))
    hashed = [F.col(f"_doc.`{f.name}`") for f in docs.schema if f.name in kept and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    dealt = copies.repartition(F.col("shuffle_key"), F.xxhash64(*hashed)) if hashed else copies.repartition(F.col("shuffle_key"))
    return dealt.sortWithinPartitions("shuffle_key").select("_doc.*", "n_copies", "copy", "shuffle_key")


def positions(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds position, gapless from 0, in the order of shuffle_key, key and copy; give it narrow rows."""
    doc = F.struct(*[F.col(f"`{c}`") for c in mixed.columns if c != "position"])
    rows = mixed.select(doc.alias("doc"), "shuffle_key", F.col(key).alias("key"), "copy")
    return in_order(rows, ["shuffle_key", "key", "copy"], "mixed").select("doc.*", F.col("at").alias("position"))


def op4_poisson_mixing(spark, sf_dir: str) -> DataFrame:
    """Which copies of which documents are in the mix, in which place; texts are mixed by mix_sources itself."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix_sources(docs).select("doc_id", "source", "copy", "n_copies", "shuffle_key", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return positions(mixed).drop("shuffle_key")


def oracle(source: str = "documents") -> str:
    """DuckDB SQL for the rows of mix_sources over ``source``."""
    hashed = "(('0x' || substr(md5(concat('{seed}:', coalesce(doc_id::VARCHAR, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"
    return f"""
mix_n AS (
  SELECT coalesce(source, '') AS s, count(*)::DOUBLE AS n FROM {source} GROUP BY 1
), mix_w AS (
  SELECT s, n, pow(n, {ALPHA}::DOUBLE) AS w FROM mix_n
), mix_rate AS (
  SELECT s, w / (SELECT list_reduce(list_sort(list(w)), lambda a, x: a + x) FROM mix_w) * (SELECT sum(n) FROM mix_w) / n AS r FROM mix_w
), mix_terms AS (
  SELECT s, k, exp(-r + coalesce(sum(ln(r / nullif(k, 0))) OVER (PARTITION BY s ORDER BY k), 0)) AS p
  FROM (SELECT s, r, unnest(range(0, ceil(r + 12 * sqrt(r) + 40)::BIGINT + 1)) AS k FROM mix_rate)
), mix_cdf AS (
  SELECT s, list(c ORDER BY k) AS cdf FROM (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM mix_terms) GROUP BY s
), mix_drawn AS (
  SELECT d.*, len(list_filter(c.cdf, lambda x: x <= {hashed.format(seed=SEED)})) AS n_copies
  FROM {source} d JOIN mix_cdf c ON coalesce(d.source, '') = c.s
), mixed AS (
  SELECT *, md5(concat('{SEED}s:', coalesce(doc_id::VARCHAR, ''), ':', copy)) AS shuffle_key
  FROM (SELECT *, unnest(range(n_copies)) AS copy FROM mix_drawn)
)"""


ORACLE = f"""WITH {oracle()}
SELECT doc_id, source, copy::INTEGER AS copy, n_copies::INTEGER AS n_copies, md5(text) AS text_md5,
  row_number() OVER (ORDER BY shuffle_key, doc_id, copy) - 1 AS position
FROM mixed"""
