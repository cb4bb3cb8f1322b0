"""Line dedup by site-relative frequency.

A line is boilerplate on a site when it stands on more than a given share of the
site's pages. The share is taken per site, so a phrase that is common on one site
stays where it is rare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import discard, join_written, materialise

#: A line goes when it is on more than this share of its site's pages ...
MAX_SHARE = 0.02
#: ... and on this many pages of the site at least.
MIN_PAGES = 5
#: Boilerplate lines up to which they are broadcast: 50 bytes each, 10 MB.
BROADCAST_LINES = 200_000


def lines(text: str) -> Column:
    """The lines of a text, cut at each line feed; null has none."""
    return F.coalesce(F.split(F.col(text), "\n"), F.array().cast("array<string>"))


def digest(line: Column) -> Column:
    """16 bytes that stand for a line; null for a blank line, which is never boilerplate."""
    return F.when(F.trim(line, F.lit(" \t\r")) != "", F.unhex(F.md5(line.cast("binary"))))


def host(url: str | Column) -> Column:
    """The host of an address, in small letters; null for what has none."""
    return F.lower(F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("HOST")))


def _site(site: str | Column) -> Column:
    return F.coalesce((F.col(f"`{site}`") if isinstance(site, str) else site).cast("string"), F.lit(""))


def boilerplate(docs: DataFrame, site: str | Column = "source", text: str = "text", max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, n, bad): the boilerplate lines of each site that has any, n in number, by digest in a table of n places.

    A page's repeats of a line count once: digests are made distinct inside the
    row, so counting is one aggregation with partial sums and nothing is grouped
    by page. A site has at most (mean lines per page / max_share) such lines. A
    digest is in the list at its hash modulo n, so a look-up takes the same time
    however many lines a site has. The table is written.
    """
    seen = docs.select(_site(site).alias("site"), F.array_distinct(F.transform(lines(f"`{text}`"), digest)).alias("d"))
    totals = seen.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    counts = seen.select("site", F.explode("d").alias("line")).where("line is not null").groupBy("site", "line").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.where(F.col("n") >= min_pages), "lines")
    totals = materialise(totals, "sites")
    frequent = materialise(join_written(counts, totals, ["site"]).where(F.col("n") > max_share * F.col("pages")).select("site", "line"), "frequent")
    sizes = materialise(frequent.groupBy("site").agg(F.count(F.lit(1)).cast("int").alias("n")), "sizes")
    lists = join_written(frequent, sizes, ["site"]).groupBy("site", _place(F.col("line"), F.col("n")).alias("place")).agg(F.collect_list("line").alias("lines"))
    places = sizes.select("site", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place")).join(lists, ["site", "place"], "left")
    places = places.select("site", F.struct("place", F.coalesce("lines", F.array().cast("array<binary>")).alias("lines")).alias("x"))
    out = materialise(places.groupBy("site").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sort_array(F.collect_list("x"))["lines"].alias("bad")), "boilerplate")
    discard(counts, totals, frequent, sizes)
    return out


def _place(line: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(line), n).cast("int")


def drop_boilerplate(docs: DataFrame, site: str | Column = "source", text: str = "text", max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and n_lines and n_dropped added.

    site: a column, or an expression such as host("url"). A line goes if, on its
    site, it stands on more than ``max_share`` of the pages and on ``min_pages``
    pages or more; lines are compared byte by byte (by their 16-byte digests), blank
    lines always stay. The kept lines are joined by line feeds again. A null text
    stays null with no lines; an empty one has one empty line; null sites count as
    one site named by the empty string; every row is a page, repeated rows too. All
    other columns stay, whatever their names, but columns of the two added names
    are replaced. An empty table gives an empty result.
    """
    bad = boilerplate(docs, site, text, max_share, min_pages)
    n = bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), _site(site).alias("site"), F.col(f"`{text}`").alias("text"))
    joined = rows.join(F.broadcast(bad) if n <= BROADCAST_LINES else bad.hint("merge"), "site", "left")
    own = lines("text")
    marked = F.transform(own, lambda x: F.struct(x.alias("x"), digest(x).alias("d")))
    good = F.filter(marked, lambda m: ~F.coalesce(F.array_contains(F.get("bad", _place(m["d"], F.col("n"))), m["d"]), F.lit(False)))["x"]
    joined = joined.withColumn("kept", F.when(F.col("bad").isNull(), own).otherwise(good))
    kept_text = F.when(F.col("text").isNotNull(), F.array_join("kept", "\n"))
    columns = [kept_text.alias(c) if c == text else F.col(f"doc.`{c}`") for c in names]
    return joined.select(*columns, F.size(own).cast("long").alias("n_lines"), (F.size(own) - F.size("kept")).cast("long").alias("n_dropped"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "source", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def oracle(source: str = "documents") -> str:
    """DuckDB SQL for the rows of drop_boilerplate over ``source``, its kept text as ``kept``."""
    return f"""
pages AS (
  SELECT *, row_number() OVER () AS page, coalesce(source, '') AS site FROM {source}
), page_lines AS (
  SELECT page, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM pages
), frequent AS (
  SELECT l.site, l.line FROM (SELECT site, line, count(DISTINCT page) AS n FROM page_lines WHERE trim(line, chr(32) || chr(9) || chr(13)) <> '' GROUP BY site, line) l
  JOIN (SELECT site, count(*) AS n FROM pages GROUP BY site) s ON l.site = s.site
  WHERE l.n >= {MIN_PAGES} AND l.n > {MAX_SHARE} * s.n
), judged AS (
  SELECT p.page, p.pos, p.line, f.line IS NOT NULL AS bad FROM page_lines p LEFT JOIN frequent f ON p.site = f.site AND p.line = f.line
), rebuilt AS (
  SELECT page, count(*) AS n_lines, count(*) FILTER (bad) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS kept
  FROM judged GROUP BY page
), line_dedup AS (
  SELECT p.*, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_dropped, 0) AS n_dropped, r.kept FROM pages p LEFT JOIN rebuilt r ON p.page = r.page
)"""


ORACLE = f"WITH {oracle()} SELECT doc_id, source, n_lines, n_dropped, md5(kept) AS kept_md5 FROM line_dedup"
