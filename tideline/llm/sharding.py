"""Sharding by rendezvous hashing (DataFrame functions only).

A record's key is hashed together with every shard's number; the shard with the
best weighted score takes the record. Adding a shard only adds one score per
record, so records move only into the new shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import in_order, utf8


def score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of md5(key:shard). The smallest wins."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard)))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**52))) / F.lit(float(weight))


def scores(key: Column, weights: Sequence[float]) -> Column:
    """(score, number) of every shard. The least wins: equal scores go to the smaller number."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a weight above zero")
    return F.array(*[F.struct(score(key, i, w).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights)])


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], text: str = "text", grow_by: float | None = None) -> DataFrame:
    """Adds size, text_crc32 and shard, and grown_shard if ``grow_by`` is given.

    weights: one per shard. grow_by: the weight of one more shard, for the plan
    of a later enlargement. A null key is hashed as the empty string and gets a
    shard like any other, so all rows of one key go to one shard; a null text has
    size 16 and crc 0. All other columns stay, whatever their names, but columns of
    the names added here are replaced. An empty table gives an empty result.
    """
    added = ["size", "text_crc32", "shard", *([] if grow_by is None else ["grown_shard"])]
    body = F.coalesce(utf8(f"`{text}`"), F.lit(b""))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in added]).alias("doc"),
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body).alias("text_crc32"),
        scores(_name(f"`{key}`"), [*weights, *([] if grow_by is None else [grow_by])]).alias("scores"),
    )
    rows = rows.withColumn("shard", F.array_min(F.slice("scores", 1, len(weights)))["i"]).withColumn("grown_shard", F.array_min("scores")["i"])
    return rows.select("doc.*", *added)


def _name(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def number_slots(shards: DataFrame, key: str) -> DataFrame:
    """Adds slot to the result of assign_shards: gapless from 0 in each shard.

    The order is that of md5(key), then key, crc and size; rows equal in all of
    these are interchangeable. Give it the columns that are wanted, not the texts:
    rows are shuffled once.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in shards.columns if c != "slot"])
    rows = shards.select(doc.alias("doc"), "shard", F.md5(_name(f"`{key}`")).alias("hash"), F.col(f"`{key}`").alias("key"), F.col("text_crc32").alias("crc"), "size")
    placed = in_order(rows, ["shard", "hash", "key", "crc", "size"], "shards")
    starts = placed.groupBy("shard").agg(F.min("at").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(starts), "shard").select("doc.*", (F.col("at") - F.col("first")).alias("slot"))


SHARDS = 40


def op8_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shards = assign_shards(docs, "doc_id", [1.0] * SHARDS, grow_by=1.0).drop("text")
    return number_slots(shards, "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


ORACLE = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) t(i))
), d AS (
  SELECT doc_id, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS h FROM documents
), bytes AS (
  SELECT doc_id, body, strlen(body)::BIGINT + 16 AS size,
    list_transform(range(1, strlen(h), 2), lambda p: ('0x' || substr(h, p, 2))::BIGINT) AS b FROM d
), crcs AS (
  SELECT doc_id, size,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b),
      lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) AS text_crc32
  FROM bytes, crc_table
), scored AS (
  SELECT doc_id, size, text_crc32, md5(coalesce(doc_id::VARCHAR, '')) AS o,
    list_transform(range({SHARDS + 1}), lambda i: -ln((('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), ':', i)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)) AS s
  FROM crcs
), placed AS (
  SELECT *, list_position(s[1:{SHARDS}], list_min(s[1:{SHARDS}])) - 1 AS shard, list_position(s, list_min(s)) - 1 AS grown FROM scored
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY o, doc_id, text_crc32, size) - 1 AS slot, grown::INTEGER AS grown_shard
FROM placed
"""
