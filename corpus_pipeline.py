"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's docs.

Quality rules, line dedup, near-dedup, mixing to target weights, packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import jaccard, linededup, mixing, packing, quality
from tideline.llm.common import discard, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits and the learned decision list keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.filter_documents(docs.select(COLUMNS), labels)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their sites' boilerplate lines; n_chars follows the text."""
    return linededup.drop_boilerplate(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word Jaccard similarity 0.8 or more: the one of the smallest doc_id.

    SimHash tries over the same shingles, each link checked; a prefix filter finds what lies beyond their bits.
    """
    return jaccard.keep_one(docs.select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards their sources' target weights, in shuffled order."""
    return mixing.mix_sources(docs.select(COLUMNS)).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens; a repeated document is packed each time."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: Learned rules, near copies and tokens are no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences' pieces. A stage's table is deleted when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
