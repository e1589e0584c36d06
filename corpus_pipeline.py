"""From raw documents to token ids: classify, deduplicate, cut repeats, mix, encode.

Each stage calls one operator of tidemark.llm on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.minhash import keep_one_of_each
from tidemark.llm.mixing import mix_sources
from tidemark.llm.pieces import encode
from tidemark.llm.quality import fit_quality, keep_good
from tidemark.llm.shared import table, working_tables, written
from tidemark.llm.substrings import keep_first_passages


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of fifty words that an earlier document has; drop texts that lose all."""
    return keep_first_passages(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that all sources weigh alike, and shuffle."""
    return mix_sources(docs).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the next best segmentations."""
    return encode(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix", mix),
    ("sentencepiece", sentencepiece),
]

#: The quality scores are a trained model's: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's rows are written and read again, and what it wrote on its way is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with working_tables(spark) as kept:
            docs = written(stage(spark, docs, sf_dir), name)
            kept.append(docs)
    return docs
