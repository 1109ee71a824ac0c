"""The corpus pipeline: toxicity, quality, line dedup, near-dedup, packing. Each stage reads what the one before has written.

Defined results: a null or empty text isn't toxic, and scores 0 for quality, so the second stage leaves it out; a stage that is given
one on its own keeps it, as a copy of its equals. Rows that repeat a document are one group of the near-dedup: one row stays. Null ids
come last wherever an order decides. Very long texts are read whole. Ties go to the least doc_id, then line. An empty table passes
every stage as an empty table. Columns beside doc_id, text and n_chars pass unread, whatever their names, up to the packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import bag_minhash, fuzzy_lines, packing, quality, toxicity
from skylattice.runtime import prepare, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't call toxic."""
    return toxicity.reject_toxic(docs, table(prepare(spark), sf_dir, "labels"))


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model calls good."""
    return quality.reject_poor(docs, table(prepare(spark), sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line makes needless; n_chars follows the text."""
    prepare(spark)
    made = fuzzy_lines.dedup_lines(docs)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return bag_minhash.dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as pieces of packed sequences."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_poor),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("packing", pack),
]

#: No SQL expresses the learned stages; tests/llm/test_pipeline.py holds the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
