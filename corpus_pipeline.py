"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns of documents. ``run`` writes each stage's rows as Parquet below the
shared folder and reads them back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loanpanel.llm import line_dedup, minhash_dedup, mixing, packing, quality
from loanpanel.llm.storage import read, shared_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fertility bands reject go."""
    return quality.passing(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or nearly equal to an earlier one go, and documents that have no word left."""
    return line_dedup.documents_left(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays."""
    return minhash_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as the source targets want."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset."""
    return packing.pack_documents(docs, with_ids=False)


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents),
          ("mixing", mix_sources), ("packing", pack_sequences)]

#: Tokenised and iterative stages have no SQL; tests/llm compares them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return docs
