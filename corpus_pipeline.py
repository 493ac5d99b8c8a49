"""Corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, packing.

Each stage takes the documents its predecessor kept and returns the columns of ``documents``; the last
returns packed pieces. Between stages the documents are written and read again, so that a lost executor
costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from ledgerline.llm.common import table
from ledgerline.session import materialize

#: Near duplicates share this much of their shingles of so many words.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without copies and near copies of earlier lines; those left without a line go."""
    return line_dedup.dedup_lines(docs).where(F.col("text").rlike(line_dedup.NOT_BLANK))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs, NEAR_WORDS, NEAR_SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of bounded length."""
    found = packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Edit distances, components and packing are not for SQL; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, "pipeline_stage")
    return docs
