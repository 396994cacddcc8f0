"""Corpus pipeline: quality rules, quality classifier, near-dedup, packing.

Each stage reads what the one before it wrote; the first reads ``documents``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdikt.llm import dsir, packing, quality_rules, simhash
from verdikt.llm.common import discard, prepare, saved, table, unpacked


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return unpacked(quality_rules.quality_rules(docs).where("kept"))


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    return unpacked(dsir.importance_resample(docs, table(spark, sf_dir, "labels")).where("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.near_dedup(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a bin for every piece of every document."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_by_rules),
    ("quality classifier", keep_by_classifier),
    ("SimHash near-dedup", drop_near_duplicates),
    ("best-fit packing", pack_documents),
]

# Neither the hashed generative models nor sequential best-fit can be put in
# SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next reads
    it, and deleted once the next is written."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, "stage")
            if i:
                discard(before)
    return docs
