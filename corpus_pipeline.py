"""A corpus in five stages, each by one operator: quality rules, near-duplicates, personal data, mixing, packing.

Defined results of all stages: columns of documents in other orders and further columns pass, up to packing, which has
its own. Null and empty texts fail the rules; rows that repeat an id with another text are documents of their own, rows that
repeat both are one from the second stage on; texts of any length are read whole; ties go to the smaller id; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm import mixing, near_dedup, packing, pii, quality_rules
from bitloom.llm.common import remove, settled, table

#: SQL can't express the stages: signatures, trees, BM25 and the tokenizer. tests/llm hold each stage against plain Python.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, a similarity of 0.8 or more."""
    return near_dedup.keep_one(docs, k=5, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("private", private), ("mixture", mixture), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. Every stage's is written and read again, and deleted once the next one is there."""
    given = docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, settled(lambda: stage(spark, docs, sf_dir), name)
        if before is not given:
            remove(before)
    return docs
