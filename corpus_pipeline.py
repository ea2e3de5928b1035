"""Corpus preparation over ``documents``: reject low quality, keep one of near duplicates, remove repeated passages, redact secrets, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Stages are
written as Parquet and read again between each other. Null texts, null ids, empty tables and further columns are handled as the
docstrings of the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, packing, quality, secrets, substrings
from tidemark.llm.common import Tables
from tidemark.llm.queries import table, tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled training rows of ``docs``, does not reject."""
    return quality.classify(docs, table(spark, sf_dir, "labels"), carry=True).where("predicted = 1").select("row.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents whose word shingles have a Jaccard similarity of 0.75 or more."""
    return jaccard.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 100-byte strings that start earlier in the corpus; documents stay, even if little is left of them."""
    return substrings.strip(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret found replaced by a mark."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality classifier", good_quality), ("n-gram Jaccard join", one_of_near_duplicates), ("suffix-array dedup", without_repeats), ("secret scans", without_secrets), ("best-fit packing", packed)]
#: SQL expresses neither trained models nor the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = tables.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            tables.drop(f"stage{k - 1}")
        tables.release()
    return STAGES[-1][1](spark, docs, sf_dir)
