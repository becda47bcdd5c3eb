"""Cleans and packs the documents: quality rules, exact and near duplicates, secrets, packing.

Each stage takes all that the one before it kept. Between stages the documents
are written as Parquet into the folder that the cluster shares, so a lost
executor costs the work of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from supplypanel.llm import exact_dedup, ngram_join, packing, quality_rules, secret_scan
from supplypanel.llm.common import new_folder, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality_rules.quality_rules(docs, read(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each text."""
    return exact_dedup.without_duplicates(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return ngram_join.without_near_duplicates(docs).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret replaced by a mark."""
    return secret_scan.redacted(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.packed_lengths(docs)


STAGES = [
    ("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("secret scans", secrets),
    ("best-fit packing", packed),
]

#: SQL lacks the hash of the log ratios and the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(folder := new_folder(spark, "stage"))
            docs = spark.read.parquet(folder)
    return docs
