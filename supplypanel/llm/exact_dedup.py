"""Exact deduplication: group by a 128-bit hash of the content, compare bytes inside groups, keep the smallest id.

Texts are equal when they are identical after each run of white space became
one space. Defined cases: a null text counts as empty; ids may repeat or be
null; a null id ranks after every other id, and of rows that share id and text
one is kept; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplypanel.llm.common import BLANK, join_groups, kept, retained


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def duplicate_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    The first pass keeps a fingerprint of each row. The second groups by hash
    and text together: equal rows of a task are one row before the shuffle, so
    a text that a third of all rows share stays small, and texts of the same
    hash that differ stay apart. Only where a hash has several texts is the row
    found by its text instead of its hash.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), normalised(F.col(text_column)).alias("_text"))
    prints = kept(texts.select(
        "doc_id", hashed(F.col("_text")).alias("_hash"), F.sha2("_text", 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("_row"),
    ))
    # The row number breaks ties between rows of one id; it comes from the kept fingerprints alone.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("_first")
    variants = texts.groupBy(hashed(F.col("_text")).alias("_hash"), "_text").agg(F.count(F.lit(1)).alias("_n"))
    hashes = kept(variants.groupBy("_hash").agg(
        F.count(F.lit(1)).alias("_texts"), F.sum("_n").alias("group_size"),
    ))
    collided = hashes.where("_texts > 1")
    if collided.isEmpty():
        keys, rows = ["_hash"], prints
    else:  # the sha of the text tells the texts of one hash apart once their bytes were found to differ
        keys, rows = ["_hash", "text_sha256"], prints
    groups = kept(rows.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("group_size")))
    return join_groups(rows, groups, keys, "group_size").select(
        "doc_id", F.col("_first.doc_id").alias("keep_id"), "group_size",
        (F.col("_row") == F.col("_first._row")).alias("kept"), "text_sha256",
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with one row of each text."""
    named = docs.withColumn("text_sha256", F.sha2(normalised(F.col("text")), 256))
    return retained(named, duplicate_groups(docs), ["doc_id", "text_sha256"]).drop("text_sha256")
