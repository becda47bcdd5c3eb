"""Comparing tables as sets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_difference(left: DataFrame, right: DataFrame, columns) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` lacks (nulls are equal)."""
    return left.select(*columns).subtract(right.select(*columns))


def difference_counts(left: DataFrame, right: DataFrame, columns) -> DataFrame:
    """One row: how many distinct rows only the left, and only the right, has.

    Both directions of ``set_difference`` in one aggregation, so that each
    input is computed once.
    """
    both = (
        left.select(*columns, F.lit(1).alias("_side"))
        .unionByName(right.select(*columns, F.lit(2).alias("_side")))
        .groupBy(*columns)
        .agg(F.min("_side").alias("_first"), F.max("_side").alias("_last"))
    )
    return both.agg(
        F.count_if(F.col("_last") == 1).alias("left_only"),
        F.count_if(F.col("_first") == 2).alias("right_only"),
    )


def jaccard(left: DataFrame, right: DataFrame, columns) -> DataFrame:
    """One row: shared keys over all keys of two sets."""
    both = (
        left.select(*columns, F.lit(1).alias("_left"), F.lit(0).alias("_right"))
        .unionByName(right.select(*columns, F.lit(0).alias("_left"), F.lit(1).alias("_right")))
        .groupBy(*columns)
        .agg(F.max("_left").alias("_left"), F.max("_right").alias("_right"))
    )
    shared = F.count_if((F.col("_left") == 1) & (F.col("_right") == 1))
    return both.agg(
        (shared.cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0)).cast("double")).alias("jaccard")
    )


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Row count and order-free content hash of a table, in one row."""
    row_hash = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("row_count"),
        F.sum(row_hash.cast("decimal(38,0)")).alias("content_hash"),
    )


def compare_fingerprints(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Row per table named in either manifest, and whether the two agree."""
    old = recorded.select(
        "table_name",
        F.col("row_count").alias("recorded_rows"),
        F.col("content_hash").alias("recorded_hash"),
    )
    new = current.select(
        "table_name",
        F.col("row_count").alias("current_rows"),
        F.col("content_hash").alias("current_hash"),
    )
    return old.join(new, "table_name", "full_outer").select(
        "table_name",
        "recorded_rows",
        "current_rows",
        (
            F.col("recorded_rows").eqNullSafe(F.col("current_rows"))
            & F.col("recorded_hash").eqNullSafe(F.col("current_hash"))
        ).alias("matches"),
    )
