"""Gapless numbers along an order, for tables of any size and groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplypanel.llm.common import PART_ROWS, kept

#: Bits of ``monotonically_increasing_id`` that count rows inside a partition.
ROW_BITS = 33


def numbered(rows: DataFrame, order: Sequence[Column | str], groups: Sequence[str] = (), name: str = "position") -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2 … inside each group, along ``order``.

    Rows are dealt to ranges of (groups, order, row), so neither a group nor a
    run of equal rows needs to be in one task. A row's place in its range plus
    the rows of its group in earlier ranges is its number. The table of ranges,
    which is broadcast, has a row for each partition and each group at most.

    ``rows`` must be a checkpoint, as its row numbers break ties; ``groups``
    hold no nulls. Equal rows get their numbers in any order.
    """
    groups = list(groups)
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))
    keys = [*groups, *order, "_row"]
    placed = kept(
        rows.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", ROW_BITS))
    )
    ranges = placed.groupBy("_part", *groups).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(
        "_part", *groups, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(starts), ["_part", *groups]).select(
        *rows.columns, (F.col("_at") + F.col("_shift")).alias(name))
