"""Isotonic regression by pooling in slices, and the monotone map it gives.

Pooling adjacent violators gives the same blocks in whatever order neighbours are
pooled. So each slice of the ordered values is pooled by itself, and then the
stacks of two neighbouring slices together, until no two neighbours violate the
order. A task holds two slices; only a mark of whether a violation is left comes
to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplypanel.operators.order_statistics import slice_count
from supplypanel.sources.tables import settled

BLOCK = "slice long, low double, high double, events long, n long"
#: Blocks of which a map is handed to the tasks as arrays; a larger one is joined along the order.
HELD_BLOCKS = 1 << 16
#: Rows of a range in that join.
RANGE_ROWS = 500_000


def _poolers():
    """What tasks run, as closures, so that workers need no copy of this package: over a slice in order, over two slices."""

    def pooled(rows) -> list[list]:
        """Blocks from rows of slice, low, high, events, n in order: a mean that is not larger than the one before joins it."""
        held: list[list] = []
        for row in rows:
            held.append(list(row))
            while len(held) > 1 and held[-2][3] * held[-1][4] >= held[-1][3] * held[-2][4]:
                last = held.pop()
                held[-1][2] = last[2]
                held[-1][3] += last[3]
                held[-1][4] += last[4]
        return held

    def of_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s, v, v, e, n) for batch in batches for s, v, e, n in zip(*[c.to_pylist() for c in batch.columns]))
        if held := pooled(rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in zip(*held)], names=["slice", "low", "high", "events", "n"])

    def of_pair(blocks: pd.DataFrame) -> pd.DataFrame:
        rows = blocks.sort_values("low")[["slice", "low", "high", "events", "n"]]
        return pd.DataFrame(pooled(rows.astype(object).values.tolist()), columns=rows.columns)

    return of_slice, of_pair


def isotonic_blocks(histogram: DataFrame, slices: int | None = None) -> DataFrame:
    """low, high, events, n of the blocks of the non-decreasing fit, each with mean ``events / n``.

    ``histogram`` has one row for each distinct non-null ``value``, with whole
    numbers ``events`` and ``n``. ``slices`` changes the work of a task, not the result.
    """
    histogram = settled(histogram.select("value", F.col("events").cast("long"), F.col("n").cast("long")))
    slices = slices or slice_count(histogram.count())
    dealt = histogram.repartitionByRange(slices, "value").sortWithinPartitions("value").select(
        F.spark_partition_id().cast("long").alias("slice"), "value", "events", "n")

    of_slice, of_pair = _poolers()
    blocks = settled(dealt.mapInArrow(of_slice, BLOCK))
    turn = 0
    while True:
        # Slices that hold blocks, numbered again without gaps; at most `slices` rows.
        ends = settled(blocks.groupBy("slice").agg(
            F.min_by(F.struct("events", "n"), "low").alias("first"), F.max_by(F.struct("events", "n"), "low").alias("last"),
        ).withColumn("place", F.row_number().over(Window.orderBy("slice"))).withColumn(
            "before", F.lag("last").over(Window.orderBy("slice"))))
        mean_before = F.col("before.events").cast("decimal(38,0)") * F.col("first.n")
        if ends.where(mean_before >= F.col("first.events").cast("decimal(38,0)") * F.col("before.n")).isEmpty():
            return blocks.drop("slice")
        places = ends.select("slice", F.expr(f"(place + {turn % 2}) div 2").alias("pair"))
        blocks = settled(blocks.join(F.broadcast(places), "slice").groupBy("pair").applyInPandas(
            of_pair, BLOCK))
        turn += 1


def points_of(blocks: DataFrame) -> DataFrame:
    """x and mean at both ends of each block; between two blocks the map is a straight line."""
    mean = F.col("events") / F.col("n")
    ends = F.array(F.struct(F.col("low").alias("x"), mean.alias("mean")), F.struct(F.col("high").alias("x"), mean.alias("mean")))
    return blocks.select(F.inline(F.array_distinct(ends)))


def with_mean(rows: DataFrame, value: str, blocks: DataFrame, name: str) -> DataFrame:
    """Adds the isotonic mean of ``value`` as ``name``; beyond the outer blocks it stays level, null stays null."""
    count = blocks.count()
    if count == 0:
        raise ValueError("no blocks to read the map from")
    if count > HELD_BLOCKS:
        return along_order(rows, value, blocks, name)
    points = points_of(blocks).orderBy("x").toPandas()
    x, mean = points["x"].to_numpy(), points["mean"].to_numpy()

    @F.pandas_udf("double")
    def read(values: pd.Series) -> pd.Series:
        found = pd.Series(np.interp(values, x, mean), index=values.index)
        return found.where(values.notna(), None)

    return rows.withColumn(name, read(F.col(value).cast("double")))


def along_order(rows: DataFrame, value: str, blocks: DataFrame, name: str) -> DataFrame:
    """``with_mean`` for a map of any size: rows and points are put in one order, and each row looks to its neighbours.

    Both are dealt to ranges; inside one a window finds the points before and
    after a row, and a table with a line for each range tells what lies beyond it.
    """
    at = F.col(value).cast("double")
    here = rows.select(F.struct(*rows.columns).alias("_row"), at.alias("_x"), F.lit(None).cast("struct<x:double,mean:double>").alias("_point"))
    there = points_of(blocks).select(
        F.lit(None).cast(here.schema["_row"].dataType).alias("_row"), F.col("x").alias("_x"), F.struct("x", "mean").alias("_point"))
    mixed = settled(here.unionByName(there).withColumn("_number", F.monotonically_increasing_id()))
    parts = max(2, -(-mixed.count() // RANGE_ROWS))
    # The number spreads a value that very many rows share over several ranges.
    placed = settled(mixed.repartitionByRange(parts, "_x", "_number").withColumn("_range", F.spark_partition_id()))
    up = Window.partitionBy("_range").orderBy("_x", "_number")
    ranges = placed.groupBy("_range").agg(
        F.min("_point").alias("_low"), F.max("_point").alias("_high"))
    over = Window.orderBy("_range")
    beyond = ranges.select(
        "_range",
        F.last("_high", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_low", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    located = placed.withColumns({
        "_before": F.last("_point", True).over(up.rowsBetween(Window.unboundedPreceding, 0)),
        "_after": F.first("_point", True).over(up.rowsBetween(0, Window.unboundedFollowing)),
    }).where(F.col("_row").isNotNull()).join(F.broadcast(beyond), "_range")
    low, high = F.coalesce("_before", "_earlier"), F.coalesce("_after", "_later")
    slope = (high["mean"] - low["mean"]) / F.nullif(high["x"] - low["x"], F.lit(0.0))
    between = low["mean"] + F.coalesce(slope * (F.col("_x") - low["x"]), F.lit(0.0))
    found = F.when(F.col("_x").isNull(), None).when(low.isNull(), high["mean"]).when(
        high.isNull(), low["mean"]).when(high["x"] == F.col("_x"), high["mean"]).otherwise(between)
    return located.withColumn("_mean", found).select("_row.*", "_mean").withColumnRenamed("_mean", name)
