"""Top rows, overall and per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplypanel.sources.tables import settled

#: Rows of a range in which one task numbers, and how fine the summary of scores is.
RANGE_ROWS, ACCURACY = 100_000, 100_000

def top_per_group(df: DataFrame, group, order, n: int = 1) -> DataFrame:
    """The first ``n`` rows of every group.

    Catalyst turns the rank filter into a group limit before the shuffle, so
    a large group sends at most ``n`` rows per map task.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def numbered_top(df: DataFrame, order, n: int, name: str = "position") -> DataFrame:
    """The first ``n`` rows overall, numbered from 1 (``n`` rows in one task)."""
    leaders = df.orderBy(*order).limit(n)
    return leaders.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def ranked_top(df: DataFrame, score: str, keys, n: int, name: str = "position") -> DataFrame:
    """The ``n`` rows of highest score, then smallest keys, numbered from 1; for any ``n``, also one that grows with the rows.

    A quantile summary, merged on the map side, gives a score that at least ``n``
    rows reach; that is counted, and without the cut if they should not. Only
    rows above it are sorted, in ranges that end inside ties too; a row's place in
    its range plus the rows of earlier ranges is its number. No task holds the
    ``n`` rows. Null scores rank last.
    """
    df = settled(df)
    total = df.count()
    above = df
    if total > n:
        share = max(0.0, 1 - n / total - 2 / ACCURACY)
        cut = df.agg(F.percentile_approx(score, share, ACCURACY)).first()[0]
        leading = df.where(F.col(score) >= cut) if cut is not None else df
        above = leading if leading.count() >= n else df
    order = [F.desc_nulls_last(score), *keys, "_number"]
    ranges = max(2, -(-min(total, n) // RANGE_ROWS))
    placed = settled(
        above.withColumn("_number", F.monotonically_increasing_id())
        .repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_at", 33))  # the id counts rows below bit 33, partitions above
    )
    sizes = placed.groupBy("_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    position = (F.col("_at") + F.col("_shift") + 1).alias(name)
    # One row for each range.
    return placed.join(F.broadcast(starts), "_range").select(*df.columns, position).where(F.col(name) <= n)
