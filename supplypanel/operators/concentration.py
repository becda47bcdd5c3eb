"""Concentration of a measure over the members of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def herfindahl(measure: str) -> Column:
    """Sum of squared shares as one aggregate: sum(x^2) / sum(x)^2.

    Written this way no row needs its group's total, so a group of any size
    is summed on the map side and none has to fit in one task.
    """
    x = F.col(measure).cast("double")
    total = F.sum(x)
    return F.sum(x * x) / F.nullif(total * total, F.lit(0.0))


def running_share(members: DataFrame, measure: str, tie_keys, positions) -> DataFrame:
    """Cumulative share of the largest members, read at some positions.

    ``members`` has one row per member. Nulls sort first, as a descending
    order does in the SQL this follows, and add nothing. Only the first
    ``max(positions)`` rows reach the unpartitioned window; the total is a
    separate aggregate over all members.
    """
    order = [F.col(measure).desc_nulls_first(), *[F.col(k).asc() for k in tie_keys]]
    leaders = members.select(*tie_keys, measure).orderBy(*order).limit(max(positions))
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = members.agg(F.sum(measure)).scalar()
    return (
        leaders.select(
            F.row_number().over(Window.orderBy(*order)).alias("position"),
            F.sum(measure).over(upto).alias("_running"),
        )
        .where(F.col("position").isin(*positions))
        .select(
            F.col("position").cast("bigint").alias("position"),
            (F.col("_running").cast("double") / F.nullif(total.cast("double"), F.lit(0.0))).alias(
                "cumulative_share"
            ),
        )
        .orderBy("position")
    )
