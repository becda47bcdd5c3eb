"""Windows along the yearly series of one entity.

An entity has at most one row per year, so the window group is as long as the
series and never grows with the data. The series has gaps: a lag is the row
of exactly that year, found by a RANGE frame, and null if the year is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_year(value: Column, keys, year: str, offset: int) -> Column:
    """Value of the same entity exactly ``offset`` years away."""
    frame = Window.partitionBy(*keys).orderBy(year).rangeBetween(offset, offset)
    return F.max(value).over(frame)


def present_in_year(keys, year: str, offset: int) -> Column:
    """Whether the entity has a row exactly ``offset`` years away.

    Key values that are null never match, as in an equi-join.
    """
    frame = Window.partitionBy(*keys).orderBy(year).rangeBetween(offset, offset)
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known & (F.count(F.lit(1)).over(frame) > 0)


def to_date(keys, year: str):
    """The frame of all years up to and including the current one."""
    return (
        Window.partitionBy(*keys)
        .orderBy(year)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def trailing_run(df: DataFrame, keys, year: str, flag: Column, name: str) -> DataFrame:
    """Adds whether a row belongs to the unbroken run of flagged years at the end.

    The run ends at the last year whose flag is false or null.
    """
    held = F.coalesce(flag, F.lit(False))
    last_break = F.max(F.when(~held, F.col(year))).over(Window.partitionBy(*keys))
    return df.withColumn(name, held & (last_break.isNull() | (F.col(year) > last_break)))
