"""Two measure families at different grains joined in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplypanel.functions.columns import all_present


def reconcile(
    rows: DataFrame,
    keys,
    *,
    capacity: Column,
    students: Column,
    together: Column,
    labels,
    capacity_measures,
    student_measures,
    capacity_count: str,
    student_count: str,
    cluster=(),
    partitions: int | None = None,
    unique: str | None = None,
) -> DataFrame:
    """One row per key with capacity and student sums side by side.

    ``capacity`` and ``students`` say which rows carry which family; a row may
    carry both (``together``), and such rows never mix with the others. The
    result equals a full outer join of the two families' own aggregates: a
    family without rows has null sums and a null row count, and a row with a
    null key stays apart from the other family, because null never joins.
    Labels come from the capacity side alone.

    The input is read once. Labels group first, so that both steps are hash
    aggregations with partial sums on the map side; the second step sees about
    one row per key and family, however many rows one key has. With ``cluster``,
    a part of the key, the second step is spread by those columns alone, and a
    table bucketed by them can be written without another shuffle.

    ``unique`` names the result whose key must be unique: the second step then
    meets rows of a key that came together and others that did not in one group,
    and the job fails with that key, without a pass of its own.
    """
    side = (
        F.when(together, F.lit(0))
        .when(all_present(keys), F.lit(1))
        .otherwise(F.when(capacity, F.lit(2)).otherwise(F.lit(3)))
    )
    prepared = rows.where(capacity | students).select(
        *keys,
        side.alias("_side"),
        *[F.when(capacity, F.col(c)).alias(c) for c in labels],
        *[F.when(capacity, F.col(c)).alias(c) for c in capacity_measures],
        *[F.when(students, F.col(c)).alias(c) for c in student_measures],
        F.when(capacity, F.lit(1)).alias(capacity_count),
        F.when(students, F.lit(1)).alias(student_count),
    )
    sums = [*capacity_measures, *student_measures, capacity_count, student_count]
    by_label = prepared.groupBy(*keys, "_side", *labels).agg(*[F.sum(c).alias(c) for c in sums])
    if cluster:
        by_label = by_label.repartition(partitions, *cluster)
    group = F.col("_side")
    if unique:
        group = F.when(all_present(keys), F.lit(0)).otherwise(group)
    last = F.sum(sums[-1])
    if unique:
        last = failing_where(F.min("_side") != F.max("_side"), last, keys, unique)
    return (
        by_label.groupBy(*keys, group.alias("_group"))
        .agg(*[F.max(c).alias(c) for c in labels], *[F.sum(c).alias(c) for c in sums[:-1]], last.alias(sums[-1]))
        .drop("_group")
    )


def failing_where(repeated: Column, value: Column, keys, what: str) -> Column:
    """``value``, or a failure of the job that names the key of the group where ``repeated`` holds."""
    shown = F.concat_ws(", ", *[F.first(F.col(k).cast("string")) for k in keys])
    error = F.raise_error(F.concat(F.lit(f"{what}: key {list(keys)} is not unique: "), shown))
    return F.when(repeated, error.cast("bigint")).otherwise(value)


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Key combinations that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def require_unique(df: DataFrame, keys, what: str) -> DataFrame:
    """The same DataFrame, after an action that proves its key unique."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"{what}: key {list(keys)} is not unique")
    return df
