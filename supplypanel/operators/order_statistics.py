"""Exact ranks and quantiles without a single-task sort.

Values are first collapsed to a histogram, so equal values cost one row. The
histogram is cut into slices of about equal length at approximate quantiles;
how good the approximation is affects only the balance. A running sum inside
each slice plus the total of the slices before it is the exact running sum.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplypanel.sources.tables import settled

#: Histogram rows that one slice should hold.
SLICE_ROWS = 1_000_000


def slice_count(rows: int) -> int:
    """Slices of about ``SLICE_ROWS``, so that a task's share does not grow with the data."""
    return max(2, -(-rows // SLICE_ROWS))


def _cut_points(value: str, slices: int) -> Column:
    """Approximate quantiles, all of them and every ``step``-th."""
    cuts = F.percentile_approx(value, [i / slices for i in range(1, slices)], slices * 20)
    step = _step(slices)
    coarse = F.filter(cuts, lambda _, i: i % step == step - 1)
    return F.struct(cuts.alias("all"), coarse.alias("coarse"))


def _step(slices: int) -> int:
    return math.isqrt(slices - 1) + 1


def _slice_of(value: str, slices: int) -> Column:
    """How many cut points lie below a value, looked up in two steps.

    Never null, so that a join on it adds no filter to one of its sides and
    the sides keep sharing the histogram's shuffle.
    """
    step = _step(slices)
    v = F.col(value)
    passed = F.size(F.filter("_cuts.coarse", lambda cut: cut < v)) * step
    rest = F.size(F.filter(F.slice("_cuts.all", passed + 1, F.lit(step)), lambda cut: cut < v))
    return F.coalesce(passed + rest, F.lit(0))


def running_totals(
    histogram: DataFrame, groups: Sequence[str], value: str, measures: Sequence[str],
    few_groups: bool = False,
) -> DataFrame:
    """Adds ``before_<m>`` and ``total_<m>`` to a histogram.

    ``histogram`` has one row per group and non-null value. ``before_<m>`` sums
    the measure over the smaller values of the group. ``few_groups`` says that
    the caller bounds the number of groups (say, one per feature); the
    per-group cut points and slice totals are then broadcast. Otherwise Spark
    chooses the joins from the sizes it meets.
    """
    groups = list(groups)
    # Counted, cut and ranked from one computation of whatever lies below.
    histogram = settled(histogram)
    slices = slice_count(histogram.count())
    hint = F.broadcast if few_groups or not groups else lambda table: table
    if groups:
        cuts = histogram.groupBy(*groups).agg(_cut_points(value, slices).alias("_cuts"))
        located = histogram.join(hint(cuts), groups)
    else:
        cuts = histogram.agg(_cut_points(value, slices)).scalar()
        located = histogram.withColumn("_cuts", cuts)
    located = located.withColumn("_slice", _slice_of(value, slices)).drop("_cuts")

    # One row per slice: at most `slices` for each group.
    per_slice = located.groupBy(*groups, "_slice").agg(
        *[F.sum(m).alias(f"_in_{m}") for m in measures]
    )
    of_group = Window.partitionBy(*groups)
    earlier = of_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *groups,
        "_slice",
        *[F.coalesce(F.sum(f"_in_{m}").over(earlier), F.lit(0)).alias(f"_base_{m}") for m in measures],
        *[F.sum(f"_in_{m}").over(of_group).alias(f"total_{m}") for m in measures],
    )
    inside = (
        Window.partitionBy(*groups, "_slice")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = located.select(
        "*",
        *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_inside_{m}") for m in measures],
    )
    # Without groups there are at most `slices` offset rows.
    joined = ranked.join(hint(offsets), [*groups, "_slice"])
    for m in measures:
        joined = joined.withColumn(f"before_{m}", F.col(f"_base_{m}") + F.col(f"_inside_{m}"))
    return joined.select(
        *histogram.columns,
        *[f"before_{m}" for m in measures],
        *[f"total_{m}" for m in measures],
    )


def quantiles_of_histogram(
    histogram: DataFrame, groups: Sequence[str], value: str, count: str,
    fractions: Sequence[tuple[int, int]], few_groups: bool = False,
) -> DataFrame:
    """Exact interpolated quantiles per group as an array in ``quantiles``.

    A fraction is a pair (numerator, denominator): the position
    ``numerator * (n - 1) / denominator`` is then integer arithmetic, and a
    quantile that falls on a value is that value, bit for bit.
    """
    ranked = running_totals(histogram, groups, value, [count], few_groups)
    before, n, total = F.col(f"before_{count}"), F.col(count), F.col(f"total_{count}")

    def at(rank):
        return F.max(F.when((before <= rank) & (rank < before + n), F.col(value)))

    picked = []
    for top, bottom in fractions:
        lower = F.expr(f"((total_{count} - 1) * {top}) div {bottom}")
        rest = ((total - 1) * top) % bottom
        upper = lower + F.when(rest > 0, F.lit(1)).otherwise(F.lit(0))
        picked += [at(lower), at(upper), F.max(rest) / F.lit(float(bottom))]
    names = [f"_q{i}" for i in range(len(picked))]
    found = ranked.groupBy(*groups).agg(*[c.alias(a) for c, a in zip(picked, names)])
    values = []
    for i in range(len(fractions)):
        low, high, weight = (F.col(names[3 * i + j]) for j in range(3))
        values.append(low + (high - low) * weight)
    return found.select(*groups, F.array(*values).alias("quantiles"))


def grouped_median(
    df: DataFrame, groups: Sequence[str], value: str, name: str, few_groups: bool = False
) -> DataFrame:
    """Exact median of the non-null values of each group."""
    histogram = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return quantiles_of_histogram(histogram, groups, value, "_n", [(1, 2)], few_groups).select(
        *groups, F.col("quantiles")[0].alias(name)
    )
