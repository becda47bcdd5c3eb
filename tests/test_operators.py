"""Shared operators: order statistics, runs, concentration, plans at scale."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from supplypanel.functions.columns import correlation, lenient, safe_ratio, typed
from supplypanel.operators.concentration import herfindahl, running_share
from supplypanel.operators import order_statistics
from supplypanel.operators.order_statistics import grouped_median, running_totals
from supplypanel.operators.ranking import top_per_group
from supplypanel.operators.reconcile import require_unique
from supplypanel.operators.timeline import trailing_run
from supplypanel.plans import mart

FOLDER = "/root/testdata/sf0.001"


def executed_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns(spark):
    row = spark.createDataFrame([(" 7 ", "  ", "x1", 0, 5)], "a string, b string, c string, z int, n int").select(
        typed("a", "smallint").alias("a"), typed("b", "bigint").alias("b"),
        lenient("c", "bigint").alias("c"), safe_ratio("n", "z").alias("r"),
    ).first()
    assert tuple(row) == (7, None, None, None)


def test_correlation_without_variance_is_null(spark):
    flat = spark.range(5).agg(correlation(F.col("id"), F.lit(3)).alias("r")).first()
    line = spark.range(5).agg(correlation(F.col("id"), F.col("id") * -2).alias("r")).first()
    assert flat.r is None and line.r == pytest.approx(-1)


@pytest.mark.parametrize("partitions", [2, 8, 200])
def test_running_totals_match_brute_force(spark, partitions):
    generator = np.random.default_rng(partitions)
    values = generator.integers(0, 400, 900).astype(float)
    values[:300] = 7.0
    groups = generator.integers(0, 3, 900)
    rows = [(int(g), float(v)) for g, v in zip(groups, values)]
    histogram = spark.createDataFrame(rows, "g int, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = running_totals(histogram, ["g"], "v", ["n"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert sum(r.n for r in found) == 900
    for r in found:
        mine = values[groups == r.g]
        assert (r.before_n, r.total_n) == ((mine < r.v).sum(), len(mine))


def test_grouped_median_with_one_huge_group(spark):
    generator = np.random.default_rng(3)
    sizes = {0: 1500, 1: 1, 2: 2, 3: 101}
    data = {g: generator.random(n) for g, n in sizes.items()}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [(4, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    found = {r.g: r.m for r in grouped_median(df, ["g"], "v", "m").collect()}
    assert found == pytest.approx({g: float(np.median(v)) for g, v in data.items()})


def test_herfindahl_is_the_sum_of_squared_shares(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (1, None), (2, 0)], "g int, x bigint")
    found = {r.g: r.h for r in df.groupBy("g").agg(herfindahl("x").alias("h")).collect()}
    assert found == {1: 0.75**2 + 0.25**2, 2: None}


def test_running_share_sorts_unknown_first(spark):
    df = spark.createDataFrame([(1, 60), (2, 30), (3, None), (4, 10)], "k int, x bigint")
    found = running_share(df, "x", ["k"], (1, 2, 4, 9)).collect()
    assert [(r.position, r.cumulative_share) for r in found] == [(1, None), (2, 0.6), (4, 1.0)]


def test_trailing_run(spark):
    rows = [(1, 2001, True), (1, 2002, None), (1, 2003, True), (1, 2005, True), (2, 2001, True), (3, 2001, False)]
    df = spark.createDataFrame(rows, "k int, y int, f boolean")
    runs = trailing_run(df, ["k"], "y", F.col("f"), "r").groupBy("k").agg(F.count_if("r").alias("n"))
    assert {r.k: r.n for r in runs.collect()} == {1: 2, 2: 1, 3: 0}


def test_unique_key_guard(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    assert require_unique(df, ["a", "b"], "t") is df
    with pytest.raises(ValueError, match="not unique"):
        require_unique(df, ["a"], "t")


# --- Plans ------------------------------------------------------------------------------


def test_mart_reads_its_source_once_with_partial_sums(spark):
    plan = executed_plan(entry.queries()["course_supply"](spark, FOLDER))
    assert plan.count("FileScan parquet") == 1
    assert "partial_sum" in plan and "Join" not in plan


def test_snapshot_layout_is_not_shuffled_twice(spark):
    supply = mart.course_supply(entry._courses(spark, FOLDER), buckets=5)
    assert executed_plan(supply).count("Exchange") == 2
    assert executed_plan(supply.repartition(5, *mart.OFFER)).count("Exchange") == 2


@pytest.mark.parametrize(
    "name",
    ["course_persistence", "deterioration_labels", "lagged_completion", "modality_transitions",
     "offer_features", "training_set"],
)
def test_series_products_need_no_shuffle(spark, name):
    """Bucketing by offer leaves the windows and aggregations without an exchange."""
    df = entry.queries()[name](spark, FOLDER)
    plan = executed_plan(df)
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_year_filter_prunes_partitions(spark):
    plan = executed_plan(entry.queries()["capacity_totals"](spark, FOLDER))
    assert "PartitionFilters: [isnotnull(census_year" in plan
    assert "ReadSchema: struct<institution_id:int,offered_seats:bigint,entrants:bigint>" in plan


def test_a_huge_group_is_ranked_in_slices(spark, monkeypatch):
    """With broadcasting left to the hints alone, the rows of one group go to many tasks."""
    monkeypatch.setattr(order_statistics, "SLICE_ROWS", 500)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.range(9001).select(F.lit(1).alias("g"), (F.col("id") * 3).alias("v"))
        found = grouped_median(df, ["g"], "v", "m", few_groups=True)
        plan = executed_plan(found)
        assert found.first().m == 13500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert re.search(r"Exchange hashpartitioning\((g#\d+, )?_slice#", plan)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    plan = executed_plan(top_per_group(df, ["g"], [F.desc("id")]))
    assert plan.count("WindowGroupLimit") == 2


def test_no_cross_joins_and_no_python_rows(spark):
    registered = entry.queries()
    for name in (
        "course_sustainability", "offer_features", "modality_transitions", "lagged_completion_summary",
        "surviving_panel", "dimension_profile", "ranking_metrics", "feature_checks",
    ):
        plan = executed_plan(registered[name](spark, FOLDER))
        assert "CartesianProduct" not in plan, name
        assert "Python" not in plan, name
