"""Completion against the entrants of earlier years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplypanel.functions.columns import all_present, safe_ratio
from supplypanel.operators.order_statistics import grouped_median
from supplypanel.operators.timeline import in_year
from supplypanel.plans.mart import OFFER
from supplypanel.plans.portfolio import last_year

LAGS = (3, 4, 5)
MIN_ENTRANTS = 20


def lagged_completion(snapshot: DataFrame, lags=LAGS, min_entrants: int = MIN_ENTRANTS) -> DataFrame:
    """Graduates of a year over the entrants of the same offer some years before.

    Both years must be observed. Ratios above one mix cohorts; they are kept
    and flagged. Entrants of every lag come from one window pass, not a join
    per lag.
    """
    series = snapshot.where(all_present(OFFER)).select(
        "census_year", *OFFER, "course_name", "cine_label_code", "graduates",
        F.array(
            *[
                F.struct(
                    F.lit(lag).alias("lag_years"),
                    in_year(F.col("entrants"), OFFER, "census_year", -lag).alias("lagged_entrants"),
                )
                for lag in lags
            ]
        ).alias("_lags"),
    )
    paired = series.where(F.col("graduates").isNotNull()).select(
        "*", F.inline("_lags")
    ).where(F.col("lagged_entrants").isNotNull())
    return paired.select(
        "census_year", "institution_id", "course_id", "course_name", "cine_label_code",
        "teaching_modality", "lag_years",
        (F.col("census_year") - F.col("lag_years")).cast("smallint").alias("entrant_year"),
        "lagged_entrants", "graduates",
        (F.col("lagged_entrants") >= min_entrants).alias("is_eligible"),
        safe_ratio("graduates", "lagged_entrants").alias("lagged_completion_ratio"),
        (F.col("graduates") > F.col("lagged_entrants")).alias("exceeds_one"),
    )


def lagged_completion_summary(completion: DataFrame) -> DataFrame:
    """Eligible offers by year, modality and lag; the median is exact.

    There are years x modalities x lags groups, a few hundred, each huge: their
    cut points are broadcast and the median comes from a histogram that is
    spread over slices of each group, not from one task per group.
    """
    groups = ["census_year", "teaching_modality", "lag_years"]
    eligible = completion.where("is_eligible")
    totals = eligible.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("eligible_offers"),
        F.sum("graduates").alias("graduates"),
        F.sum("lagged_entrants").alias("lagged_entrants"),
        safe_ratio(F.sum("graduates"), F.sum("lagged_entrants")).alias("aggregate_completion_ratio"),
        safe_ratio(F.count_if("exceeds_one"), F.count(F.lit(1))).alias("exceeds_one_share"),
    )
    median = grouped_median(
        eligible, groups, "lagged_completion_ratio", "median_offer_ratio", few_groups=True
    )
    return totals.join(median, groups, "left").select(
        *groups, "eligible_offers", "graduates", "lagged_entrants", "aggregate_completion_ratio",
        "median_offer_ratio", "exceeds_one_share",
    )


def completion_coverage(
    summary: DataFrame, snapshot: DataFrame, year: int | None = None, lag: int | None = None
) -> DataFrame:
    """The summary of one year (default the last) next to the offers it covers."""
    chosen = F.lit(year) if year is not None else last_year(snapshot)
    current = (
        snapshot.where((F.col("census_year") == chosen) & F.col("graduates").isNotNull())
        .groupBy("teaching_modality")
        .agg(F.count(F.lit(1)).alias("current_offers"))
    )
    rows = summary.where(F.col("census_year") == chosen)
    if lag is not None:
        rows = rows.where(F.col("lag_years") == lag)
    return (
        rows.join(current, "teaching_modality")
        .select(
            "census_year", "teaching_modality", "lag_years", "eligible_offers", "current_offers",
            safe_ratio("eligible_offers", "current_offers").alias("coverage_share"),
            "aggregate_completion_ratio", "median_offer_ratio", "exceeds_one_share",
        )
        .orderBy("teaching_modality", "lag_years")
    )
