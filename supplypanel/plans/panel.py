"""Occupancy over the series: the panel, persistence and volatility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplypanel.functions.columns import safe_ratio
from supplypanel.operators.timeline import trailing_run
from supplypanel.plans.mart import OFFER


def is_measurable() -> Column:
    """Occupancy exists only where seats are declared."""
    return F.col("offered_seats") > 0


def is_low() -> Column:
    """Occupancy below one quarter, tested on integers; null if unknown."""
    return is_measurable() & (F.col("entrants") * 4 < F.col("offered_seats"))


def supply_panel(snapshot: DataFrame) -> DataFrame:
    """Offer-years with their occupancy and its flags (nulls stay null)."""
    return snapshot.select(
        "census_year", *OFFER, "course_name", "education_network", "administrative_category",
        "offered_seats", "applications", "entrants", "enrollments", "graduates",
        safe_ratio("entrants", "offered_seats").alias("seat_occupancy_rate"),
        is_measurable().alias("has_measurable_occupancy"),
        is_low().alias("is_low_occupancy"),
    )


def course_persistence(panel: DataFrame) -> DataFrame:
    """One row per offer over its measurable years.

    Looks at the whole series, so it must not feed a prediction. Window and
    aggregation share the offer key: one shuffle, none on a bucketed table.
    """
    measurable = panel.where("has_measurable_occupancy")
    flagged = trailing_run(measurable, OFFER, "census_year", F.col("is_low_occupancy"), "_in_run")
    span = F.col("last_year") - F.col("first_year") + F.lit(1)
    return (
        flagged.groupBy(*OFFER)
        .agg(
            F.min("census_year").alias("first_year"),
            F.max("census_year").alias("last_year"),
            F.count(F.lit(1)).alias("measurable_years"),
            F.count_if("is_low_occupancy").alias("low_occupancy_years"),
            F.count_if("_in_run").alias("current_low_occupancy_streak"),
            F.avg("seat_occupancy_rate").alias("mean_occupancy_rate"),
            F.stddev_samp("seat_occupancy_rate").alias("occupancy_stddev"),
            F.sum(F.col("offered_seats") - F.col("entrants")).alias("total_unconverted_capacity"),
            safe_ratio(F.stddev_samp("entrants"), F.avg("entrants")).alias("demand_volatility"),
        )
        .select(
            *OFFER, "first_year", "last_year", "measurable_years", "low_occupancy_years",
            "current_low_occupancy_streak",
            safe_ratio("low_occupancy_years", "measurable_years").alias("low_occupancy_share"),
            "mean_occupancy_rate", "occupancy_stddev", "total_unconverted_capacity",
            "demand_volatility",
            span.cast("int").alias("calendar_span"),
            (F.col("measurable_years") < span).alias("has_gaps"),
        )
    )


def long_panel_persistence(
    persistence: DataFrame, min_years: int = 8, long_streak: int = 5
) -> DataFrame:
    """Persistence by modality over offers observed long and without gaps."""
    share = F.col("low_occupancy_share")
    return (
        persistence.where((F.col("measurable_years") >= min_years) & ~F.col("has_gaps"))
        .groupBy("teaching_modality")
        .agg(
            F.count(F.lit(1)).alias("offers"),
            F.avg(share).alias("mean_low_share"),
            safe_ratio(F.count_if(share == 1), F.count(F.lit(1))).alias("always_idle_share"),
            safe_ratio(
                F.count_if(F.col("current_low_occupancy_streak") >= long_streak), F.count(F.lit(1))
            ).alias("long_streak_share"),
            F.avg("demand_volatility").alias("mean_volatility"),
        )
        .orderBy("teaching_modality")
    )
