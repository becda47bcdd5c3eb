"""Deterioration labels, features known at the time, and the training set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplypanel.functions.columns import all_present, growth, safe_ratio
from supplypanel.operators.concentration import herfindahl
from supplypanel.operators.timeline import in_year, present_in_year, to_date
from supplypanel.plans.mart import OFFER
from supplypanel.plans.panel import is_low, is_measurable

# Split names, the smallest offer considered, feature and label columns.
TRAIN, TEST = "treino", "teste"
MIN_ENROLLMENTS = 20

FEATURES = [
    "education_network", "administrative_category", "offered_seats", "entrants", "enrollments",
    "occupancy_rate", "has_measurable_occupancy", "applications_per_seat", "graduation_intensity",
    "years_observed_to_date", "measurable_years_to_date", "low_occupancy_years_to_date",
    "low_occupancy_share_to_date", "current_low_occupancy_streak", "mean_occupancy_to_date",
    "demand_volatility_to_date", "occupancy_rate_lag1", "occupancy_change_1y",
    "enrollment_growth_1y", "seat_growth_1y", "enrollment_growth_2y", "institution_offer_count",
    "institution_enrollment_hhi",
]
LABELS = [
    "base_enrollments", "base_entrants", "base_offered_seats", "horizon_enrollments",
    "disappeared_from_census", "label_is_observable", "deteriorated",
]


def _add_labels(panel: DataFrame, last_year: int, horizon: int) -> DataFrame:
    year = F.col("census_year")
    base = F.col("enrollments")
    observable = year + horizon <= last_year
    seen = present_in_year(OFFER, "census_year", horizon)
    later = F.when(seen, in_year(base, OFFER, "census_year", horizon))
    framed = panel.withColumns({"_seen": seen, "horizon_enrollments": later})
    disappeared = ~F.col("_seen")
    return framed.withColumns(
        {
            "base_enrollments": base,
            "base_entrants": F.col("entrants"),
            "base_offered_seats": F.col("offered_seats"),
            "disappeared_from_census": disappeared,
            "label_is_observable": observable,
            "deteriorated": F.when(
                observable,
                F.when(disappeared, F.lit(True)).when(
                    base != 0, F.col("horizon_enrollments") * 2 < base
                ),
            ),
        }
    )


def deterioration_labels(snapshot: DataFrame, last_year: int, horizon: int = 2) -> DataFrame:
    """Whether an offer loses half its enrolments, or vanishes, in two years.

    Null where the horizon lies beyond the series, or where there was nothing
    to lose. The future row is the one of exactly that year.
    """
    return _add_labels(snapshot, last_year, horizon).select(
        *OFFER, F.col("census_year").alias("reference_year"), *LABELS
    )


def institution_context(snapshot: DataFrame) -> DataFrame:
    """Offers and enrolment concentration of each institution and year."""
    return snapshot.groupBy("institution_id", "census_year").agg(
        F.count(F.lit(1)).alias("institution_offer_count"),
        herfindahl("enrollments").alias("institution_enrollment_hhi"),
    )


def _add_features(panel: DataFrame, context: DataFrame) -> DataFrame:
    year = "census_year"
    upto = to_date(OFFER, year)
    occupancy = safe_ratio("entrants", "offered_seats")
    measurable = F.coalesce(is_measurable(), F.lit(False))
    low = F.coalesce(is_low(), F.lit(False))
    known = all_present(OFFER)  # a null key has no other years, as in a join

    def before(value, offset):
        return F.when(known, in_year(value, OFFER, year, -offset))

    flagged = panel.withColumns(
        {"occupancy_rate": occupancy, "has_measurable_occupancy": measurable, "_low": low}
    )
    # Every window below has the same partitioning and order: one sort.
    framed = flagged.withColumns(
        {
            "years_observed_to_date": F.count(F.lit(1)).over(upto),
            "measurable_years_to_date": F.count_if("has_measurable_occupancy").over(upto),
            "low_occupancy_years_to_date": F.count_if("_low").over(upto),
            "mean_occupancy_to_date": F.avg(
                F.when(F.col("has_measurable_occupancy"), F.col("occupancy_rate"))
            ).over(upto),
            "_entrants_stddev": F.stddev_samp("entrants").over(upto),
            "_entrants_mean": F.avg("entrants").over(upto),
            "occupancy_rate_lag1": before(F.col("occupancy_rate"), 1),
            "_enrollments_1": before(F.col("enrollments"), 1),
            "_enrollments_2": before(F.col("enrollments"), 2),
            "_seats_1": before(F.col("offered_seats"), 1),
        }
    )
    acceptable = F.col("has_measurable_occupancy") & ~F.col("_low")
    last_acceptable = F.max(F.when(acceptable, F.col("measurable_years_to_date"))).over(upto)
    ranked = framed.withColumn("_last_acceptable", last_acceptable)
    return ranked.join(context, ["institution_id", "census_year"], "left").withColumns(
        {
            "applications_per_seat": safe_ratio("applications", "offered_seats"),
            "graduation_intensity": safe_ratio("graduates", "enrollments"),
            "low_occupancy_share_to_date": safe_ratio(
                "low_occupancy_years_to_date", "measurable_years_to_date"
            ),
            "current_low_occupancy_streak": F.col("measurable_years_to_date")
            - F.coalesce("_last_acceptable", F.lit(0)),
            "demand_volatility_to_date": safe_ratio("_entrants_stddev", "_entrants_mean"),
            "occupancy_change_1y": F.col("occupancy_rate") - F.col("occupancy_rate_lag1"),
            "enrollment_growth_1y": growth("enrollments", "_enrollments_1"),
            "seat_growth_1y": growth("offered_seats", "_seats_1"),
            "enrollment_growth_2y": growth("enrollments", "_enrollments_2"),
        }
    )


def offer_features(snapshot: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Features of an offer in a reference year from that year and earlier ones.

    ``context`` is ``institution_context`` of the same snapshot. Handed in as a
    written table its size is known, so Spark broadcasts it when it is small
    and the feature rows are not shuffled for two columns.

    Lags are exact years read from RANGE frames over the same sorted
    partition as the cumulative features, in place of self-joins.
    """
    context = institution_context(snapshot) if context is None else context
    return _add_features(snapshot, context).select(
        *OFFER, F.col("census_year").alias("reference_year"), *FEATURES
    )


def training_set(
    snapshot: DataFrame,
    last_year: int = 2024,
    context: DataFrame | None = None,
    train_years: tuple[int, int] = (2016, 2020),
    test_years: tuple[int, int] = (2021, 2022),
    horizon: int = 2,
    min_enrollments: int = MIN_ENROLLMENTS,
) -> DataFrame:
    """Features with a determined label, split by time.

    Features and labels describe the same rows, so they are computed side by
    side in one pass over each offer's series and never joined.
    """
    reference = F.col("census_year")
    context = institution_context(snapshot) if context is None else context
    both = _add_features(_add_labels(snapshot, last_year, horizon), context)
    split = F.when(reference.between(*train_years), TRAIN).when(reference.between(*test_years), TEST)
    return both.where(
        all_present(OFFER)
        & reference.between(train_years[0], test_years[1])
        & F.col("label_is_observable")
        & F.col("deteriorated").isNotNull()
        & (F.col("base_enrollments") >= min_enrollments)
    ).select(
        *OFFER, reference.alias("reference_year"), *FEATURES,
        "deteriorated", "disappeared_from_census", "base_enrollments", "horizon_enrollments",
        split.alias("split"),
    )


def scoring_rows(
    features: DataFrame, snapshot: DataFrame, year: int, min_enrollments: int = MIN_ENROLLMENTS
) -> DataFrame:
    """Feature rows of a year whose horizon is still open, with course names."""
    names = snapshot.where(F.col("census_year") == year).select(*OFFER, "course_name")
    current = features.where(
        (F.col("reference_year") == year) & (F.col("enrollments") >= min_enrollments)
    )
    return current.join(names, OFFER)
