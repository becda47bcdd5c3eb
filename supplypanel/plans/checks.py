"""Data-quality checks; each counts violations, zero on good data.

A family of checks is one table ``check_name, census_year, violations``. The
year is null for a check over the whole series; a check by year has a row for
each year with violations. Counts over the same input share one scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplypanel.operators.comparison import difference_counts, set_difference
from supplypanel.operators.reconcile import duplicate_keys
from supplypanel.plans.mart import KEYS, OFFER
from supplypanel.plans.panel import is_low, is_measurable
from supplypanel.plans.portfolio import DISTANCE, DUAL, ON_SITE, first_year, last_year
from supplypanel.plans.risk import TEST, TRAIN


def _together(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _counted(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Rows meeting each condition, all in one aggregation."""
    return _listed(df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()]))


def _listed(counts: DataFrame) -> DataFrame:
    """A row of counts as one row per count."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations"))
            for n in counts.columns
        ]
    )
    return counts.select(F.inline(rows)).select(
        "check_name", F.lit(None).cast("int").alias("census_year"), "violations"
    )


def _added_up(
    per_year: DataFrame, yearly: dict[str, Column], overall: dict[str, Column], year: Column
) -> DataFrame:
    """Counts held by each year, listed by year or added up over all of them.

    A yearly check without violations has no row; an overall one always has.
    """
    no_year = F.lit(None).cast("int")

    def entries(counts, at, zero=False):
        return [
            F.struct(
                F.lit(name).alias("check_name"),
                at.alias("census_year"),
                (F.lit(0) if zero else F.coalesce(c, F.lit(0))).cast("bigint").alias("violations"),
            )
            for name, c in counts.items()
        ]

    listed = per_year.select(F.inline(F.array(*entries(yearly, year), *entries(overall, no_year))))
    floor = per_year.sparkSession.range(1).select(
        F.inline(F.array(*entries(overall, no_year, zero=True)))
    )
    return (
        listed.unionByName(floor)
        .groupBy("check_name", "census_year")
        .agg(F.sum("violations").alias("violations"))
        .where(F.col("check_name").isin(*overall) | (F.col("violations") > 0))
    )


def _rows(df: DataFrame, name: str) -> DataFrame:
    """How many rows there are, as one check."""
    return df.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name).alias("check_name"), F.lit(None).cast("int").alias("census_year"), "violations"
    )


def _by_year(df: DataFrame, name: str, year: str = "census_year") -> DataFrame:
    return df.groupBy(F.col(year).cast("int").alias("census_year")).agg(
        F.count(F.lit(1)).alias("violations")
    ).select(F.lit(name).alias("check_name"), "census_year", "violations")


def mart_checks(supply: DataFrame) -> DataFrame:
    """One row per key, and only the two modalities."""
    modality = F.col("teaching_modality")
    return _together(
        [
            _by_year(duplicate_keys(supply, KEYS), "duplicate_mart_key"),
            _counted(supply, {"invalid_modality_count": modality.isNull() | ~modality.isin(1, 2)}),
        ]
    )


def raw_checks(
    courses: DataFrame, institutions: DataFrame, first: int, last: int, respelt_year: int
) -> DataFrame:
    """Key, year, label and dimension checks on the union of raw editions.

    One pass: rows are counted per key, keys per year, and years added up.
    """
    year, dimension = F.col("nu_ano_censo"), F.col("tp_dimensao")
    grain = ["nu_ano_censo", "tp_dimensao", "co_ies", "co_curso", "co_municipio", "tp_modalidade_ensino"]
    per_key = courses.groupBy(*grain).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("co_cine_rotulo").isNull()).alias("_no_label"),
    )
    unknown = dimension.isNull() | ~dimension.isin("1", "2", "3", "4")
    per_year = per_key.groupBy("nu_ano_censo").agg(
        F.count_if(F.col("_rows") > 1).alias("_repeated"),
        F.sum("_rows").alias("_rows"),
        F.sum("_no_label").alias("_no_label"),
        F.sum(F.when(unknown, F.col("_rows"))).alias("_unknown"),
    )
    outside = ~year.cast("int").between(first, last)
    return _together(
        [
            _added_up(
                per_year,
                yearly={"duplicate_key_count": F.col("_repeated")},
                overall={
                    "unexpected_year_count": F.when(outside, 1),
                    "null_year_count": F.when(year.isNull(), F.col("_rows")),
                    "missing_cine_label_count": F.when(year == str(respelt_year), F.col("_no_label")),
                    "invalid_dimension_count": F.col("_unknown"),
                },
                year=year.cast("int"),
            ),
            _by_year(
                duplicate_keys(institutions, ["nu_ano_censo", "co_ies"]),
                "duplicate_institution_count",
                "nu_ano_censo",
            ),
        ]
    )


def staging_checks(
    courses: DataFrame, institutions: DataFrame, first: int, last: int, zero_from: int
) -> DataFrame:
    """Typed keys, window, editions, applicable measures, blank convention.

    ``zero_from`` is the year from which an inapplicable measure is zero
    instead of blank. All course checks come from one pass by year, which the
    expected years join as years without rows.
    """
    year, dimension = F.col("census_year"), F.col("dimension_type")
    keys = [*KEYS, "dimension_type", "academic_level"]
    unparsed = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    counts = {
        "_rows": F.count(F.lit(1)),
        "_unparsed": F.count_if(unparsed),
        "_no_network": F.count_if(F.col("education_network").isNull()),
        "_blank": F.count_if((dimension == 3) & F.col("entrants").isNull()),
        "_national": F.count_if(dimension == 3),
        "_no_capacity": F.count_if(dimension.isin(1, 3) & F.col("offered_seats").isNull()),
        "_no_entrants": F.count_if(dimension.isin(1, 2) & F.col("entrants").isNull()),
    }
    observed = courses.groupBy("census_year").agg(*[c.alias(n) for n, c in counts.items()])
    expected = courses.sparkSession.range(first, last + 1).select(
        F.col("id").cast("smallint").alias("census_year"), *[F.lit(0).alias(n) for n in counts]
    )
    per_year = observed.unionByName(expected).groupBy("census_year").agg(
        *[F.sum(n).alias(n) for n in counts]
    )
    inside = year.between(first, last)
    expected_blanks = F.when(year < zero_from, F.col("_national")).when(year >= zero_from, 0)
    return _together(
        [
            _added_up(
                per_year,
                yearly={
                    "null_capacity_count": F.col("_no_capacity"),
                    "null_entrant_count": F.col("_no_entrants"),
                },
                overall={
                    "unparsed_key_count": F.col("_unparsed"),
                    "out_of_window_count": F.when(~inside, F.col("_rows")),
                    "missing_edition_count": F.when(inside & (F.col("_rows") == 0), 1),
                    "null_network_count": F.col("_no_network"),
                    "unexpected_blank_convention_count": F.when(F.col("_blank") != expected_blanks, 1),
                },
                year=year.cast("int"),
            ),
            _rows(
                duplicate_keys(institutions, ["census_year", "institution_id"]),
                "duplicate_institution_count",
            ),
        ]
    )


def persistence_checks(
    supply: DataFrame, snapshot: DataFrame, edition_supply: DataFrame, panel: DataFrame,
    persistence: DataFrame, first: int, last: int,
) -> DataFrame:
    """The snapshot against its source, and the persistence product."""
    measured = [*OFFER, "offered_seats", "entrants", "enrollments", "graduates", "applications"]
    c = F.col
    return _together(
        [
            _listed(
                difference_counts(supply, snapshot, KEYS).toDF(
                    "snapshot_drift_count", "snapshot_surplus_count"
                )
            ),
            _rows(
                set_difference(snapshot.where(c("census_year") == last), edition_supply, measured),
                "regression_against_edition_count",
            ),
            _counted(
                persistence,
                {
                    "impossible_count_rows": (c("low_occupancy_years") > c("measurable_years"))
                    | (c("current_low_occupancy_streak") > c("low_occupancy_years"))
                    | (c("current_low_occupancy_streak") > c("measurable_years")),
                    "out_of_range_share_count": ~c("low_occupancy_share").between(0, 1),
                    "out_of_window_count": (c("first_year") < first)
                    | (c("last_year") > last)
                    | (c("first_year") > c("last_year")),
                    "negative_volatility_count": c("demand_volatility") < 0,
                },
            ),
            _counted(
                panel,
                {
                    "unmeasurable_flagged_low_count": c("is_low_occupancy")
                    & ~c("has_measurable_occupancy")
                },
            ),
        ]
    )


def leakage(snapshot: DataFrame, features: DataFrame, cut: int) -> DataFrame:
    """Offers whose features at ``cut`` differ when later years are removed.

    The counts are recomputed from the series truncated at ``cut`` and
    compared with the features computed on the whole of it.
    """
    recomputed = (
        snapshot.where(F.col("census_year") <= cut)
        .groupBy(*OFFER)
        .agg(
            F.count(F.lit(1)).alias("_observed"),
            F.count_if(is_measurable()).alias("_measurable"),
            F.count_if(is_low()).alias("_low"),
        )
    )
    return (
        features.where(F.col("reference_year") == cut)
        .join(recomputed, OFFER)
        .where(
            (F.col("years_observed_to_date") != F.col("_observed"))
            | (F.col("measurable_years_to_date") != F.col("_measurable"))
            | (F.col("low_occupancy_years_to_date") != F.col("_low"))
        )
    )


def feature_checks(
    snapshot: DataFrame, features: DataFrame, labels: DataFrame, training: DataFrame,
    first: int, last: int, cut: int, horizon: int = 2,
) -> DataFrame:
    """No look-ahead, possible histories, coherent labels, a split by time."""
    c = F.col
    deteriorated = F.coalesce("deteriorated", F.lit(False))
    train_years = training.where(c("split") == TRAIN).select("reference_year")
    test_years = training.where(c("split") == TEST).select("reference_year")
    newest_train = training.where(c("split") == TRAIN).agg(F.max("reference_year")).scalar()
    return _together(
        [
            _rows(leakage(snapshot, features, cut), "temporal_leakage_count"),
            _counted(
                features,
                {
                    "impossible_history_count": (
                        c("years_observed_to_date") > c("reference_year") - first + 1
                    )
                    | (c("measurable_years_to_date") > c("years_observed_to_date"))
                    | (c("low_occupancy_years_to_date") > c("measurable_years_to_date"))
                    | (c("current_low_occupancy_streak") > c("measurable_years_to_date")),
                    "out_of_range_hhi_count": (c("institution_enrollment_hhi") < 0)
                    | (c("institution_enrollment_hhi") > 1.0000001),
                },
            ),
            _counted(
                labels,
                {
                    "label_beyond_series_count": (c("reference_year") + horizon > last)
                    & c("deteriorated").isNotNull(),
                    "inconsistent_disappearance_count": c("label_is_observable")
                    & c("disappeared_from_census")
                    & ~deteriorated,
                    "false_positive_label_count": c("label_is_observable")
                    & ~c("disappeared_from_census")
                    & (c("base_enrollments") > 0)
                    & (c("horizon_enrollments") >= c("base_enrollments"))
                    & deteriorated,
                },
            ),
            _rows(train_years.intersect(test_years), "overlapping_split_count"),
            _counted(
                training,
                {
                    "non_chronological_split_count": (c("split") == TEST)
                    & (c("reference_year") <= newest_train),
                    "undetermined_label_count": c("deteriorated").isNull(),
                },
            ),
        ]
    )


def modality_checks(
    snapshot: DataFrame, state: DataFrame, transitions: DataFrame, dependency: DataFrame,
    completion: DataFrame, lags=(3, 4, 5), min_entrants: int = 20,
) -> DataFrame:
    """States, transition years, shares, lags and eligibility."""
    c = F.col
    return _together(
        [
            _counted(
                state,
                {"invalid_modality_state_count": ~c("modality_state").isin(DUAL, ON_SITE, DISTANCE)},
            ),
            _counted(
                transitions,
                {
                    "invalid_transition_year_count": (c("census_year") <= first_year(snapshot))
                    | (c("census_year") > last_year(snapshot))
                },
            ),
            _counted(
                dependency,
                {
                    "invalid_dependency_share_count": ~c("ead_seat_share").between(0, 1)
                    | ~c("ead_entrant_share").between(0, 1)
                },
            ),
            _counted(
                completion,
                {
                    "invalid_lag_count": (c("census_year") - c("entrant_year") != c("lag_years"))
                    | ~c("lag_years").isin(*lags),
                    "invalid_eligibility_count": ~c("is_eligible").eqNullSafe(
                        c("lagged_entrants") >= min_entrants
                    ),
                },
            ),
        ]
    )
