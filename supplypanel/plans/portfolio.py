"""Institution-by-field portfolios across the two modalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplypanel.functions.columns import correlation, max_where, safe_ratio, sum_where
from supplypanel.operators.timeline import in_year, present_in_year
from supplypanel.sources.tables import materialize

PORTFOLIO = ["institution_id", "cine_label_code"]
# The states of a portfolio.
DUAL, ON_SITE, DISTANCE, ABSENT = "dual", "presencial", "ead", "ausente"
ARROW = " → "


def _modality(code: int) -> Column:
    return F.col("teaching_modality") == code


def first_year(table: DataFrame) -> Column:
    return table.agg(F.min("census_year")).scalar()


def last_year(table: DataFrame) -> Column:
    return table.agg(F.max("census_year")).scalar()


def modality_portfolio_state(snapshot: DataFrame) -> DataFrame:
    """Offers, seats and entrants by modality, and the state they make."""

    def total(code, measure):
        return F.coalesce(sum_where(_modality(code), measure), F.lit(0))

    return (
        snapshot.where(F.col("cine_label_code").isNotNull())
        .groupBy("census_year", *PORTFOLIO)
        .agg(
            F.max("cine_label_name").alias("cine_label_name"),
            F.count_if(_modality(1)).alias("presencial_offers"),
            F.count_if(_modality(2)).alias("ead_offers"),
            total(1, "offered_seats").alias("presencial_seats"),
            total(2, "offered_seats").alias("ead_seats"),
            total(1, "entrants").alias("presencial_entrants"),
            total(2, "entrants").alias("ead_entrants"),
        )
        .withColumns(
            {
                "modality_state": F.when(
                    (F.col("presencial_offers") > 0) & (F.col("ead_offers") > 0), DUAL
                )
                .when(F.col("presencial_offers") > 0, ON_SITE)
                .otherwise(DISTANCE),
                "ead_seat_share": safe_ratio(
                    "ead_seats", F.col("presencial_seats") + F.col("ead_seats")
                ),
                "ead_entrant_share": safe_ratio(
                    "ead_entrants", F.col("presencial_entrants") + F.col("ead_entrants")
                ),
            }
        )
    )


def portfolio_snapshot(state: DataFrame, table: str, buckets: int | None = None) -> DataFrame:
    return materialize(state, table, partition="census_year", cluster=PORTFOLIO, buckets=buckets)


def modality_transitions(state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """State in one year and the year before, with entry and exit.

    Each portfolio row looks one year back and one year ahead in its own
    series. A row without a successor also reports its exit in the year
    after, which is what a full outer self-join would add.
    """
    carried = ["cine_label_name", "modality_state", "presencial_seats", "ead_seats", "ead_seat_share"]
    year = "census_year"
    neighbours = state.select(
        year, *PORTFOLIO, *carried,
        present_in_year(PORTFOLIO, year, -1).alias("_had"),
        present_in_year(PORTFOLIO, year, 1).alias("_has_next"),
        *[in_year(F.col(c), PORTFOLIO, year, -1).alias(f"_previous_{c}") for c in carried],
    )

    def row(year_value, now, before):
        names = {
            "cine_label_name": F.coalesce(now("cine_label_name"), before("cine_label_name")),
            "previous_state": F.coalesce(before("modality_state"), F.lit(ABSENT)),
            "current_state": F.coalesce(now("modality_state"), F.lit(ABSENT)),
        }
        for measure in ("presencial_seats", "ead_seats", "ead_seat_share"):
            names[f"previous_{measure}"] = before(measure)
            names[f"current_{measure}"] = now(measure)
        return F.struct(
            year_value.cast("smallint").alias(year), *[c.alias(n) for n, c in names.items()]
        )

    def absent(name):
        return F.lit(None).cast(state.schema[name].dataType)

    entered = row(
        F.col(year), F.col, lambda name: F.when(F.col("_had"), F.col(f"_previous_{name}"))
    )
    left = row(F.col(year) + 1, absent, F.col)
    rows = F.when(F.col("_has_next"), F.array(entered)).otherwise(F.array(entered, left))
    reported = (
        "cine_label_name", "previous_state", "current_state",
        "previous_presencial_seats", "current_presencial_seats",
        "previous_ead_seats", "current_ead_seats",
        "previous_ead_seat_share", "current_ead_seat_share",
    )
    paired = neighbours.select(*PORTFOLIO, F.explode(rows).alias("_row")).select(
        F.col("_row.census_year"), *PORTFOLIO, *[F.col(f"_row.{c}") for c in reported]
    )
    return paired.where(
        (F.col(year) > first_year(snapshot)) & (F.col(year) <= last_year(snapshot))
    ).withColumns(
        {
            "transition": F.concat("previous_state", F.lit(ARROW), "current_state"),
            "state_changed": ~F.col("previous_state").eqNullSafe(F.col("current_state")),
        }
    )


def modality_dependency(snapshot: DataFrame) -> DataFrame:
    """How far each field relies on distance supply, by year."""

    def share(measure):
        return safe_ratio(F.coalesce(sum_where(_modality(2), measure), F.lit(0)), F.sum(measure))

    return (
        snapshot.where(F.col("cine_label_code").isNotNull())
        .groupBy("census_year", "cine_label_code")
        .agg(
            F.max("cine_label_name").alias("cine_label_name"),
            sum_where(_modality(1), "offered_seats").alias("presencial_seats"),
            sum_where(_modality(2), "offered_seats").alias("ead_seats"),
            sum_where(_modality(1), "entrants").alias("presencial_entrants"),
            sum_where(_modality(2), "entrants").alias("ead_entrants"),
            share("offered_seats").alias("ead_seat_share"),
            share("entrants").alias("ead_entrant_share"),
        )
    )


def national_modality_shares(snapshot: DataFrame, middle: int = 5) -> DataFrame:
    """Distance shares in the first year, some years on, and the last."""
    year = F.col("census_year")
    first, last = first_year(snapshot), last_year(snapshot)

    def share(measure):
        return safe_ratio(sum_where(_modality(2), measure), F.sum(measure))

    return (
        snapshot.where((year == first) | (year == first + middle) | (year == last))
        .groupBy("census_year")
        .agg(
            *[F.sum(m).alias(m) for m in ("offered_seats", "entrants", "enrollments")],
            share("offered_seats").alias("ead_seat_share"),
            share("entrants").alias("ead_entrant_share"),
            share("enrollments").alias("ead_enrollment_share"),
        )
        .orderBy("census_year")
    )


def portfolio_state_counts(state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Portfolios by state at both ends of the series."""
    year = F.col("census_year")
    return (
        state.where((year == first_year(snapshot)) | (year == last_year(snapshot)))
        .groupBy("census_year", "modality_state")
        .agg(F.count(F.lit(1)).alias("institution_fields"))
        .orderBy("census_year", "modality_state")
    )


def latest_transition_counts(transitions: DataFrame, snapshot: DataFrame) -> DataFrame:
    return (
        transitions.where(F.col("census_year") == last_year(snapshot))
        .groupBy("transition")
        .agg(F.count(F.lit(1)).alias("institution_fields"))
        .orderBy(F.desc("institution_fields"), "transition")
    )


def surviving_panel(state: DataFrame, snapshot: DataFrame, year: int | None = None) -> DataFrame:
    """Portfolios present in the first and the last (or a given) year.

    Counts those whose distance seats rose while on-site seats fell, and
    correlates the two changes. The two years meet in one aggregation.
    """
    start = first_year(snapshot)
    end = F.lit(year) if year is not None else last_year(snapshot)
    at_start, at_end = F.col("census_year") == start, F.col("census_year") == end
    pairs = (
        state.where((at_start | at_end) & F.col("institution_id").isNotNull())
        .groupBy(*PORTFOLIO)
        .agg(
            F.count_if(at_start).alias("_at_start"),
            F.count_if(at_end).alias("_at_end"),
            (max_where(at_end, "ead_seats") - max_where(at_start, "ead_seats")).alias("_distance"),
            (max_where(at_end, "presencial_seats") - max_where(at_start, "presencial_seats")).alias(
                "_on_site"
            ),
        )
        .where("_at_start > 0 and _at_end > 0")
    )
    substituted = F.count_if((F.col("_distance") > 0) & (F.col("_on_site") < 0))
    return pairs.agg(
        F.count(F.lit(1)).alias("surviving_institution_fields"),
        substituted.alias("ead_up_presencial_down"),
        safe_ratio(substituted, F.count(F.lit(1))).alias("substitution_signal_share"),
        correlation(F.col("_distance"), F.col("_on_site")).alias("seat_change_correlation"),
    )


def largest_fields(dependency: DataFrame, snapshot: DataFrame, n: int = 15) -> DataFrame:
    """The fields with most seats in the last year and their conversion gap."""
    seats = F.coalesce("presencial_seats", F.lit(0)) + F.coalesce("ead_seats", F.lit(0))
    return (
        dependency.where(F.col("census_year") == last_year(snapshot))
        .select(
            "cine_label_code", "cine_label_name", seats.alias("offered_seats"),
            "ead_seat_share", "ead_entrant_share",
            (F.col("ead_seat_share") - F.col("ead_entrant_share")).alias("conversion_gap"),
        )
        .orderBy(F.desc("offered_seats"), "cine_label_code")
        .limit(n)
    )
