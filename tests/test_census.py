"""Known values of the small census through every product."""

import pytest
from pyspark.sql import functions as F

from supplypanel.operators.comparison import fingerprint
from supplypanel.plans import checks, completion, mart, panel, portfolio, reports, risk, staging
from tests import census_fixture as fixture
from tests.census_fixture import only


@pytest.fixture(scope="module")
def raw(spark):
    return fixture.raw_courses(spark).cache()


@pytest.fixture(scope="module")
def courses(raw):
    return staging.stage_courses(raw)


@pytest.fixture(scope="module")
def institutions(spark):
    return staging.stage_institutions(fixture.raw_institutions(spark))


@pytest.fixture(scope="module")
def supply(courses):
    return mart.course_supply(courses)


@pytest.fixture(scope="module")
def snapshot(supply):
    return mart.supply_snapshot(supply, "census_snapshot", buckets=2)


@pytest.fixture(scope="module")
def features(snapshot):
    return risk.offer_features(snapshot).cache()


def offer(course, modality=1, institution=7):
    return {"institution_id": institution, "course_id": course, "teaching_modality": modality}


def test_distance_capacity_and_students_meet_once(supply):
    row = only(supply, census_year=2024, institution_id=8, course_id=41)
    assert (row.offered_seats, row.entrants, row.enrollments) == (900, 135, 400)
    assert (row.capacity_source_row_count, row.student_source_row_count) == (1, 2)


def test_supply_abroad_is_never_read(supply):
    measures = ["offered_seats", "applications", "entrants", "enrollments", "graduates"]
    assert supply.where(" or ".join(f"{m} = 777" for m in measures)).isEmpty()


def test_misspelt_edition_keeps_its_fields(courses):
    edition = courses.where("census_year = 2019")
    assert edition.where("cine_label_code is null").isEmpty()
    assert edition.select("cine_label_code").distinct().count() == 2


def test_labels(snapshot):
    labels = risk.deterioration_labels(snapshot, last_year=2024)
    assert only(labels, reference_year=2020, **offer(32)).deteriorated is True
    assert only(labels, reference_year=2017, **offer(33)).disappeared_from_census is True
    assert only(labels, reference_year=2016, **offer(33)).deteriorated is False
    assert labels.where("reference_year = 2024 and deteriorated is not null").isEmpty()


def test_features_look_back_only(features):
    assert only(features, reference_year=2016, **offer(31)).years_observed_to_date == 1
    assert only(features, reference_year=2020, **offer(31)).years_observed_to_date == 5
    assert only(features, reference_year=2022, **offer(31)).occupancy_rate_lag1 == 45 / 50
    assert only(features, reference_year=2018, **offer(33)).occupancy_rate_lag1 == 8 / 40
    assert features.where("reference_year = 2019 and course_id = 33").isEmpty()


def test_streaks(snapshot, features):
    persistence = panel.course_persistence(panel.supply_panel(snapshot))
    assert only(persistence, **offer(32)).current_low_occupancy_streak == 4
    assert only(persistence, **offer(31)).current_low_occupancy_streak == 0
    assert only(features, reference_year=2020, **offer(32)).current_low_occupancy_streak == 1


def test_unmeasurable_is_not_low(snapshot):
    table = panel.supply_panel(snapshot)
    assert table.where("is_low_occupancy and not has_measurable_occupancy").isEmpty()


def test_transition_to_both_modalities(snapshot):
    state = portfolio.modality_portfolio_state(snapshot)
    row = only(
        portfolio.modality_transitions(state, snapshot),
        census_year=2024, institution_id=7, cine_label_code="K1",
    )
    assert (row.previous_state, row.current_state) == ("presencial", "dual")
    assert row.transition == "presencial → dual"


def test_exit_is_reported_the_year_after(snapshot):
    state = portfolio.modality_portfolio_state(snapshot)
    row = only(
        portfolio.modality_transitions(state, snapshot),
        census_year=2019, institution_id=7, cine_label_code="K3",
    )
    assert (row.previous_state, row.current_state) == ("presencial", "ausente")
    assert row.current_presencial_seats is None and row.previous_presencial_seats == 40


def test_lagged_completion(snapshot):
    row = only(completion.lagged_completion(snapshot), census_year=2022, lag_years=4, **offer(31))
    assert row.lagged_completion_ratio == 26 / 42


def test_reloading_the_snapshot_changes_nothing(spark, supply, snapshot):
    spark.table("census_snapshot").createOrReplaceTempView("depends_on_snapshot")
    before = fingerprint(snapshot, "s").first()
    again = mart.supply_snapshot(supply, "census_snapshot", buckets=2)
    assert fingerprint(again, "s").first() == before
    assert spark.table("depends_on_snapshot").count() == before.row_count


def test_single_edition_gets_context_from_institutions(raw, spark):
    edition = staging.stage_courses(raw.where("nu_ano_censo = '2024'"), single_edition=True)
    assert "education_network" not in edition.columns
    institutions = fixture.raw_institutions(spark).withColumn("tp_rede", F.lit("2"))
    staged = staging.stage_institutions(institutions, single_edition=True)
    row = only(
        mart.course_sustainability(mart.course_supply(edition), staged),
        institution_id=8, course_id=41,
    )
    assert (row.education_network, row.institution_name) == (2, "Escola Oito")
    assert row.seat_occupancy_rate == 0.15


def test_unregistered_institutions_keep_their_offers(supply, institutions):
    """No institution is registered for 2020: its offers stay, without a name."""
    found = mart.course_sustainability(supply, institutions)
    assert found.count() == supply.count()
    assert found.where("census_year = 2020 and institution_name is not null").isEmpty()
    assert only(found, census_year=2024, **offer(31)).institution_name == "Escola Sete"


def test_reports(snapshot, institutions):
    top = reports.top_unconverted_institutions(snapshot, institutions, 2024).collect()
    assert [(r.institution_id, r.unconverted) for r in top] == [(8, 765), (7, 92)]
    shares = reports.unconverted_concentration(snapshot, 2024).collect()
    assert [(r.position, r.cumulative_share) for r in shares] == [(1, 765 / 857)]
    totals = reports.capacity_totals(snapshot, 2024).first()
    assert (totals.institutions, totals.unconverted, totals.seats) == (2, 857, 1070)


def test_all_checks_pass_but_the_editions_left_empty(spark, raw, courses, institutions, snapshot, supply, features):
    state = portfolio.modality_portfolio_state(snapshot)
    table = panel.supply_panel(snapshot)
    edition = mart.course_supply(staging.stage_courses(raw.where("nu_ano_censo = '2024'")))
    found = [
        checks.mart_checks(supply),
        checks.raw_checks(raw, fixture.raw_institutions(spark), 2014, 2024, 2020),
        checks.staging_checks(courses, institutions, 2014, 2024, 2020),
        checks.persistence_checks(
            supply, snapshot, edition, table, panel.course_persistence(table), 2014, 2024
        ),
        checks.feature_checks(
            snapshot, features, risk.deterioration_labels(snapshot, 2024),
            risk.training_set(snapshot), 2014, 2024, cut=2019,
        ),
        checks.modality_checks(
            snapshot, state, portfolio.modality_transitions(state, snapshot),
            portfolio.modality_dependency(snapshot), completion.lagged_completion(snapshot),
        ),
    ]
    violations = {
        r.check_name: r.violations for part in found for r in part.collect() if r.violations
    }
    assert violations == {"missing_edition_count": 2}


def test_checks_see_what_is_wrong(courses, snapshot, features):
    dirty = courses.withColumn(
        "education_network", F.when(F.col("census_year") != 2024, F.col("education_network"))
    ).withColumn("entrants", F.when(F.col("dimension_type") != 3, F.col("entrants")))
    institutions = courses.select("census_year", "institution_id")
    counts = {
        r.check_name: r.violations
        for r in checks.staging_checks(dirty, institutions, 2014, 2024, 2020).collect()
    }
    assert counts["null_network_count"] == 7
    assert counts["unexpected_blank_convention_count"] == 1
    assert counts["duplicate_institution_count"] > 0
    peeking = features.withColumn("years_observed_to_date", F.col("years_observed_to_date") + 1)
    assert checks.leakage(snapshot, features, 2018).isEmpty()
    assert checks.leakage(snapshot, peeking, 2018).count() == 3


def test_null_keys_never_join(spark, courses):
    """A capacity row and a student row with a null key stay apart."""
    lost = courses.where("census_year = 2024 and course_id = 42").withColumn(
        "course_id", F.lit(None).cast("bigint")
    )
    rows = mart.course_supply(lost).orderBy("offered_seats").collect()
    assert [(r.offered_seats, r.entrants) for r in rows] == [(None, 30), (120, None)]
