"""Random tables against joins written out in SQL: null keys, gaps, hot keys."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from supplypanel.plans import mart, portfolio, risk
from tests.compare import _normal

COURSE = (
    "census_year smallint, institution_id int, course_id bigint, teaching_modality smallint, "
    "dimension_type smallint, academic_level smallint, course_name string, cine_label_code string, "
    "cine_label_name string, education_network smallint, administrative_category smallint, "
    "course_count bigint, offered_seats bigint, applications bigint, entrants bigint, "
    "enrollments bigint, graduates bigint"
)


def same(spark_df, sql, **tables):
    connection = duckdb.connect()
    for name, rows in tables.items():
        connection.register(name, rows)
    result = connection.execute(sql)
    want = _normal([d[0] for d in result.description], result.fetchall())
    got = _normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    assert got[0] == want[0]
    assert got[1] == want[1]


def maybe(generator, values, share):
    return [None if generator.random() < share else int(v) for v in values]


@pytest.mark.parametrize("seed", [1, 2])
def test_reconciliation_is_the_full_outer_join(spark, seed):
    g = np.random.default_rng(seed)
    n = 600
    offers = np.where(g.random(n) < 0.35, 0, g.integers(0, 12, n))  # one offer holds a third
    rows = list(
        zip(
            maybe(g, g.integers(2014, 2017, n), 0.03), maybe(g, offers % 3, 0.03),
            maybe(g, offers, 0.03), maybe(g, 1 + offers % 2, 0.03), maybe(g, g.integers(1, 5, n), 0.02),
            maybe(g, 1 + (g.random(n) < 0.1), 0.02), [f"c{i}" for i in g.integers(0, 3, n)],
            [None if i == 0 else f"f{i}" for i in g.integers(0, 3, n)], ["x"] * n,
            maybe(g, g.integers(1, 3, n), 0.1), maybe(g, g.integers(1, 5, n), 0.1),
            *[maybe(g, g.integers(0, 50, n), 0.2) for _ in range(6)],
        )
    )
    courses = spark.createDataFrame(rows, COURSE)
    names = [f.split()[0] for f in COURSE.split(", ")]
    frame = pd.DataFrame(rows, columns=names).astype(
        {c: "Int64" for c in names if c not in ("course_name", "cine_label_code", "cine_label_name")}
    )
    keys = "census_year, institution_id, course_id, teaching_modality"
    labels = "course_name, cine_label_code, cine_label_name, education_network, administrative_category"
    seats = ", ".join(f"sum({c}) AS {c}" for c in mart.CAPACITY)
    people = ", ".join(f"sum({c}) AS {c}" for c in mart.STUDENTS)
    marks = ", ".join(f"max({c}) AS {c}" for c in labels.split(", "))
    sql = f"""
        WITH part AS (SELECT * FROM courses WHERE academic_level = 1),
             a AS (SELECT {keys}, {marks}, {seats}, {people}, count(*) AS capacity_source_row_count,
                          count(*) AS student_source_row_count FROM part WHERE dimension_type = 1 GROUP BY {keys}),
             b AS (SELECT {keys}, {people}, count(*) AS student_source_row_count
                   FROM part WHERE dimension_type = 2 GROUP BY {keys}),
             c AS (SELECT {keys}, {marks}, {seats}, count(*) AS capacity_source_row_count
                   FROM part WHERE dimension_type = 3 GROUP BY {keys})
        SELECT {keys}, {labels}, {', '.join(mart.CAPACITY + mart.STUDENTS)},
               capacity_source_row_count, student_source_row_count FROM c FULL JOIN b USING ({keys})
        UNION ALL BY NAME SELECT * FROM a"""
    same(mart.course_supply(courses, unique=False), sql, courses=frame)
    same(mart.course_supply(courses, buckets=3, unique=False), sql, courses=frame)


@pytest.fixture(scope="module")
def series(spark):
    """Offers with gaps in their years and unknown values, in no order."""
    g = np.random.default_rng(5)
    rows = []
    for offer in range(80):
        for year in range(2014, 2025):
            if g.random() < 0.6:
                seats, entrants, enrolled, graduates, applied = g.integers(0, 60, 5)
                rows.append(
                    (year, 1 if offer < 27 else offer % 7, offer, 1 + offer % 2, f"f{offer % 4}",
                     *maybe(g, (seats * (g.random() > 0.2), entrants, enrolled, graduates, applied), 0.1))
                )
    g.shuffle(rows)
    names = ["census_year", "institution_id", "course_id", "teaching_modality", "cine_label_code",
             "offered_seats", "entrants", "enrollments", "graduates", "applications"]
    rows = [tuple(None if v is None else v if isinstance(v, str) else int(v) for v in r) for r in rows]
    schema = ("census_year smallint, institution_id int, course_id bigint, teaching_modality smallint, "
              "cine_label_code string, offered_seats bigint, entrants bigint, enrollments bigint, "
              "graduates bigint, applications bigint")
    df = spark.createDataFrame(rows, schema).withColumns(
        {"cine_label_name": F.col("cine_label_code"), "education_network": F.lit(1),
         "administrative_category": F.lit(4), "course_name": F.lit("c")}
    ).cache()
    frame = pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names if c != "cine_label_code"})
    return df, frame


ON_OFFER = """a.institution_id = b.institution_id AND a.course_id = b.course_id
              AND a.teaching_modality = b.teaching_modality"""


def test_labels_are_the_join_two_years_on(series):
    df, frame = series
    same(
        risk.deterioration_labels(df, 2024).select(
            "course_id", "reference_year", "horizon_enrollments", "disappeared_from_census", "deteriorated"
        ),
        f"""SELECT a.course_id, a.census_year AS reference_year, b.enrollments AS horizon_enrollments,
                   b.course_id IS NULL AS disappeared_from_census,
                   CASE WHEN a.census_year > 2022 THEN NULL WHEN b.course_id IS NULL THEN TRUE
                        WHEN a.enrollments <> 0 THEN 2 * b.enrollments < a.enrollments END AS deteriorated
            FROM s AS a LEFT JOIN s AS b ON {ON_OFFER} AND b.census_year - a.census_year = 2""",
        s=frame,
    )


def test_lags_are_joins_on_exact_years(series):
    df, frame = series
    same(
        risk.offer_features(df).select("course_id", "reference_year", "enrollment_growth_2y", "seat_growth_1y"),
        f"""SELECT a.course_id, a.census_year AS reference_year,
                   CAST(a.enrollments AS DOUBLE) / NULLIF(c.enrollments, 0) - 1 AS enrollment_growth_2y,
                   CAST(a.offered_seats AS DOUBLE) / NULLIF(b.offered_seats, 0) - 1 AS seat_growth_1y
            FROM s AS a LEFT JOIN s AS b ON {ON_OFFER} AND a.census_year - b.census_year = 1
            LEFT JOIN s AS c ON {ON_OFFER.replace('b.', 'c.')} AND a.census_year - c.census_year = 2""",
        s=frame,
    )


def test_features_do_not_change_when_the_future_is_removed(series):
    """Features of every reference year equal those of the series cut there."""
    df, _ = series
    whole = risk.offer_features(df).cache()
    for cut in (2016, 2020):
        now = risk.offer_features(df.where(F.col("census_year") <= cut)).where(F.col("reference_year") == cut)
        then = whole.where(F.col("reference_year") == cut)
        assert now.exceptAll(then).isEmpty() and then.exceptAll(now).isEmpty()


def test_transitions_are_the_full_join_of_neighbouring_years(series):
    df, _ = series
    state = portfolio.modality_portfolio_state(df)
    rows = state.toPandas()
    same(
        portfolio.modality_transitions(state, df).select(
            "census_year", "institution_id", "cine_label_code", "previous_state", "current_state",
            "previous_ead_seats", "current_ead_seats",
        ),
        """SELECT coalesce(n.census_year, p.census_year + 1) AS census_year,
                  coalesce(n.institution_id, p.institution_id) AS institution_id,
                  coalesce(n.cine_label_code, p.cine_label_code) AS cine_label_code,
                  coalesce(p.modality_state, 'ausente') AS previous_state,
                  coalesce(n.modality_state, 'ausente') AS current_state,
                  p.ead_seats AS previous_ead_seats, n.ead_seats AS current_ead_seats
           FROM state AS n FULL JOIN state AS p ON n.census_year = p.census_year + 1
            AND n.institution_id = p.institution_id AND n.cine_label_code = p.cine_label_code
           WHERE coalesce(n.census_year, p.census_year + 1) BETWEEN 2015 AND 2024""",
        state=rows,
    )
