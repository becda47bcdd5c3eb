"""DuckDB SQL that each registered query must agree with.

Written apart from the library: self-joins stand where the library uses frames,
row-by-row ranks where it uses histograms, and plain unions where it explodes.
Named subqueries are shared and pulled in by name.
"""

from __future__ import annotations

import re

FIRST, LAST = 1995, 2001
TRAIN_YEARS = (1995, 1998)
ZERO_FROM = 1998
TRAIN, TEST = (1995, 1998), (1999, 1999)

PARTS: dict[str, str] = {}

PARTS["line"] = """
SELECT CAST(year(l_shipdate) AS BIGINT) AS y,
       CASE WHEN l_linestatus = 'F' THEN 1 WHEN l_returnflag = 'A' THEN 2
            WHEN l_returnflag = 'N' THEN 3 ELSE 4 END AS dim,
       CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS modality,
       l_suppkey AS inst, l_partkey % 30 AS course, l_partkey % 15 AS field,
       l_orderkey % 1000 AS town, l_linenumber AS ln,
       CAST(l_quantity AS BIGINT) AS q,
       CAST(floor(l_extendedprice / 1000) AS BIGINT) AS enr,
       CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t
FROM lineitem
"""

PARTS["raw"] = f"""
SELECT CAST(y AS VARCHAR) AS nu_ano_censo, CAST(dim AS VARCHAR) AS tp_dimensao,
       CASE WHEN dim = 3 THEN '' ELSE CAST(town % 5 + 1 AS VARCHAR) END AS co_regiao,
       CASE WHEN dim = 3 THEN '' ELSE CAST(town % 27 + 11 AS VARCHAR) END AS co_uf,
       CASE WHEN dim = 3 THEN '' ELSE CAST(town AS VARCHAR) END AS co_municipio,
       CAST(inst AS VARCHAR) AS co_ies, CAST(course AS VARCHAR) AS co_curso,
       'Gestão ' || course AS no_curso, 'F' || field AS co_cine_rotulo, 'Área ' || field AS no_cine_rotulo,
       CAST(modality AS VARCHAR) AS tp_modalidade_ensino,
       CASE WHEN t = 8 THEN '2' ELSE '1' END AS tp_nivel_academico,
       CAST(course % 3 + 1 AS VARCHAR) AS tp_grau_academico,
       CAST(inst % 2 + 1 AS VARCHAR) AS tp_rede,
       CAST(inst % 5 + 1 AS VARCHAR) AS tp_categoria_administrativa,
       CAST(inst % 4 + 1 AS VARCHAR) AS tp_organizacao_academica,
       CASE WHEN dim IN (1, 3) THEN '1' ELSE na END AS qt_curso,
       CASE WHEN dim IN (1, 3) THEN CAST(CASE WHEN (inst + course + y) % 17 = 0 THEN 0 ELSE q END AS VARCHAR)
            ELSE na END AS qt_vg_total,
       CASE WHEN dim IN (1, 3) THEN CAST(q + 3 * ln AS VARCHAR) ELSE na END AS qt_inscrito_total,
       CASE WHEN dim IN (1, 2) THEN CAST(q * d // 10 AS VARCHAR) ELSE na END AS qt_ing,
       CASE WHEN dim IN (1, 2) THEN CAST(enr AS VARCHAR) ELSE na END AS qt_mat,
       CASE WHEN dim IN (1, 2) THEN CAST(enr * t // 10 AS VARCHAR) ELSE na END AS qt_conc
FROM (SELECT *, CASE WHEN y < {ZERO_FROM} THEN '' ELSE '0' END AS na FROM line)
"""

PARTS["raw_inst"] = f"""
SELECT CAST(y.year AS VARCHAR) AS nu_ano_censo, CAST(s_suppkey AS VARCHAR) AS co_ies, s_name AS no_ies,
       'S' || s_suppkey AS sg_ies, CAST(s_suppkey % 4 + 1 AS VARCHAR) AS tp_organizacao_academica,
       CAST(s_suppkey % 2 + 1 AS VARCHAR) AS tp_rede,
       CAST(s_suppkey % 5 + 1 AS VARCHAR) AS tp_categoria_administrativa,
       CAST(s_suppkey % 1000 AS VARCHAR) AS co_municipio_ies, n_name AS sg_uf_ies
FROM supplier JOIN nation ON s_nationkey = n_nationkey
CROSS JOIN (SELECT unnest(range({FIRST}, {LAST + 1})) AS year) AS y
"""

_COURSE_TYPES = [
    ("nu_ano_censo", "census_year", "SMALLINT"), ("tp_dimensao", "dimension_type", "SMALLINT"),
    ("co_regiao", "region_code", "SMALLINT"), ("co_uf", "state_code", "SMALLINT"),
    ("co_municipio", "municipality_code", "INTEGER"), ("co_ies", "institution_id", "INTEGER"),
    ("co_curso", "course_id", "BIGINT"), ("no_curso", "course_name", "VARCHAR"),
    ("co_cine_rotulo", "cine_label_code", "VARCHAR"), ("no_cine_rotulo", "cine_label_name", "VARCHAR"),
    ("tp_modalidade_ensino", "teaching_modality", "SMALLINT"),
    ("tp_nivel_academico", "academic_level", "SMALLINT"),
    ("tp_grau_academico", "academic_degree", "SMALLINT"), ("tp_rede", "education_network", "SMALLINT"),
    ("tp_categoria_administrativa", "administrative_category", "SMALLINT"),
    ("tp_organizacao_academica", "academic_organization", "SMALLINT"),
    ("qt_curso", "course_count", "BIGINT"), ("qt_vg_total", "offered_seats", "BIGINT"),
    ("qt_inscrito_total", "applications", "BIGINT"), ("qt_ing", "entrants", "BIGINT"),
    ("qt_mat", "enrollments", "BIGINT"), ("qt_conc", "graduates", "BIGINT"),
]
_INST_TYPES = [
    ("nu_ano_censo", "census_year", "SMALLINT"), ("co_ies", "institution_id", "INTEGER"),
    ("no_ies", "institution_name", "VARCHAR"), ("sg_ies", "institution_abbreviation", "VARCHAR"),
    ("tp_organizacao_academica", "academic_organization", "SMALLINT"),
    ("tp_categoria_administrativa", "administrative_category", "SMALLINT"),
    ("co_municipio_ies", "institution_municipality_code", "INTEGER"),
    ("sg_uf_ies", "institution_state", "VARCHAR"),
]


def _cast_all(columns, source):
    picked = ", ".join(f"CAST(NULLIF(TRIM({r}), '') AS {t}) AS {n}" for r, n, t in columns)
    return f"SELECT {picked} FROM {source}"


PARTS["typed"] = _cast_all(_COURSE_TYPES, "raw")
PARTS["inst"] = _cast_all(_INST_TYPES, "raw_inst")

_KEY = "census_year, institution_id, course_id, teaching_modality"
_OFFER = "institution_id, course_id, teaching_modality"


def _big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


PARTS["seats_side"] = f"""
SELECT {_KEY}, dimension_type = 1 AS on_site, max(course_name) AS course_name,
       max(cine_label_code) AS cine_label_code, max(cine_label_name) AS cine_label_name,
       max(education_network) AS education_network, max(administrative_category) AS administrative_category,
       {_big('sum(course_count)', 'course_count')}, {_big('sum(offered_seats)', 'offered_seats')},
       {_big('sum(applications)', 'applications')}, count(*) AS capacity_source_row_count
FROM typed WHERE academic_level = 1 AND dimension_type IN (1, 3) GROUP BY ALL
"""
PARTS["people_side"] = f"""
SELECT {_KEY}, dimension_type = 1 AS on_site, {_big('sum(entrants)', 'entrants')},
       {_big('sum(enrollments)', 'enrollments')}, {_big('sum(graduates)', 'graduates')},
       count(*) AS student_source_row_count
FROM typed WHERE academic_level = 1 AND dimension_type IN (1, 2) GROUP BY ALL
"""
PARTS["supply"] = f"""
SELECT {_KEY}, course_name, cine_label_code, cine_label_name, education_network, administrative_category,
       course_count, offered_seats, applications, entrants, enrollments, graduates,
       capacity_source_row_count, student_source_row_count
FROM seats_side FULL JOIN people_side USING ({_KEY}, on_site)
"""

# Ratios: NULLIF keeps the division defined; casting first makes it the same double division.
def _ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)"


# What the edits and the reload of editions are checked on.
PARTS["edited"] = f"""
SELECT * REPLACE (
    CASE WHEN census_year = {LAST} AND institution_id % 7 = 3 AND course_id % 5 = 1 THEN coalesce(enrollments, 0) + 1 ELSE enrollments END AS enrollments,
    CASE WHEN census_year = {LAST} AND institution_id % 7 = 3 AND course_id % 4 = 2 THEN 'outro' ELSE course_name END AS course_name)
FROM supply WHERE NOT (census_year = {FIRST} AND course_id % 9 = 4)
UNION ALL
SELECT * REPLACE (course_id + 1000000000 AS course_id) FROM supply WHERE census_year = {FIRST} AND course_id % 9 = 5
"""
PARTS["inst_single"] = _cast_all([*_INST_TYPES, ("tp_rede", "education_network", "SMALLINT")], "raw_inst")
PARTS["snapshot_rows"] = "SELECT * FROM supply"
PARTS["edition_rows"] = f"SELECT * FROM supply WHERE census_year = {LAST}"
PARTS["panel"] = f"""
SELECT {_KEY}, course_name, education_network, administrative_category, offered_seats, applications,
       entrants, enrollments, graduates, {_ratio('entrants', 'offered_seats')} AS seat_occupancy_rate,
       offered_seats > 0 AS has_measurable_occupancy,
       offered_seats > 0 AND {_ratio('entrants', 'offered_seats')} < 0.25 AS is_low_occupancy
FROM supply
"""
PARTS["usable"] = "SELECT * FROM panel WHERE has_measurable_occupancy"
PARTS["broken"] = f"""
SELECT {_OFFER}, max(census_year) AS last_break FROM usable
WHERE is_low_occupancy IS NOT TRUE GROUP BY ALL
"""
PARTS["persistence"] = f"""
SELECT {_OFFER}, min(census_year) AS first_year, max(census_year) AS last_year,
       count(*) AS measurable_years, count(*) FILTER (is_low_occupancy) AS low_occupancy_years,
       count(*) FILTER (census_year > coalesce(last_break, 0)) AS current_low_occupancy_streak,
       {_ratio('count(*) FILTER (is_low_occupancy)', 'count(*)')} AS low_occupancy_share,
       avg(seat_occupancy_rate) AS mean_occupancy_rate, stddev_samp(seat_occupancy_rate) AS occupancy_stddev,
       {_big('sum(offered_seats - entrants)', 'total_unconverted_capacity')},
       stddev_samp(entrants) / NULLIF(avg(entrants), 0) AS demand_volatility,
       CAST(max(census_year) - min(census_year) + 1 AS INTEGER) AS calendar_span,
       count(*) < max(census_year) - min(census_year) + 1 AS has_gaps
FROM usable LEFT JOIN broken USING ({_OFFER}) GROUP BY {_OFFER}
"""

PARTS["labels"] = f"""
SELECT a.institution_id, a.course_id, a.teaching_modality, a.census_year AS reference_year,
       a.enrollments AS base_enrollments, a.entrants AS base_entrants, a.offered_seats AS base_offered_seats,
       b.enrollments AS horizon_enrollments, b.census_year IS NULL AS disappeared_from_census,
       a.census_year <= {LAST - 2} AS label_is_observable,
       CASE WHEN a.census_year > {LAST - 2} THEN NULL
            WHEN b.census_year IS NULL THEN TRUE
            WHEN a.enrollments > 0 THEN b.enrollments < a.enrollments * 0.5 END AS deteriorated
FROM supply AS a LEFT JOIN supply AS b
  ON a.institution_id = b.institution_id AND a.course_id = b.course_id
 AND a.teaching_modality = b.teaching_modality AND a.census_year + 2 = b.census_year
"""
PARTS["inst_year"] = """
SELECT institution_id, census_year, count(*) AS institution_offer_count,
       sum(power(share, 2)) AS institution_enrollment_hhi
FROM (SELECT institution_id, census_year,
             enrollments / NULLIF(CAST(sum(enrollments) OVER (PARTITION BY institution_id, census_year) AS DOUBLE), 0) AS share
      FROM supply)
GROUP BY ALL
"""
# History by self-join: every row meets the rows of its offer up to its own year.
PARTS["history"] = """
SELECT now.institution_id, now.course_id, now.teaching_modality, now.census_year,
       count(*) AS seen, count(*) FILTER (past.has_measurable_occupancy) AS usable_years,
       count(*) FILTER (past.is_low_occupancy) AS low_years,
       avg(past.seat_occupancy_rate) FILTER (WHERE past.has_measurable_occupancy) AS mean_occ,
       stddev_samp(past.entrants) / NULLIF(avg(past.entrants), 0) AS volatility,
       max(past.census_year) FILTER (WHERE past.has_measurable_occupancy AND past.is_low_occupancy IS NOT TRUE) AS last_fine
FROM panel AS now JOIN panel AS past
  ON now.institution_id = past.institution_id AND now.course_id = past.course_id
 AND now.teaching_modality = past.teaching_modality AND past.census_year <= now.census_year
GROUP BY ALL
"""
PARTS["streaks"] = """
SELECT h.institution_id, h.course_id, h.teaching_modality, h.census_year,
       count(*) FILTER (p.has_measurable_occupancy AND p.census_year > coalesce(h.last_fine, 0)) AS streak
FROM history AS h JOIN panel AS p
  ON h.institution_id = p.institution_id AND h.course_id = p.course_id
 AND h.teaching_modality = p.teaching_modality AND p.census_year <= h.census_year
GROUP BY ALL
"""
PARTS["features"] = f"""
SELECT n.institution_id, n.course_id, n.teaching_modality, n.census_year AS reference_year,
       n.education_network, n.administrative_category, n.offered_seats, n.entrants, n.enrollments,
       n.seat_occupancy_rate AS occupancy_rate, coalesce(n.has_measurable_occupancy, FALSE) AS has_measurable_occupancy,
       {_ratio('n.applications', 'n.offered_seats')} AS applications_per_seat,
       {_ratio('n.graduates', 'n.enrollments')} AS graduation_intensity,
       h.seen AS years_observed_to_date, h.usable_years AS measurable_years_to_date,
       h.low_years AS low_occupancy_years_to_date,
       {_ratio('h.low_years', 'h.usable_years')} AS low_occupancy_share_to_date,
       s.streak AS current_low_occupancy_streak,
       round(h.mean_occ, 10) AS mean_occupancy_to_date, round(h.volatility, 10) AS demand_volatility_to_date,
       p1.seat_occupancy_rate AS occupancy_rate_lag1,
       n.seat_occupancy_rate - p1.seat_occupancy_rate AS occupancy_change_1y,
       {_ratio('n.enrollments', 'p1.enrollments')} - 1 AS enrollment_growth_1y,
       {_ratio('n.offered_seats', 'p1.offered_seats')} - 1 AS seat_growth_1y,
       {_ratio('n.enrollments', 'p2.enrollments')} - 1 AS enrollment_growth_2y,
       i.institution_offer_count, round(i.institution_enrollment_hhi, 10) AS institution_enrollment_hhi
FROM panel AS n
JOIN history AS h USING ({_OFFER}, census_year)
JOIN streaks AS s USING ({_OFFER}, census_year)
LEFT JOIN panel AS p1 ON p1.institution_id = n.institution_id AND p1.course_id = n.course_id
  AND p1.teaching_modality = n.teaching_modality AND p1.census_year + 1 = n.census_year
LEFT JOIN panel AS p2 ON p2.institution_id = n.institution_id AND p2.course_id = n.course_id
  AND p2.teaching_modality = n.teaching_modality AND p2.census_year + 2 = n.census_year
LEFT JOIN inst_year AS i ON i.institution_id = n.institution_id AND i.census_year = n.census_year
"""
PARTS["training"] = f"""
SELECT f.*, l.deteriorated, l.disappeared_from_census, l.base_enrollments, l.horizon_enrollments,
       CASE WHEN f.reference_year <= {TRAIN[1]} THEN 'treino' ELSE 'teste' END AS split
FROM features AS f JOIN labels AS l USING ({_OFFER}, reference_year)
WHERE f.reference_year BETWEEN {TRAIN[0]} AND {TEST[1]} AND l.label_is_observable
  AND l.deteriorated IS NOT NULL AND l.base_enrollments >= 20
"""

PARTS["state"] = f"""
SELECT *, CASE WHEN presencial_offers * ead_offers > 0 THEN 'dual'
               WHEN presencial_offers > 0 THEN 'presencial' ELSE 'ead' END AS modality_state,
       {_ratio('ead_seats', 'presencial_seats + ead_seats')} AS ead_seat_share,
       {_ratio('ead_entrants', 'presencial_entrants + ead_entrants')} AS ead_entrant_share
FROM (SELECT census_year, institution_id, cine_label_code, max(cine_label_name) AS cine_label_name,
             count(*) FILTER (teaching_modality = 1) AS presencial_offers, count(*) FILTER (teaching_modality = 2) AS ead_offers,
             {_big('coalesce(sum(CASE teaching_modality WHEN 1 THEN offered_seats END), 0)', 'presencial_seats')},
             {_big('coalesce(sum(CASE teaching_modality WHEN 2 THEN offered_seats END), 0)', 'ead_seats')},
             {_big('coalesce(sum(CASE teaching_modality WHEN 1 THEN entrants END), 0)', 'presencial_entrants')},
             {_big('coalesce(sum(CASE teaching_modality WHEN 2 THEN entrants END), 0)', 'ead_entrants')}
      FROM supply WHERE cine_label_code IS NOT NULL GROUP BY ALL)
"""
# Every portfolio-year that exists, or that follows one that exists.
PARTS["slots"] = """
SELECT census_year, institution_id, cine_label_code FROM state
UNION
SELECT CAST(census_year + 1 AS SMALLINT), institution_id, cine_label_code FROM state
"""
PARTS["transitions"] = """
SELECT z.census_year, z.institution_id, z.cine_label_code,
       coalesce(c.cine_label_name, p.cine_label_name) AS cine_label_name,
       coalesce(p.modality_state, 'ausente') AS previous_state,
       coalesce(c.modality_state, 'ausente') AS current_state,
       p.presencial_seats AS previous_presencial_seats, c.presencial_seats AS current_presencial_seats,
       p.ead_seats AS previous_ead_seats, c.ead_seats AS current_ead_seats,
       p.ead_seat_share AS previous_ead_seat_share, c.ead_seat_share AS current_ead_seat_share,
       concat(coalesce(p.modality_state, 'ausente'), ' → ', coalesce(c.modality_state, 'ausente')) AS transition,
       coalesce(p.modality_state, 'ausente') <> coalesce(c.modality_state, 'ausente') AS state_changed
FROM slots AS z
LEFT JOIN state AS c ON c.census_year = z.census_year AND c.institution_id = z.institution_id
  AND c.cine_label_code = z.cine_label_code
LEFT JOIN state AS p ON p.census_year + 1 = z.census_year AND p.institution_id = z.institution_id
  AND p.cine_label_code = z.cine_label_code
WHERE z.census_year > (SELECT min(census_year) FROM supply)
  AND z.census_year <= (SELECT max(census_year) FROM supply)
"""
PARTS["dependency"] = f"""
SELECT census_year, cine_label_code, max(cine_label_name) AS cine_label_name,
       {_big('sum(offered_seats) FILTER (teaching_modality = 1)', 'presencial_seats')},
       {_big('sum(offered_seats) FILTER (teaching_modality = 2)', 'ead_seats')},
       {_big('sum(entrants) FILTER (teaching_modality = 1)', 'presencial_entrants')},
       {_big('sum(entrants) FILTER (teaching_modality = 2)', 'ead_entrants')},
       {_ratio('coalesce(sum(offered_seats) FILTER (teaching_modality = 2), 0)', 'sum(offered_seats)')} AS ead_seat_share,
       {_ratio('coalesce(sum(entrants) FILTER (teaching_modality = 2), 0)', 'sum(entrants)')} AS ead_entrant_share
FROM supply WHERE cine_label_code IS NOT NULL GROUP BY census_year, cine_label_code
"""
PARTS["lagged"] = f"""
SELECT a.census_year, a.institution_id, a.course_id, a.course_name, a.cine_label_code, a.teaching_modality,
       CAST(a.census_year - b.census_year AS INTEGER) AS lag_years, b.census_year AS entrant_year,
       b.entrants AS lagged_entrants, a.graduates, b.entrants >= 20 AS is_eligible,
       {_ratio('a.graduates', 'b.entrants')} AS lagged_completion_ratio, a.graduates > b.entrants AS exceeds_one
FROM supply AS a JOIN supply AS b
  ON a.institution_id = b.institution_id AND a.course_id = b.course_id
 AND a.teaching_modality = b.teaching_modality AND a.census_year - b.census_year BETWEEN 3 AND 5
WHERE a.graduates IS NOT NULL AND b.entrants IS NOT NULL
"""
PARTS["lag_summary"] = f"""
SELECT census_year, teaching_modality, lag_years, count(*) AS eligible_offers,
       {_big('sum(graduates)', 'graduates')}, {_big('sum(lagged_entrants)', 'lagged_entrants')},
       {_ratio('sum(graduates)', 'sum(lagged_entrants)')} AS aggregate_completion_ratio,
       round(quantile_cont(lagged_completion_ratio, 0.5), 10) AS median_offer_ratio,
       {_ratio('count(*) FILTER (exceeds_one)', 'count(*)')} AS exceeds_one_share
FROM lagged WHERE is_eligible GROUP BY census_year, teaching_modality, lag_years
"""

PARTS["raw_num"] = """
SELECT TRY_CAST(trim(nu_ano_censo) AS BIGINT) AS nu_ano_censo, TRY_CAST(trim(tp_dimensao) AS BIGINT) AS tp_dimensao,
       TRY_CAST(trim(co_regiao) AS BIGINT) AS co_regiao, TRY_CAST(trim(co_uf) AS BIGINT) AS co_uf,
       TRY_CAST(trim(co_municipio) AS BIGINT) AS co_municipio, TRY_CAST(trim(co_ies) AS BIGINT) AS co_ies,
       TRY_CAST(trim(co_curso) AS BIGINT) AS co_curso, no_curso, co_cine_rotulo, no_cine_rotulo,
       TRY_CAST(trim(tp_modalidade_ensino) AS BIGINT) AS tp_modalidade_ensino,
       TRY_CAST(trim(tp_nivel_academico) AS BIGINT) AS tp_nivel_academico,
       TRY_CAST(trim(tp_grau_academico) AS BIGINT) AS tp_grau_academico,
       TRY_CAST(qt_curso AS BIGINT) AS qt_curso, TRY_CAST(qt_vg_total AS BIGINT) AS qt_vg_total,
       TRY_CAST(qt_inscrito_total AS BIGINT) AS qt_inscrito_total, TRY_CAST(qt_ing AS BIGINT) AS qt_ing,
       TRY_CAST(qt_mat AS BIGINT) AS qt_mat, TRY_CAST(qt_conc AS BIGINT) AS qt_conc
FROM raw
"""
_RKEY = "nu_ano_censo, co_ies, co_curso, tp_modalidade_ensino"
PARTS["mvp_a"] = f"""
SELECT {_RKEY}, tp_dimensao = 1 AS on_site, min(no_curso) AS no_curso, min(co_cine_rotulo) AS co_cine_rotulo,
       min(no_cine_rotulo) AS no_cine_rotulo, {_big('coalesce(sum(qt_curso), 0)', 'qt_curso')},
       {_big('coalesce(sum(qt_vg_total), 0)', 'qt_vg_total')},
       {_big('coalesce(sum(qt_inscrito_total), 0)', 'qt_inscrito_total')}
FROM raw_num WHERE tp_nivel_academico = 1 AND tp_dimensao IN (1, 3) GROUP BY ALL
"""
PARTS["mvp_b"] = f"""
SELECT {_RKEY}, tp_dimensao = 1 AS on_site, min(no_curso) AS no_curso, min(co_cine_rotulo) AS co_cine_rotulo,
       min(no_cine_rotulo) AS no_cine_rotulo, {_big('coalesce(sum(qt_ing), 0)', 'qt_ing')},
       {_big('coalesce(sum(qt_mat), 0)', 'qt_mat')}, {_big('coalesce(sum(qt_conc), 0)', 'qt_conc')}
FROM raw_num WHERE tp_nivel_academico = 1 AND tp_dimensao IN (1, 2) GROUP BY ALL
"""
PARTS["mvp"] = f"""
SELECT {_RKEY}, coalesce(a.no_curso, b.no_curso) AS no_curso,
       coalesce(a.co_cine_rotulo, b.co_cine_rotulo) AS co_cine_rotulo,
       coalesce(a.no_cine_rotulo, b.no_cine_rotulo) AS no_cine_rotulo,
       qt_curso, qt_vg_total, qt_inscrito_total, qt_ing, qt_mat, qt_conc,
       qt_vg_total IS NULL AS missing_capacity_component, qt_ing IS NULL AS missing_student_component,
       {_ratio('qt_ing', 'qt_vg_total')} AS seat_occupancy_rate,
       {_ratio('qt_inscrito_total', 'qt_vg_total')} AS applications_per_seat,
       qt_vg_total - qt_ing AS unconverted_seat_capacity,
       {_ratio('qt_conc', 'qt_mat')} AS graduation_intensity
FROM mvp_a AS a FULL JOIN mvp_b AS b USING ({_RKEY}, on_site)
"""
PARTS["names"] = """
SELECT CAST(co_ies AS BIGINT) AS institution_id, max(no_ies) AS institution_name FROM raw_inst GROUP BY ALL
"""
PARTS["vacant"] = f"""
SELECT institution_id, {_big('sum(offered_seats - entrants)', 'unconverted')},
       {_ratio('sum(entrants)', 'sum(offered_seats)')} AS occupancy, count(*) AS offers
FROM supply WHERE census_year = {LAST} AND offered_seats > 0 GROUP BY institution_id
"""

# --- Scored rows -------------------------------------------------------------------
_ROW = "reference_year, institution_id, course_id, teaching_modality"
PARTS["scored"] = f"""
SELECT split, {_ROW}, CAST(deteriorated AS INTEGER) AS label, CAST(20 AS DOUBLE) / enrollments AS score
FROM training
"""
PARTS["sized"] = f"""
SELECT split, {_ROW}, CAST(deteriorated AS INTEGER) AS label, -CAST(enrollments AS DOUBLE) AS score
FROM training WHERE split = 'teste'
"""


def _metrics(source: str, model: str, probability: bool) -> str:
    """AUC by mid-ranks of rows; average precision by running counts of rows."""
    brier = "avg(power(score - label, 2))" if probability else "CAST(NULL AS DOUBLE)"
    brier = f"round({brier}, 10)"
    return f"""
    SELECT '{model}' AS model_name, split, count(*) AS row_count,
           CAST(sum(label) AS DOUBLE) / count(*) AS event_rate,
           round((sum(label * mid) - sum(label) * (sum(label) + 1) / 2.0)
                 / (CAST(sum(label) AS DOUBLE) * (count(*) - sum(label))), 10) AS roc_auc,
           round(sum(label * tp / CAST(flagged AS DOUBLE)) / sum(label), 10) AS average_precision,
           {brier} AS brier_score
    FROM (SELECT *, rank() OVER (PARTITION BY split ORDER BY score)
                    + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0 AS mid,
                 count(*) OVER (PARTITION BY split ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS flagged,
                 sum(label) OVER (PARTITION BY split ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS tp
          FROM {source})
    GROUP BY split"""


_NUMERIC = [
    "occupancy_rate", "occupancy_rate_lag1", "occupancy_change_1y", "applications_per_seat",
    "graduation_intensity", "low_occupancy_share_to_date", "current_low_occupancy_streak",
    "mean_occ", "volatility", "enrollment_growth_1y", "enrollment_growth_2y", "seat_growth_1y",
    "years_observed_to_date", "offered_seats", "enrollments", "institution_offer_count", "hhi",
]
_FULL_NAME = {
    "mean_occ": "mean_occupancy_to_date", "volatility": "demand_volatility_to_date",
    "hhi": "institution_enrollment_hhi",
}
# The features above are rounded for comparison; the model reads them unrounded.
PARTS["train_rows"] = f"""
SELECT t.*, h.mean_occ, h.volatility, i.institution_enrollment_hhi AS hhi
FROM training AS t
JOIN history AS h ON h.institution_id = t.institution_id AND h.course_id = t.course_id
 AND h.teaching_modality = t.teaching_modality AND h.census_year = t.reference_year
LEFT JOIN inst_year AS i ON i.institution_id = t.institution_id AND i.census_year = t.reference_year
WHERE split = 'treino'
"""


def _statistic(name: str) -> str:
    middle = f"(SELECT quantile_cont(CAST({name} AS DOUBLE), 0.5) FROM train_rows)"
    filled = f"coalesce(CAST({name} AS DOUBLE), {middle})"
    return f"""SELECT '{_FULL_NAME.get(name, name)}' AS feature, count({name}) AS present,
      round({middle}, 10) AS median, round(avg({filled}), 6) AS mean,
      round(stddev_pop({filled}), 6) AS deviation FROM train_rows"""


def _levels(name: str) -> str:
    mode = f"""(SELECT {name} FROM train_rows WHERE {name} IS NOT NULL
               GROUP BY {name} ORDER BY count(*) DESC, {name} LIMIT 1)"""
    return f"""SELECT '{name}' AS feature, CAST(level AS DOUBLE) AS level, level = {mode} AS is_mode,
      count(*) AS rows, count(*) < 0.01 * (SELECT count(*) FROM train_rows) AS is_rare
      FROM (SELECT coalesce({name}, {mode}) AS level FROM train_rows) GROUP BY level"""


def _window_statistic(name: str, window: str, years: list[int]) -> str:
    """``_statistic`` of some training years."""
    chosen = f"(SELECT * FROM train_rows WHERE reference_year IN ({', '.join(map(str, years))}))"
    return f"""SELECT '{window}' AS "window", * FROM ({_statistic(name).replace("FROM train_rows", f"FROM {chosen}")})"""


#: Training years that a window of the stability report has.
WINDOW_YEARS = 3


def training_windows() -> dict[str, list[int]]:
    first, last = TRAIN_YEARS
    return {f"{y}-{y + WINDOW_YEARS - 1}": list(range(y, y + WINDOW_YEARS)) for y in range(first, last - WINDOW_YEARS + 2)}


def _check(name: str, sql: str) -> str:
    return f"SELECT '{name}' AS check_name, CAST(NULL AS INTEGER) AS census_year, CAST(({sql}) AS BIGINT) AS violations"


def _check_by_year(name: str, sql: str) -> str:
    return f"SELECT '{name}' AS check_name, CAST(y AS INTEGER) AS census_year, CAST(n AS BIGINT) AS violations FROM ({sql})"


def _all(*selects: str) -> str:
    return "\nUNION ALL\n".join(selects)


def _with(sql: str) -> str:
    """Prepends the named subqueries a statement uses, in order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+\(?{name}\b", text):
                visit(PARTS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    listed = ",\n".join(f"{n} AS MATERIALIZED (\n{PARTS[n].strip()}\n)" for n in needed)
    return f"WITH {listed}\n{sql}"


# A scorer of stated weights: name, middle, mean, deviation and weight of each numeric input, in order.
SCORER = [
    ("occupancy_rate", 0.5, 0.4, 0.25, -1.25), ("offered_seats", 40.0, 50.0, 30.0, -0.75),
    ("enrollments", 100.0, 120.0, 80.0, 0.5), ("institution_offer_count", 3.0, 4.0, 2.0, 0.3),
]
SCORER_LEVELS = [("teaching_modality", 0.4), ("education_network", -0.2)]  # each has levels 1 and 2
SCORER_INTERCEPT = -0.6


def _scored(rows: str) -> str:
    inputs = [
        (f"numeric__{n}", f"((coalesce(CAST({n} AS DOUBLE), {m}::DOUBLE) - {mean}::DOUBLE) / {dev}::DOUBLE)", w)
        for n, m, mean, dev, w in SCORER
    ] + [
        (f"categorical__{n}_2.0", f"(CASE WHEN coalesce({n}, 1) = 2 THEN 1.0 ELSE 0.0 END)::DOUBLE", w)
        for n, w in SCORER_LEVELS
    ]
    total = f"{SCORER_INTERCEPT}::DOUBLE"
    for _, value, weight in inputs:
        total = f"({total} + ({weight}::DOUBLE) * {value})"
    parts = ", ".join(
        f"{{'place': {i}, 'feature': '{n}', 'transformed_value': {v}, 'contribution': ({w}::DOUBLE) * {v}}}"
        for i, (n, v, w) in enumerate(inputs)
    )
    return f"""SELECT *, 1 / (1 + exp(-log_odds)) AS score FROM (
        SELECT *, {total} AS log_odds, [{parts}] AS parts FROM ({rows}))"""


PARTS["scored_test"] = _scored("SELECT * FROM training WHERE split = 'teste'")
PARTS["explained_test"] = f"""
SELECT reference_year, {_OFFER}, log_odds, score, deteriorated, part.feature AS feature,
       part.transformed_value AS transformed_value, part.contribution AS contribution,
       row_number() OVER (PARTITION BY reference_year, {_OFFER} ORDER BY abs(part.contribution) DESC, part.feature) AS place
FROM (SELECT *, unnest(parts) AS part FROM scored_test)
"""
PARTS["scored_open"] = _scored(f"""
    SELECT f.*, s.course_name FROM features AS f JOIN supply AS s
      ON s.institution_id = f.institution_id AND s.course_id = f.course_id
     AND s.teaching_modality = f.teaching_modality AND s.census_year = {LAST}
    WHERE f.reference_year = {LAST} AND f.enrollments >= 20""")

# Spoilt inputs: a year is gone, others are wrong or blank, codes are bad, rows stand twice.
_SPOILT_ROWS = """SELECT * REPLACE (
    CASE WHEN CAST(co_curso AS BIGINT) = 3 THEN '1990' WHEN CAST(co_curso AS BIGINT) = 8 AND tp_dimensao = '1' THEN NULL
         ELSE nu_ano_censo END AS nu_ano_censo,
    CASE WHEN CAST(co_ies AS BIGINT) % 4 = 1 THEN '9' ELSE tp_dimensao END AS tp_dimensao,
    CASE WHEN CAST(co_curso AS BIGINT) % 13 = 5 THEN NULL ELSE co_cine_rotulo END AS co_cine_rotulo,
    CASE WHEN CAST(co_ies AS BIGINT) % 6 = 2 THEN NULL ELSE tp_rede END AS tp_rede,
    CASE WHEN CAST(co_ies AS BIGINT) % 5 = 3 THEN NULL ELSE qt_ing END AS qt_ing,
    CASE WHEN CAST(co_ies AS BIGINT) % 5 = 2 THEN NULL ELSE qt_vg_total END AS qt_vg_total)
FROM raw WHERE nu_ano_censo <> '1997'"""
PARTS["bad_raw"] = f"{_SPOILT_ROWS} UNION ALL {_SPOILT_ROWS} AND CAST(co_ies AS BIGINT) % 7 = 0"
PARTS["bad_raw_inst"] = "SELECT * FROM raw_inst UNION ALL SELECT * FROM raw_inst WHERE CAST(co_ies AS BIGINT) % 5 = 0"
PARTS["bad_typed"] = _cast_all(_COURSE_TYPES, "bad_raw")
PARTS["bad_inst"] = _cast_all(_INST_TYPES, "bad_raw_inst")
_SPOILT_SUPPLY = """SELECT * REPLACE (CAST(CASE WHEN course_id % 11 = 0 THEN 9 ELSE teaching_modality END AS INTEGER)
    AS teaching_modality) FROM supply"""
PARTS["bad_supply"] = f"{_SPOILT_SUPPLY} UNION ALL {_SPOILT_SUPPLY} WHERE institution_id % 7 = 0"


# Spoilt products, each so that every check of its family finds something.
PARTS["bad_snapshot_rows"] = """
SELECT * FROM supply WHERE NOT (institution_id % 7 = 0 AND census_year = 1997)
UNION ALL SELECT * REPLACE (course_id + 1000000 AS course_id) FROM supply WHERE institution_id % 11 = 3
"""
PARTS["bad_edition_rows"] = f"""
SELECT * REPLACE (CASE WHEN course_id % 9 = 0 THEN coalesce(enrollments, 0) + 1 ELSE enrollments END AS enrollments)
FROM supply WHERE census_year = {LAST}
"""
PARTS["bad_persistence"] = """
SELECT * REPLACE (
    CASE WHEN institution_id % 5 = 1 THEN measurable_years + 1 ELSE current_low_occupancy_streak END AS current_low_occupancy_streak,
    CASE WHEN institution_id % 6 = 2 THEN 1.5 ELSE low_occupancy_share END AS low_occupancy_share,
    CASE WHEN institution_id % 8 = 3 THEN 1990 ELSE first_year END AS first_year,
    CASE WHEN institution_id % 9 = 4 THEN -1.0 ELSE demand_volatility END AS demand_volatility)
FROM persistence
"""
PARTS["bad_panel"] = """
SELECT * REPLACE (CASE WHEN institution_id % 5 = 2 THEN TRUE ELSE is_low_occupancy END AS is_low_occupancy,
    CASE WHEN institution_id % 5 = 2 THEN FALSE ELSE has_measurable_occupancy END AS has_measurable_occupancy)
FROM panel
"""
PARTS["bad_features"] = """
SELECT * REPLACE (
    CASE WHEN institution_id % 5 = 1 THEN years_observed_to_date + 20 ELSE years_observed_to_date END AS years_observed_to_date,
    CASE WHEN institution_id % 6 = 1 THEN 2.0 ELSE institution_enrollment_hhi END AS institution_enrollment_hhi)
FROM features
"""
PARTS["bad_labels"] = f"""
SELECT * REPLACE (CASE
    WHEN reference_year > {LAST - 2} AND institution_id % 4 = 1 THEN TRUE
    WHEN label_is_observable AND disappeared_from_census AND institution_id % 4 = 2 THEN FALSE
    WHEN label_is_observable AND NOT disappeared_from_census AND base_enrollments > 0
         AND horizon_enrollments >= base_enrollments AND institution_id % 4 = 3 THEN TRUE
    ELSE deteriorated END AS deteriorated)
FROM labels
"""
PARTS["bad_training"] = """
SELECT * REPLACE (CASE WHEN reference_year = 1998 AND institution_id % 5 = 0 THEN 'teste' ELSE split END AS split,
    CASE WHEN institution_id % 7 <> 3 THEN deteriorated END AS deteriorated)
FROM training
"""
PARTS["bad_state"] = """
SELECT * REPLACE (CASE WHEN institution_id % 5 = 1 THEN 'outra' ELSE modality_state END AS modality_state) FROM state
"""
PARTS["bad_transitions"] = f"""
SELECT * REPLACE (CASE WHEN institution_id % 6 = 1 THEN {FIRST} ELSE census_year END AS census_year) FROM transitions
"""
PARTS["bad_dependency"] = """
SELECT * REPLACE (CASE WHEN census_year % 2 = 1 THEN 1.5 ELSE ead_seat_share END AS ead_seat_share) FROM dependency
"""
PARTS["bad_lagged"] = """
SELECT * REPLACE (CASE WHEN institution_id % 5 = 1 THEN 9 ELSE lag_years END AS lag_years,
    CASE WHEN institution_id % 6 = 1 THEN NOT is_eligible ELSE is_eligible END AS is_eligible)
FROM lagged
"""


def _spoilt(sql: str) -> str:
    """The same statement over the spoilt inputs."""
    return re.sub(r"\b(FROM|JOIN)(\s+)(raw_inst|raw|typed|inst|supply)\b", r"\1\2bad_\3", sql)


_EDGE_BINS = 10


def _signs(signs: str, extreme: str = "max") -> str:
    return f"""
        SELECT feature, {extreme}(abs(coefficient)) AS {extreme}_absolute_coefficient,
               string_agg("window" || ':' || CAST(CAST(coefficient AS BIGINT) AS VARCHAR), ',' ORDER BY "window") AS coefficients
        FROM (SELECT cine_label_code AS feature, CAST(census_year AS VARCHAR) AS "window",
                     CAST(sum(coalesce(entrants, 0) - 2 * coalesce(graduates, 0)) AS DOUBLE) AS coefficient
              FROM supply GROUP BY ALL)
        GROUP BY feature HAVING count(DISTINCT coefficient > 0) {signs}"""


def all_queries() -> dict[str, str]:
    years = "(SELECT DISTINCT CAST(y AS INTEGER) AS year FROM line)"
    newest_header = [c for c, _, _ in _COURSE_TYPES]
    sql: dict[str, str] = {}

    # Sources and layouts: one edition adds a column, one misspells another.
    sql["edition_file_profile"] = f"""
        SELECT CAST(y AS INTEGER) AS year, 'cursos' AS kind, count(*) AS data_row_count,
               CAST(CASE WHEN y = {FIRST + 1} THEN 23 ELSE 22 END AS INTEGER) AS column_count
        FROM line GROUP BY y"""
    courses_file, institutions_file = "'MICRODADOS_CADASTRO_CURSOS_'", "'MICRODADOS_ED_SUP_IES_'"
    packages = f"(SELECT {FIRST} AS year UNION ALL SELECT {LAST})"
    sql["edition_file_selection"] = f"""
        SELECT CAST(year AS INTEGER) AS package_year, name AS file_name, kind, CAST(year AS INTEGER) AS year, outcome,
               CASE WHEN outcome = 'chosen' THEN CASE kind WHEN 'cursos' THEN courses ELSE institutions END END AS data_row_count
        FROM (SELECT p.year, name, kind, CASE WHEN kind = 'ies' AND p.year = {LAST} THEN 'second candidate' ELSE outcome END AS outcome
              FROM {packages} AS p CROSS JOIN LATERAL (VALUES
                ({courses_file} || p.year || '.CSV', 'cursos', 'chosen'), ('~$' || {courses_file} || p.year || '.CSV', NULL, 'lock file'),
                ('LEIAME_' || p.year || '.csv', NULL, 'no kind'), ({courses_file} || p.year || '.TXT', NULL, 'not a CSV'),
                ({institutions_file} || p.year || '.CSV', 'ies', 'chosen'),
                (CASE WHEN p.year = {LAST} THEN 'IES_COPIA_' || p.year || '.CSV' END, 'ies', 'second candidate')) AS v(name, kind, outcome)
              WHERE name IS NOT NULL)
        JOIN (SELECT CAST(nu_ano_censo AS INTEGER) AS year, count(*) AS courses FROM raw GROUP BY 1) USING (year)
        JOIN (SELECT CAST(nu_ano_censo AS INTEGER) AS year, count(*) AS institutions FROM raw_inst GROUP BY 1) USING (year)"""
    sql["institution_file_profile"] = f"""
        SELECT CAST(nu_ano_censo AS INTEGER) AS year, 'ies' AS kind, count(*) AS data_row_count,
               CAST(CASE WHEN nu_ano_censo = '{LAST}' THEN 9 ELSE 8 END AS INTEGER) AS column_count
        FROM raw_inst GROUP BY nu_ano_censo"""
    sql["institution_layout_drift"] = f"""
        SELECT 'ies' AS kind, CAST(nu_ano_censo AS INTEGER) AS year, CAST(8 AS BIGINT) AS common_column_count,
               CASE WHEN nu_ano_censo = '{LAST}' THEN 'TP_REDE' ELSE '' END AS only_this_year
        FROM raw_inst GROUP BY nu_ano_censo"""
    sql["institution_edition_series"] = "SELECT * FROM inst"
    sql["changed_cells"] = f"""
        SELECT coalesce(o.census_year, n.census_year) AS census_year, coalesce(o.institution_id, n.institution_id) AS institution_id,
               coalesce(o.course_id, n.course_id) AS course_id, coalesce(o.teaching_modality, n.teaching_modality) AS teaching_modality,
               CASE WHEN o.course_id IS NULL THEN 'added' WHEN n.course_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
               CASE WHEN o.course_id IS NULL OR n.course_id IS NULL THEN '' ELSE concat_ws(',',
                   CASE WHEN o.course_name IS DISTINCT FROM n.course_name THEN 'course_name' END,
                   CASE WHEN o.enrollments IS DISTINCT FROM n.enrollments THEN 'enrollments' END) END AS columns
        FROM supply AS o FULL JOIN edited AS n ON o.census_year = n.census_year AND o.institution_id = n.institution_id
         AND o.course_id = n.course_id AND o.teaching_modality = n.teaching_modality
        WHERE o.course_id IS NULL OR n.course_id IS NULL
           OR (o.course_name, o.enrollments) IS DISTINCT FROM (n.course_name, n.enrollments)"""
    sql["edition_reload"] = f"""
        SELECT CAST(census_year AS INTEGER) AS census_year,
               (SELECT count(*) FROM (SELECT * FROM edited AS x WHERE x.census_year = e.census_year EXCEPT ALL
                                      SELECT * FROM supply AS y WHERE y.census_year = e.census_year))
               + (SELECT count(*) FROM (SELECT * FROM supply AS y WHERE y.census_year = e.census_year EXCEPT ALL
                                        SELECT * FROM edited AS x WHERE x.census_year = e.census_year)) > 0 AS rewritten,
               TRUE AS second_run_writes_nothing, count(*) AS row_count, CAST(coalesce(sum(enrollments), 0) AS BIGINT) AS enrollments
        FROM edited AS e GROUP BY e.census_year"""
    sql["edition_csv_supply"] = "SELECT * FROM supply"
    sql["union_editions"] = """
        SELECT CAST(nu_ano_censo AS INTEGER) AS census_year, count(*) AS row_count,
               count(*) FILTER (co_cine_rotulo IS NULL) AS null_field_codes,
               count(DISTINCT co_cine_rotulo) AS field_codes,
               CAST(sum(CAST(NULLIF(qt_vg_total, '') AS BIGINT)) AS BIGINT) AS offered_seats
        FROM raw GROUP BY 1"""
    sql["common_columns"] = _all(
        *[
            f"SELECT '{c.upper()}' AS column_name, CAST({i} AS BIGINT) AS position"
            for i, c in enumerate(newest_header)
        ]
    )
    sql["layout_drift"] = f"""
        SELECT 'cursos' AS kind, year, CAST(22 AS BIGINT) AS common_column_count,
               CASE WHEN year = {FIRST + 1} THEN 'CO_PROJETO' ELSE '' END AS only_this_year
        FROM {years}"""
    sql["dictionary_diff"] = f"""
        SELECT year, 'cursos' AS kind, column_name, side FROM {years}
        JOIN (VALUES ({FIRST + 1}, 'CO_PROJETO', 'missing_in_dictionary'),
                     ({ZERO_FROM}, 'CO_CINE_ROTULO2', 'missing_in_dictionary'),
                     ({ZERO_FROM}, 'CO_CINE_ROTULO', 'missing_in_file')) AS v(year, column_name, side)
        USING (year)"""
    sql["control_match"] = f"""
        SELECT 'cursos_' || year AS table_name, TRUE AS content_matches,
               'CURSOS_' || year AS control_name, TRUE AS name_matches FROM {years}"""
    sql["snapshot_fingerprint"] = """
        SELECT 'supply' AS table_name, count(*) AS recorded_rows, count(*) AS current_rows,
               TRUE AS matches FROM supply"""

    # Staging and mart
    sql["staged_courses"] = "SELECT * FROM typed"
    sql["staged_institutions"] = "SELECT * FROM inst"
    sql["course_supply"] = sql["supply_snapshot"] = "SELECT * FROM supply"
    sql["course_sustainability"] = f"""
        SELECT s.*, i.institution_name, i.institution_abbreviation, i.institution_state,
               {_ratio('entrants', 'offered_seats')} AS seat_occupancy_rate,
               {_ratio('applications', 'offered_seats')} AS applications_per_seat,
               offered_seats - entrants AS unconverted_seat_capacity,
               {_ratio('graduates', 'enrollments')} AS graduation_intensity,
               offered_seats = 0 AS has_zero_offered_seats,
               offered_seats > 0 AND entrants > offered_seats AS entrants_exceed_offered_seats,
               capacity_source_row_count IS NULL AS missing_capacity_component,
               student_source_row_count IS NULL AS missing_student_component
        FROM supply AS s LEFT JOIN inst AS i
          ON i.census_year = s.census_year AND i.institution_id = s.institution_id"""
    sql["single_edition_sustainability"] = sql["course_sustainability"].replace(
        "SELECT s.*,", "SELECT s.* EXCLUDE (education_network, administrative_category), "
        "i.education_network, i.administrative_category,").replace("LEFT JOIN inst AS i", "LEFT JOIN inst_single AS i") + (
        f" WHERE s.census_year = {LAST}")
    sql["institution_portfolio"] = f"""
        SELECT census_year, institution_id, {_big('sum(e)', 'enrollments')}, count(*) AS course_count,
               round(sum(power(e / NULLIF(CAST(total AS DOUBLE), 0), 2)), 10) AS enrollment_hhi
        FROM (SELECT census_year, institution_id, course_id, sum(enrollments) AS e,
                     sum(sum(enrollments)) OVER (PARTITION BY census_year, institution_id) AS total
              FROM supply GROUP BY census_year, institution_id, course_id)
        GROUP BY census_year, institution_id"""

    # Panel
    sql["supply_panel"] = "SELECT * FROM panel"
    sql["course_persistence"] = """
        SELECT * REPLACE (round(mean_occupancy_rate, 10) AS mean_occupancy_rate,
                          round(occupancy_stddev, 10) AS occupancy_stddev,
                          round(demand_volatility, 10) AS demand_volatility) FROM persistence"""
    sql["long_panel_persistence"] = f"""
        SELECT teaching_modality, count(*) AS offers, round(avg(low_occupancy_share), 10) AS mean_low_share,
               {_ratio('count(*) FILTER (low_occupancy_share = 1)', 'count(*)')} AS always_idle_share,
               {_ratio('count(*) FILTER (current_low_occupancy_streak >= 2)', 'count(*)')} AS long_streak_share,
               round(avg(demand_volatility), 10) AS mean_volatility
        FROM persistence WHERE measurable_years >= 5 AND NOT has_gaps GROUP BY teaching_modality"""

    # Risk
    sql["deterioration_labels"] = "SELECT * FROM labels"
    sql["offer_features"] = "SELECT * FROM features"
    sql["training_set"] = "SELECT * FROM training"

    # Portfolios
    sql["modality_portfolio_state"] = sql["portfolio_snapshot"] = "SELECT * FROM state"
    sql["modality_transitions"] = "SELECT * FROM transitions"
    sql["modality_dependency"] = "SELECT * FROM dependency"
    distance = {
        m: f"sum(CASE WHEN teaching_modality = 2 THEN {m} END)"
        for m in ("offered_seats", "entrants", "enrollments")
    }
    sql["national_modality_shares"] = f"""
        SELECT census_year, {_big('sum(offered_seats)', 'offered_seats')}, {_big('sum(entrants)', 'entrants')},
               {_big('sum(enrollments)', 'enrollments')},
               {_ratio(distance['offered_seats'], 'sum(offered_seats)')} AS ead_seat_share,
               {_ratio(distance['entrants'], 'sum(entrants)')} AS ead_entrant_share,
               {_ratio(distance['enrollments'], 'sum(enrollments)')} AS ead_enrollment_share
        FROM supply WHERE census_year IN ({FIRST}, {FIRST + 5}, {LAST}) GROUP BY census_year"""
    sql["portfolio_state_counts"] = f"""
        SELECT census_year, modality_state, count(*) AS institution_fields
        FROM state WHERE census_year IN ({FIRST}, {LAST}) GROUP BY ALL"""
    sql["latest_transition_counts"] = f"""
        SELECT transition, count(*) AS institution_fields
        FROM transitions WHERE census_year = {LAST} GROUP BY transition"""
    for name, end in (("surviving_panel", LAST), ("surviving_panel_of_year", LAST - 1)):
        sql[name] = f"""
            SELECT count(*) AS surviving_institution_fields, count(*) FILTER (d > 0 AND p < 0) AS ead_up_presencial_down,
                   {_ratio('count(*) FILTER (d > 0 AND p < 0)', 'count(*)')} AS substitution_signal_share,
                   round(corr(d, p), 10) AS seat_change_correlation
            FROM (SELECT b.ead_seats - a.ead_seats AS d, b.presencial_seats - a.presencial_seats AS p
                  FROM state AS a JOIN state AS b USING (institution_id, cine_label_code)
                  WHERE a.census_year = {FIRST} AND b.census_year = {end})"""
    sql["largest_fields"] = f"""
        SELECT cine_label_code, cine_label_name,
               coalesce(presencial_seats, 0) + coalesce(ead_seats, 0) AS offered_seats, ead_seat_share,
               ead_entrant_share, ead_seat_share - ead_entrant_share AS conversion_gap
        FROM dependency WHERE census_year = {LAST} ORDER BY offered_seats DESC, cine_label_code LIMIT 15"""

    # Completion
    sql["lagged_completion"] = "SELECT * FROM lagged"
    sql["lagged_completion_summary"] = "SELECT * FROM lag_summary"
    coverage = f"""
        SELECT s.census_year, s.teaching_modality, s.lag_years, s.eligible_offers, o.n AS current_offers,
               {_ratio('s.eligible_offers', 'o.n')} AS coverage_share, s.aggregate_completion_ratio,
               s.median_offer_ratio, s.exceeds_one_share
        FROM lag_summary AS s JOIN (
            SELECT teaching_modality, count(*) AS n FROM supply
            WHERE census_year = {LAST} AND graduates IS NOT NULL GROUP BY 1) AS o USING (teaching_modality)
        WHERE s.census_year = {LAST}"""
    sql["completion_coverage"] = coverage
    sql["completion_coverage_of_lag"] = coverage + " AND s.lag_years = 4"

    # Reports
    sql["modality_series"] = sql["report_sink"] = f"""
        SELECT census_year, teaching_modality, {_big('sum(offered_seats)', 'seats')},
               {_big('sum(entrants)', 'entrants')},
               CASE WHEN coalesce(sum(offered_seats), 0) = 0 THEN 0
                    ELSE {_ratio('sum(entrants)', 'sum(offered_seats)')} END AS occupancy
        FROM supply GROUP BY census_year, teaching_modality"""
    sql["top_unconverted_institutions"] = f"""
        SELECT v.institution_id, coalesce(i.institution_name, 'IES ' || v.institution_id) AS institution_name,
               i.institution_state, v.unconverted, v.occupancy, v.offers
        FROM vacant AS v LEFT JOIN inst AS i ON i.institution_id = v.institution_id AND i.census_year = {LAST}
        ORDER BY v.unconverted DESC NULLS FIRST, v.institution_id LIMIT 12"""
    sql["unconverted_concentration"] = """
        SELECT position, CAST(running AS DOUBLE) / NULLIF(CAST(total AS DOUBLE), 0) AS cumulative_share
        FROM (SELECT row_number() OVER w AS position, sum(unconverted) OVER w AS running,
                     (SELECT sum(unconverted) FROM vacant) AS total
              FROM vacant WINDOW w AS (ORDER BY unconverted DESC NULLS FIRST, institution_id
                                       ROWS UNBOUNDED PRECEDING))
        WHERE position IN (1, 5, 10, 20, 50)"""
    sql["capacity_totals"] = f"""
        SELECT count(DISTINCT institution_id) AS institutions,
               {_big('sum(offered_seats - entrants)', 'unconverted')}, {_big('sum(offered_seats)', 'seats')}
        FROM supply WHERE census_year = {LAST} AND offered_seats > 0"""
    sql["mvp_course_mart"] = "SELECT * FROM mvp"
    total = {c: f"CAST(coalesce(sum({c}), 0) AS BIGINT)" for c in
             ("qt_vg_total", "qt_inscrito_total", "qt_ing", "qt_mat", "qt_conc")}
    sql["mvp_by_modality"] = f"""
        SELECT nu_ano_censo AS census_year, tp_modalidade_ensino AS modality_code, count(*) AS course_offerings,
               count(DISTINCT co_ies) AS institutions, {total['qt_vg_total']} AS offered_seats,
               {total['qt_inscrito_total']} AS applications, {total['qt_ing']} AS entrants,
               {total['qt_mat']} AS enrollments, {total['qt_conc']} AS graduates,
               round({_ratio(total['qt_ing'], total['qt_vg_total'])}, 6) AS weighted_seat_occupancy_rate,
               round({_ratio(total['qt_conc'], total['qt_mat'])}, 6) AS graduation_intensity
        FROM mvp GROUP BY nu_ano_censo, tp_modalidade_ensino"""
    sql["mvp_concentration"] = f"""
        SELECT census_year, institution_id, institution_name, round(hhi, 6) AS enrollment_hhi, course_count,
               CAST(enrollments AS BIGINT) AS enrollments
        FROM (SELECT nu_ano_censo AS census_year, co_ies AS institution_id, count(*) AS course_count,
                     sum(e) AS enrollments, sum(power(e / CAST(total AS DOUBLE), 2)) AS hhi
              FROM (SELECT nu_ano_censo, co_ies, co_curso, coalesce(sum(qt_mat), 0) AS e,
                           sum(coalesce(sum(qt_mat), 0)) OVER (PARTITION BY nu_ano_censo, co_ies) AS total
                    FROM mvp GROUP BY nu_ano_censo, co_ies, co_curso)
              WHERE total > 0 GROUP BY nu_ano_censo, co_ies)
        LEFT JOIN names USING (institution_id)
        WHERE course_count >= 5 AND enrollments >= 1000
        QUALIFY row_number() OVER (PARTITION BY census_year ORDER BY round(hhi, 9) DESC, institution_id) <= 10"""
    sql["mvp_idle"] = """
        SELECT m.nu_ano_censo AS census_year, m.co_ies AS institution_id, n.institution_name,
               m.co_curso AS course_id, m.no_curso AS course_name, m.tp_modalidade_ensino AS modality_code,
               m.qt_vg_total AS offered_seats, m.qt_ing AS entrants,
               round(m.seat_occupancy_rate, 6) AS seat_occupancy_rate, m.unconverted_seat_capacity
        FROM mvp AS m LEFT JOIN names AS n ON n.institution_id = m.co_ies
        WHERE m.qt_vg_total >= 100 AND m.seat_occupancy_rate IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY m.nu_ano_censo ORDER BY m.unconverted_seat_capacity DESC NULLS LAST,
            m.co_ies, m.co_curso, m.tp_modalidade_ensino) <= 10"""
    sql["mvp_overview"] = f"""
        SELECT count(*) AS row_count, count(*) = count(DISTINCT ({_RKEY})) AS unique_key,
               count(*) FILTER (missing_capacity_component) AS missing_capacity,
               count(*) FILTER (missing_student_component) AS missing_students FROM mvp"""
    measures = ("qt_curso", "qt_vg_total", "qt_inscrito_total", "qt_ing", "qt_mat", "qt_conc")
    per_measure = ", ".join(
        f"count({m}) AS {m[3:]}_non_null, count(*) - count(*) FILTER ({m} = 0) AS {m[3:]}_non_zero, "
        f"CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m[3:]}_sum"
        for m in measures
    )
    sql["dimension_profile"] = f"""
        SELECT nu_ano_censo AS census_year, tp_dimensao AS dimension, count(*) AS row_count,
               count(co_regiao + co_uf + co_municipio) AS geography_complete_row_count,
               count(DISTINCT co_ies) AS distinct_ies_count, count(DISTINCT co_curso) AS distinct_course_count,
               string_agg(DISTINCT CAST(tp_modalidade_ensino AS VARCHAR), ',' ORDER BY CAST(tp_modalidade_ensino AS VARCHAR)) AS modalities,
               string_agg(DISTINCT CAST(tp_nivel_academico AS VARCHAR), ',' ORDER BY CAST(tp_nivel_academico AS VARCHAR)) AS academic_levels,
               {per_measure},
               CASE tp_dimensao WHEN 1 THEN 'presencial_brasil' WHEN 2 THEN 'ead_alunos_por_localidade_brasil'
                    WHEN 3 THEN 'ead_oferta_nacional' WHEN 4 THEN 'ead_instituicoes_brasileiras_exterior'
                    ELSE 'categoria_desconhecida' END AS label
        FROM raw_num GROUP BY nu_ano_censo, tp_dimensao"""
    profiled = [c for c, _, t in _COURSE_TYPES if t != "VARCHAR" and c not in
                ("tp_rede", "tp_categoria_administrativa", "tp_organizacao_academica")]
    nulls = ", ".join(f"count(*) - count({c}) AS null_{c}" for c in profiled)
    sql["edition_profile"] = f"""
        SELECT nu_ano_censo AS census_year, count(*) AS row_count,
               CAST(count(*) FILTER (same > 1) AS BIGINT) AS rows_in_duplicated_candidate_key,
               count(*) FILTER (same > 1) = 0 AS candidate_key_is_unique, {nulls}
        FROM (SELECT *, count(*) OVER (
                  PARTITION BY nu_ano_censo, tp_dimensao, co_ies, co_curso, co_municipio, tp_modalidade_ensino) AS same
              FROM raw_num) GROUP BY nu_ano_censo"""
    sql["academic_level_counts"] = """
        SELECT nu_ano_censo AS census_year, CAST(tp_nivel_academico AS INTEGER) AS academic_level, count(*) AS row_count
        FROM raw_num WHERE tp_nivel_academico IS NOT NULL GROUP BY 1, 2"""

    # Checks
    sql["mart_checks"] = _all(
        _check_by_year("duplicate_mart_key", f"""SELECT census_year AS y, count(*) AS n FROM (
            SELECT census_year FROM supply GROUP BY {_KEY} HAVING count(*) > 1) GROUP BY 1"""),
        _check("invalid_modality_count", """SELECT count(*) FROM supply
            WHERE coalesce(teaching_modality, 0) NOT IN (1, 2)"""),
    )
    sql["raw_checks"] = _all(
        _check_by_year("duplicate_key_count", """SELECT nu_ano_censo AS y, count(*) AS n FROM (
            SELECT nu_ano_censo FROM raw GROUP BY nu_ano_censo, tp_dimensao, co_ies, co_curso, co_municipio,
            tp_modalidade_ensino HAVING count(*) > 1) GROUP BY 1"""),
        _check("unexpected_year_count", f"""SELECT count(DISTINCT nu_ano_censo) FROM raw
            WHERE CAST(nu_ano_censo AS INTEGER) NOT BETWEEN {FIRST} AND {LAST}"""),
        _check("null_year_count", "SELECT count(*) FROM raw WHERE nu_ano_censo IS NULL"),
        _check("missing_cine_label_count", f"""SELECT count(*) FROM raw
            WHERE nu_ano_censo = '{ZERO_FROM}' AND co_cine_rotulo IS NULL"""),
        _check("invalid_dimension_count", """SELECT count(*) FROM raw
            WHERE coalesce(tp_dimensao, '') NOT IN ('1', '2', '3', '4')"""),
        _check_by_year("duplicate_institution_count", """SELECT nu_ano_censo AS y, count(*) AS n FROM (
            SELECT nu_ano_censo FROM raw_inst GROUP BY nu_ano_censo, co_ies HAVING count(*) > 1) GROUP BY 1"""),
    )
    sql["staging_checks"] = _all(
        _check("unparsed_key_count", """SELECT count(*) FROM typed WHERE census_year + institution_id + course_id
            + dimension_type + teaching_modality + academic_level IS NULL"""),
        _check("out_of_window_count", f"SELECT count(*) FROM typed WHERE census_year < {FIRST} OR census_year > {LAST}"),
        _check("missing_edition_count", f"""SELECT {LAST - FIRST + 1} - count(DISTINCT census_year) FROM typed
            WHERE census_year BETWEEN {FIRST} AND {LAST}"""),
        _check_by_year("null_capacity_count", """SELECT census_year AS y, count(*) AS n FROM typed
            WHERE offered_seats IS NULL AND dimension_type IN (1, 3) GROUP BY 1"""),
        _check_by_year("null_entrant_count", """SELECT census_year AS y, count(*) AS n FROM typed
            WHERE entrants IS NULL AND dimension_type IN (1, 2) GROUP BY 1"""),
        _check("null_network_count", "SELECT count(*) FROM typed WHERE education_network IS NULL"),
        _check("duplicate_institution_count", """SELECT count(*) FROM (SELECT 1 FROM inst
            GROUP BY census_year, institution_id HAVING count(*) > 1)"""),
        _check("unexpected_blank_convention_count", f"""SELECT count(*) FROM (
            SELECT census_year, count(*) FILTER (entrants IS NULL) AS blank, count(*) AS n FROM typed
            WHERE dimension_type = 3 GROUP BY 1)
            WHERE blank <> CASE WHEN census_year < {ZERO_FROM} THEN n ELSE 0 END"""),
    )
    sql["fixed_scorer_explanations"] = f"""
        SELECT reference_year, {_OFFER}, round(score, 8) AS predicted_probability, round(log_odds, 8) AS log_odds,
               CAST(place - 1 AS INTEGER) AS rank, feature, round(transformed_value, 8) AS transformed_value,
               round(contribution, 8) + 0.0::DOUBLE AS contribution
        FROM explained_test WHERE place <= 3"""
    sql["fixed_scorer_highest_risk"] = f"""
        SELECT CAST(row_number() OVER (ORDER BY round(log_odds, 8) DESC, reference_year, {_OFFER}) AS INTEGER) AS position,
               reference_year, {_OFFER}, round(score, 8) AS predicted_probability, round(log_odds, 8) AS log_odds,
               drivers, deteriorated AS observed_deterioration
        FROM (SELECT * FROM scored_test ORDER BY round(log_odds, 8) DESC, reference_year, {_OFFER} LIMIT 20)
        JOIN (SELECT reference_year, {_OFFER}, string_agg(feature, ',' ORDER BY place) AS drivers
              FROM explained_test WHERE place <= 5 GROUP BY ALL) USING (reference_year, {_OFFER})"""
    sql["fixed_scorer_year"] = f"""
        SELECT reference_year, {_OFFER}, course_name, round(score, 8) AS risk FROM scored_open"""
    sql["fixed_scorer_audit_list"] = f"""
        SELECT {_OFFER}, reference_year, course_name, institution_name, institution_state, enrollments,
               round(occupancy_rate, 8) AS occupancy_rate, round(score, 8) AS risk
        FROM (SELECT * FROM scored_open QUALIFY row_number() OVER (
                  PARTITION BY institution_id ORDER BY round(log_odds, 8) DESC, {_OFFER}) = 1
              ORDER BY round(log_odds, 8) DESC, {_OFFER} LIMIT 15)
        LEFT JOIN (SELECT institution_id, institution_name, institution_state FROM inst
                   WHERE census_year = {LAST}) USING (institution_id)"""
    for name in ("mart_checks", "raw_checks", "staging_checks"):
        sql[f"spoilt_{name}"] = _spoilt(sql[name])
    # Exactly what SQL says of coefficients that are whole numbers of each edition.
    sql["sign_flipping_features"] = _signs("> 1")
    sql["sign_stable_features"] = _signs("= 1", "min") + " ORDER BY min_absolute_coefficient DESC, feature LIMIT 8"
    sql["pruned_edition_read"] = """
        SELECT CAST(nu_ano_censo AS INTEGER) AS census_year, count(*) AS row_count,
               count(DISTINCT co_ies) AS institutions,
               CAST(coalesce(sum(CAST(NULLIF(qt_mat, '') AS BIGINT)), 0) AS BIGINT) AS enrollments
        FROM raw GROUP BY 1"""
    sql["persistence_checks"] = _all(
        _check("snapshot_drift_count", f"SELECT count(*) FROM (SELECT {_KEY} FROM supply EXCEPT SELECT {_KEY} FROM snapshot_rows)"),
        _check("snapshot_surplus_count", f"SELECT count(*) FROM (SELECT {_KEY} FROM snapshot_rows EXCEPT SELECT {_KEY} FROM supply)"),
        _check("regression_against_edition_count", f"""SELECT count(*) FROM (
            SELECT {_OFFER}, offered_seats, entrants, enrollments, graduates, applications FROM snapshot_rows
            WHERE census_year = {LAST} EXCEPT
            SELECT {_OFFER}, offered_seats, entrants, enrollments, graduates, applications FROM edition_rows)"""),
        _check("impossible_count_rows", """SELECT count(*) FROM persistence
            WHERE greatest(low_occupancy_years, current_low_occupancy_streak) > measurable_years
               OR current_low_occupancy_streak > low_occupancy_years"""),
        _check("out_of_range_share_count", "SELECT count(*) FROM persistence WHERE abs(low_occupancy_share - 0.5) > 0.5"),
        _check("out_of_window_count", f"""SELECT count(*) FROM persistence
            WHERE first_year NOT BETWEEN {FIRST} AND last_year OR last_year > {LAST}"""),
        _check("negative_volatility_count", "SELECT count(*) FILTER (demand_volatility < 0) FROM persistence"),
        _check("unmeasurable_flagged_low_count", """SELECT count(*) FILTER (is_low_occupancy AND NOT has_measurable_occupancy)
            FROM panel"""),
    )
    sql["feature_checks"] = _all(
        _check("temporal_leakage_count", """SELECT count(*) FROM (
            SELECT institution_id, course_id, teaching_modality, count(*) AS a,
                   count(*) FILTER (has_measurable_occupancy) AS b, count(*) FILTER (is_low_occupancy) AS c
            FROM panel WHERE census_year <= 1998 GROUP BY ALL) AS x
            JOIN features AS f USING (institution_id, course_id, teaching_modality)
            WHERE reference_year = 1998 AND (a, b, c) <> (years_observed_to_date, measurable_years_to_date,
                                                          low_occupancy_years_to_date)"""),
        _check("impossible_history_count", f"""SELECT count(*) FROM features
            WHERE years_observed_to_date > reference_year - {FIRST - 1}
               OR measurable_years_to_date > years_observed_to_date
               OR greatest(low_occupancy_years_to_date, current_low_occupancy_streak) > measurable_years_to_date"""),
        _check("out_of_range_hhi_count", """SELECT count(*) FROM features
            WHERE institution_enrollment_hhi NOT BETWEEN 0 AND 1.0000001"""),
        _check("label_beyond_series_count", f"""SELECT count(deteriorated) FROM labels
            WHERE reference_year > {LAST - 2}"""),
        _check("inconsistent_disappearance_count", """SELECT count(*) FROM labels
            WHERE label_is_observable AND disappeared_from_census AND coalesce(deteriorated, FALSE) = FALSE"""),
        _check("false_positive_label_count", """SELECT count(*) FILTER (deteriorated) FROM labels
            WHERE label_is_observable AND NOT disappeared_from_census AND base_enrollments > 0
              AND horizon_enrollments >= base_enrollments"""),
        _check("overlapping_split_count", """SELECT count(*) FROM (SELECT reference_year FROM training
            GROUP BY 1 HAVING count(DISTINCT split) > 1)"""),
        _check("non_chronological_split_count", """SELECT count(*) FROM training WHERE split = 'teste'
            AND reference_year <= (SELECT max(reference_year) FROM training WHERE split = 'treino')"""),
        _check("undetermined_label_count", "SELECT count(*) - count(deteriorated) FROM training"),
    )
    sql["modality_checks"] = _all(
        _check("invalid_modality_state_count", """SELECT count(*) FROM state
            WHERE modality_state NOT IN ('dual', 'ead', 'presencial')"""),
        _check("invalid_transition_year_count", """SELECT count(*) FROM transitions
            WHERE census_year <= (SELECT min(census_year) FROM supply)
               OR census_year > (SELECT max(census_year) FROM supply)"""),
        _check("invalid_dependency_share_count", """SELECT count(*) FROM dependency
            WHERE abs(ead_seat_share - 0.5) > 0.5 OR abs(ead_entrant_share - 0.5) > 0.5"""),
        _check("invalid_lag_count", """SELECT count(*) FROM lagged
            WHERE lag_years NOT IN (3, 4, 5) OR entrant_year + lag_years <> census_year"""),
        _check("invalid_eligibility_count", """SELECT count(*) FROM lagged
            WHERE is_eligible IS DISTINCT FROM lagged_entrants > 19"""),
    )

    def spoilt_by(name, *parts):
        return re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(parts)})\b", r"\1\2bad_\3", sql[name])

    sql["spoilt_persistence_checks"] = spoilt_by("persistence_checks", "snapshot_rows", "edition_rows", "persistence", "panel")
    sql["spoilt_feature_checks"] = spoilt_by("feature_checks", "features", "labels", "training")
    sql["spoilt_modality_checks"] = spoilt_by("modality_checks", "state", "transitions", "dependency", "lagged")

    # Model
    sql["chronological_split"] = """
        SELECT split, reference_year, count(*) AS rows, count(*) FILTER (deteriorated) AS events
        FROM training GROUP BY split, reference_year"""
    sql["preprocessor_statistics"] = _all(*[_statistic(n) for n in _NUMERIC])
    sql["category_levels"] = _all(
        *[_levels(n) for n in ("teaching_modality", "education_network", "administrative_category")]
    )
    sql["window_statistics"] = _all(
        *[_window_statistic(n, w, years) for w, years in training_windows().items() for n in _NUMERIC])
    # A fit is proved by a gradient of zero for each of its inputs.
    sql["reference_model_gradient"] = _all(
        *[f"SELECT 'numeric__{_FULL_NAME.get(n, n)}' AS feature, 0.0::DOUBLE AS gradient FROM train_rows HAVING count({n}) > 0"
          for n in _NUMERIC],
        *[f"""SELECT 'categorical__{n}_' || level, 0.0::DOUBLE FROM (
              SELECT level, row_number() OVER (ORDER BY is_rare, level) AS place FROM (
                  SELECT DISTINCT CASE WHEN is_rare THEN 'infrequent' ELSE CAST(level AS VARCHAR) END AS level, is_rare
                  FROM ({_levels(n)}))) WHERE place > 1"""
          for n in ("teaching_modality", "education_network", "administrative_category")],
        "SELECT 'intercept', 0.0::DOUBLE",
    )
    sql["reference_model_convergence"] = """
        SELECT count(*) AS n, TRUE AS gradient_vanishes, TRUE AS few_steps FROM train_rows"""
    sql["size_model_coefficients"] = f"""
        SELECT unnest(['numeric__offered_seats', 'numeric__enrollments', 'intercept']) AS feature,
               round(unnest([w1, w2, w0]), 7) AS coefficient FROM newton_step{NEWTON_STEPS}"""
    sql["isotonic_fit"] = """
        SELECT a.value, round(max(a.least), 10) AS mean FROM (
            SELECT i.value, j.place, min(j.events / j.n) AS least FROM isotonic_points AS i
            JOIN isotonic_stretches AS j ON j.place <= i.place AND j.last >= i.place GROUP BY i.value, j.place) AS a
        GROUP BY a.value"""
    sql["large_top_ranks"] = f"""
        SELECT {_ROW}, CAST(place AS BIGINT) AS position FROM (
            SELECT {_ROW}, row_number() OVER (ORDER BY score DESC, {_ROW}) AS place, count(*) OVER () AS n
            FROM scored WHERE split = 'treino') WHERE place <= n // 2"""
    sql["boosted_first_split"] = f"""
        SELECT feature, cut, missing_left, round(-0.05 * gl / hl, 9) AS left_value, round(-0.05 * gr / hr, 9) AS right_value
        FROM (SELECT * FROM boosted_gains ORDER BY gain DESC, place, missing_left, cut LIMIT 1)"""
    sql["scale_ablation"] = _metrics("sized", "apenas_escala", probability=False)
    sql["ranking_metrics"] = _metrics("scored", "size", probability=True)
    sql["precision_at_k"] = f"""
        SELECT 'size' AS model_name, split, CAST(k AS INTEGER) AS k, round(avg(label), 10) AS precision
        FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY score DESC, {_ROW}) AS place,
                     count(*) OVER (PARTITION BY split) AS n FROM scored)
        JOIN (VALUES (100), (500), (1000), (5000)) AS v(k) ON place <= k AND k <= n GROUP BY split, k"""
    sql["calibration_table"] = f"""
        SELECT CAST(bin AS INTEGER) AS bin, count(*) AS row_count, round(avg(score), 10) AS mean_predicted,
               round(avg(label), 10) AS observed_rate
        FROM (SELECT r.score, r.label,
                     least((SELECT count(DISTINCT e.edge) FROM cuts AS e WHERE e.edge <= r.score) - 1,
                           (SELECT count(DISTINCT edge) FROM cuts) - 2) AS bin
              FROM scored AS r WHERE split = 'teste')
        GROUP BY 1"""
    sql["top_k_overlap"] = f"""
        SELECT CAST(count(*) FILTER (n = 2) AS DOUBLE) / count(*) AS jaccard
        FROM (SELECT {_ROW}, count(*) AS n FROM (
                (SELECT {_ROW} FROM training WHERE split = 'teste' ORDER BY enrollments DESC, {_ROW} LIMIT 100)
                UNION ALL
                (SELECT {_ROW} FROM training WHERE split = 'teste'
                 ORDER BY offered_seats DESC NULLS LAST, {_ROW} LIMIT 100)) GROUP BY ALL)"""
    return {name: _with(text) for name, text in sql.items()}


# Quantile edges of the test scores: position i * (n - 1) / bins, interpolated.
PARTS["placed"] = """
SELECT score, row_number() OVER (ORDER BY score) - 1 AS place, count(*) OVER () AS n
FROM scored WHERE split = 'teste'
"""
# Logistic regression on two inputs of the scorer, with half the squared weights as penalty: each of Newton's steps is a
# subquery, its three equations solved by Cramer's rule.
NEWTON_STEPS = 12
_X1, _X2 = (
    f"(coalesce(CAST({n} AS DOUBLE), {m}::DOUBLE) - {mean}::DOUBLE) / {dev}::DOUBLE" for n, m, mean, dev, _ in SCORER[1:3])
PARTS["newton_points"] = f"SELECT {_X1} AS x1, {_X2} AS x2, CAST(deteriorated AS INTEGER) AS y FROM train_rows"
PARTS["newton_step0"] = "SELECT 0::DOUBLE AS w1, 0::DOUBLE AS w2, 0::DOUBLE AS w0"
for _i in range(1, NEWTON_STEPS + 1):
    PARTS[f"newton_sums{_i}"] = f"""
SELECT w1, w2, w0, sum((p - y) * x1) + w1 AS g1, sum((p - y) * x2) + w2 AS g2, sum(p - y) AS g0,
       sum(p * (1 - p) * x1 * x1) + 1 AS a, sum(p * (1 - p) * x1 * x2) AS b, sum(p * (1 - p) * x1) AS c,
       sum(p * (1 - p) * x2 * x2) + 1 AS d, sum(p * (1 - p) * x2) AS e, sum(p * (1 - p)) AS f
FROM (SELECT *, 1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2))) AS p FROM newton_points CROSS JOIN newton_step{_i - 1})
GROUP BY w1, w2, w0
"""
    PARTS[f"newton_step{_i}"] = f"""
SELECT w1 - (g1 * (d * f - e * e) - b * (g2 * f - e * g0) + c * (g2 * e - d * g0)) / det AS w1,
       w2 - (a * (g2 * f - e * g0) - g1 * (b * f - c * e) + c * (b * g0 - g2 * c)) / det AS w2,
       w0 - (a * (d * g0 - g2 * e) - b * (b * g0 - g2 * c) + g1 * (b * e - d * c)) / det AS w0
FROM (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM newton_sums{_i})
"""

# Rounded log-odds of the calibration year, and all stretches of neighbouring values with their sums.
PARTS["isotonic_points"] = f"""
SELECT value, events, n, row_number() OVER (ORDER BY value) AS place FROM (
    SELECT floor(round(log_odds, 8) * 8) / 8 AS value, count(*) FILTER (deteriorated) AS events, count(*) AS n
    FROM ({_scored(f"SELECT * FROM training WHERE reference_year = {TRAIN_YEARS[1]}")}) GROUP BY 1)
"""
PARTS["isotonic_stretches"] = """
SELECT a.place, b.place AS last, sum(c.events) AS events, sum(c.n) AS n
FROM isotonic_points AS a JOIN isotonic_points AS b ON b.place >= a.place
JOIN isotonic_points AS c ON c.place BETWEEN a.place AND b.place GROUP BY 1, 2
"""
# The gain of every split of the training rows at a value of some feature, with missing values on either side.
BOOSTED_FEATURES = ["years_observed_to_date", "current_low_occupancy_streak", "teaching_modality", "administrative_category"]
PARTS["boosted_values"] = _all(*[
    f"SELECT {i} AS place, '{n}' AS feature, CAST({n} AS DOUBLE) AS value, CAST(deteriorated AS INTEGER) AS y FROM train_rows"
    for i, n in enumerate(BOOSTED_FEATURES)])
PARTS["boosted_sums"] = """
SELECT place, feature, value, count(*) AS n, sum(round((p - y) * 16777216)) AS g, sum(round(p * (1 - p) * 16777216)) AS h
FROM boosted_values, (SELECT avg(y) AS p FROM boosted_values WHERE place = 0) GROUP BY 1, 2, 3
"""
PARTS["boosted_sides"] = """
SELECT c.place, c.feature, c.value AS cut, m.missing_left,
       sum(s.n) FILTER (s.value <= c.value OR s.value IS NULL AND m.missing_left) AS nl,
       sum(s.g) FILTER (s.value <= c.value OR s.value IS NULL AND m.missing_left) AS gl,
       sum(s.h) FILTER (s.value <= c.value OR s.value IS NULL AND m.missing_left) AS hl,
       sum(s.n) AS n, sum(s.g) AS g, sum(s.h) AS h, count(*) FILTER (s.value IS NULL) AS gone
FROM boosted_sums AS c JOIN boosted_sums AS s ON s.place = c.place
CROSS JOIN (VALUES (FALSE), (TRUE)) AS m(missing_left)
WHERE c.value < (SELECT max(value) FROM boosted_sums AS x WHERE x.place = c.place) GROUP BY 1, 2, 3, 4
"""
PARTS["boosted_gains"] = """
SELECT place, feature, cut, CASE WHEN gone > 0 THEN missing_left ELSE nl > n - nl END AS missing_left,
       gl, hl, g - gl AS gr, h - hl AS hr, gl * gl / hl + (g - gl) * (g - gl) / (h - hl) - g * g / h AS gain
FROM boosted_sides WHERE nl >= 20 AND n - nl >= 20 AND (gone > 0 OR NOT missing_left)
"""
PARTS["cuts"] = f"""
SELECT i, min(score) + (max(score) - min(score)) * (max(i * (n - 1) % {_EDGE_BINS}) / CAST({_EDGE_BINS} AS DOUBLE)) AS edge
FROM placed CROSS JOIN (SELECT unnest(range(0, {_EDGE_BINS + 1})) AS i) AS steps
WHERE place = i * (n - 1) // {_EDGE_BINS}
   OR (place = i * (n - 1) // {_EDGE_BINS} + 1 AND i * (n - 1) % {_EDGE_BINS} > 0)
GROUP BY i
"""
