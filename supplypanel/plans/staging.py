"""Raw text to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from supplypanel.functions.columns import typed

# Raw column, staged column, type.
COURSES = [
    ("nu_ano_censo", "census_year", "smallint"),
    ("tp_dimensao", "dimension_type", "smallint"),
    ("co_regiao", "region_code", "smallint"),
    ("co_uf", "state_code", "smallint"),
    ("co_municipio", "municipality_code", "int"),
    ("co_ies", "institution_id", "int"),
    ("co_curso", "course_id", "bigint"),
    ("no_curso", "course_name", "string"),
    ("co_cine_rotulo", "cine_label_code", "string"),
    ("no_cine_rotulo", "cine_label_name", "string"),
    ("tp_modalidade_ensino", "teaching_modality", "smallint"),
    ("tp_nivel_academico", "academic_level", "smallint"),
    ("tp_grau_academico", "academic_degree", "smallint"),
    ("tp_rede", "education_network", "smallint"),
    ("tp_categoria_administrativa", "administrative_category", "smallint"),
    ("tp_organizacao_academica", "academic_organization", "smallint"),
    ("qt_curso", "course_count", "bigint"),
    ("qt_vg_total", "offered_seats", "bigint"),
    ("qt_inscrito_total", "applications", "bigint"),
    ("qt_ing", "entrants", "bigint"),
    ("qt_mat", "enrollments", "bigint"),
    ("qt_conc", "graduates", "bigint"),
]
INSTITUTIONS = [
    ("nu_ano_censo", "census_year", "smallint"),
    ("co_ies", "institution_id", "int"),
    ("no_ies", "institution_name", "string"),
    ("sg_ies", "institution_abbreviation", "string"),
    ("tp_organizacao_academica", "academic_organization", "smallint"),
    ("tp_rede", "education_network", "smallint"),
    ("tp_categoria_administrativa", "administrative_category", "smallint"),
    ("co_municipio_ies", "institution_municipality_code", "int"),
    ("sg_uf_ies", "institution_state", "string"),
]
# The newest single-edition course table has no network, category or
# organization of its own; there they come from the institution.
SINGLE_EDITION_OMITS = {"education_network", "administrative_category", "academic_organization"}


def _stage(raw: DataFrame, columns, omit=()) -> DataFrame:
    return raw.select(*[typed(r, t).alias(name) for r, name, t in columns if name not in omit])


def stage_courses(raw: DataFrame, single_edition: bool = False) -> DataFrame:
    return _stage(raw, COURSES, SINGLE_EDITION_OMITS if single_edition else ())


def stage_institutions(raw: DataFrame, single_edition: bool = False) -> DataFrame:
    """The series leaves out the network, which older editions do not have."""
    return _stage(raw, INSTITUTIONS, () if single_edition else {"education_network"})
