"""A small census whose figures follow from short formulas, as raw text rows.

Institution 7 teaches on site: botany grows by one entrant a year, ceramics
shrinks and ends in 2023, dance ends in 2018. In 2024 institution 8 opens a
distance course, institution 7 one in botany's field. A row abroad must never
count. The 2019 edition misspells the field column; 2014 and 2015 are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplypanel.sources.layout import union_editions
from supplypanel.sources.lineitem_census import RAW_COURSE_COLUMNS

CERAMICS_ENROLLED = (120, 118, 116, 110, 90, 58, 40, 30)
# course, name, field: year -> seats, applications, entrants, enrolments, graduates
ON_SITE = {
    ("31", "Botânica", "K1"): {2016 + k: (50, 70, 40 + k, 160 + 4 * k, 20 + k) for k in range(9)},
    ("32", "Cerâmica", "K2"): {
        2016 + k: (80, 50, 30 - 3 * k, enrolled, 9) for k, enrolled in enumerate(CERAMICS_ENROLLED)
    },
    ("33", "Dança", "K3"): {2016: (40, 20, 10, 60, 5), 2017: (40, 20, 8, 50, 5), 2018: (40, 20, 4, 30, 5)},
}
# dimension, institution, course, name, field, town, measures, courses
DISTANCE_2024 = [
    (3, 8, "41", "Edição", "K4", "", (900, 400, 0, 0, 0), 1),
    (2, 8, "41", "Edição", "K4", "1100015", (0, 0, 70, 210, 12), 0),
    (2, 8, "41", "Edição", "K4", "1100023", (0, 0, 65, 190, 8), 0),
    (3, 7, "42", "Botânica a distância", "K1", "", (120, 60, 0, 0, 0), 1),
    (2, 7, "42", "Botânica a distância", "K1", "1100015", (0, 0, 30, 70, 6), 0),
    (4, 8, "41", "Edição", "K4", "", (777, 777, 777, 777, 777), 1),
]
INSTITUTIONS = [
    ("2016", "7", "Escola Sete", "E7", "RO"),
    ("2024", "7", "Escola Sete", "E7", "RO"),
    ("2024", "8", "Escola Oito", "E8", "AC"),
]


def _course(year, dimension, institution, course, name, field, town, modality, measures, courses):
    values = {
        "nu_ano_censo": year, "tp_dimensao": dimension, "co_regiao": "1" if town else "",
        "co_uf": "11" if town else "", "co_municipio": town, "co_ies": institution,
        "co_curso": course, "no_curso": name, "co_cine_rotulo": field,
        "no_cine_rotulo": f"Area {field}", "tp_modalidade_ensino": modality,
        "tp_nivel_academico": 1, "tp_grau_academico": 1, "tp_rede": 2,
        "tp_categoria_administrativa": 4, "tp_organizacao_academica": 1, "qt_curso": courses,
        **dict(zip(("qt_vg_total", "qt_inscrito_total", "qt_ing", "qt_mat", "qt_conc"), measures)),
    }
    return [str(values[c]) for c in RAW_COURSE_COLUMNS]


def raw_editions(spark) -> dict[int, DataFrame]:
    schema = ", ".join(f"{c} string" for c in RAW_COURSE_COLUMNS)
    editions = {}
    for year in range(2014, 2025):
        rows = [
            _course(year, 1, 7, course, name, field, "1100015", 1, years[year], 1)
            for (course, name, field), years in ON_SITE.items()
            if year in years
        ]
        if year == 2024:
            rows += [
                _course(year, d, inst, c, name, f, town, 2, m, n)
                for d, inst, c, name, f, town, m, n in DISTANCE_2024
            ]
        table = spark.createDataFrame(rows, schema)
        if year == 2019:
            table = table.withColumnRenamed("co_cine_rotulo", "co_cine_rotulo2")
        editions[year] = table
    return editions


def raw_courses(spark) -> DataFrame:
    return union_editions(raw_editions(spark))


def raw_institutions(spark) -> DataFrame:
    rows = [(y, i, n, s, "1", "4", "1100015", uf) for y, i, n, s, uf in INSTITUTIONS]
    return spark.createDataFrame(
        rows,
        "nu_ano_censo string, co_ies string, no_ies string, sg_ies string, "
        "tp_organizacao_academica string, tp_categoria_administrativa string, "
        "co_municipio_ies string, sg_uf_ies string",
    )


def only(df: DataFrame, **equal):
    """The single row with these values."""
    condition = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in equal.items()])
    rows = df.where(condition).collect()
    assert len(rows) == 1, rows
    return rows[0]
