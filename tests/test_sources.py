"""Edition files, layouts, snapshots and fingerprints."""

import pytest
from pyspark.sql import functions as F

from supplypanel.operators.comparison import compare_fingerprints, fingerprint, jaccard
from supplypanel.plans.staging import stage_courses
from supplypanel.plans.mart import mvp_course_mart
from supplypanel.plans.reports import (
    academic_level_counts, dimension_profile, edition_profile, mvp_by_modality, mvp_overview,
)
from supplypanel.sources import editions, layout, tables

MART_CSV = """NU_ANO_CENSO;TP_DIMENSAO;CO_IES;CO_CURSO;NO_CURSO;CO_CINE_ROTULO;NO_CINE_ROTULO;TP_MODALIDADE_ENSINO;TP_NIVEL_ACADEMICO;QT_CURSO;QT_VG_TOTAL;QT_INSCRITO_TOTAL;QT_ING;QT_MAT;QT_CONC
2023;3;77;9;Têxtil a distância;T9;Fibras;2;1;1;64;31;0;0;0
2023;2;77;9;Têxtil a distância;T9;Fibras;2;1;;0;0;11;29;3
2023;2;77;9;Têxtil a distância;T9;Fibras;2;1;;0;0;5;8;1
2023;1;77;4;Ótica;\"\"\"O4\"\"\";Lentes e ótica;1;1;1;18;40;12;33;7
2023;4;77;9;Fora;T9;Fibras;2;1;1;999;999;99;99;99
2023;2;78;5;Música;M5;Sons;2;1;;0;0;2;6;0
"""


@pytest.fixture(scope="module")
def mart_file(tmp_path_factory):
    folder = tmp_path_factory.mktemp("edition")
    path = folder / "MICRODADOS_CADASTRO_CURSOS_2023.CSV"
    path.write_text(MART_CSV, encoding="latin-1")
    (folder / "~$MICRODADOS_CADASTRO_CURSOS_2023.CSV").write_text("lock", encoding="latin-1")
    (folder / "MICRODADOS_CADASTRO_IES_2023.csv").write_text(
        "NU_ANO_CENSO;CO_IES\n2023;77\n2023;78\n", encoding="latin-1"
    )
    return str(path)


def test_edition_is_text_with_quotes_and_accents(spark, mart_file):
    table = editions.read_edition(spark, mart_file)
    assert {t for _, t in table.dtypes} == {"string"}
    first = table.where("CO_CURSO = '4'").first()
    assert (first.CO_CINE_ROTULO, first.NO_CINE_ROTULO) == ('"O4"', "Lentes e ótica")
    assert editions.read_edition(spark, mart_file, ["CO_IES"]).columns == ["CO_IES"]


def test_written_edition_reads_back(spark, mart_file, tmp_path):
    table = editions.read_edition(spark, mart_file)
    editions.write_edition(table, str(tmp_path / "again"))
    again = editions.read_edition(spark, str(tmp_path / "again"))
    assert fingerprint(again, "t").first() == fingerprint(table, "t").first()


def test_mart_of_an_edition(spark, mart_file):
    mart = mvp_course_mart(editions.read_edition(spark, mart_file)).cache()
    assert mart.count() == 3
    distance = mart.where("co_curso = 9").first()
    assert (distance.qt_vg_total, distance.qt_ing, distance.qt_mat) == (64, 11 + 5, 29 + 8)
    assert distance.seat_occupancy_rate == 16 / 64
    assert mvp_overview(mart).first().unique_key
    assert mvp_by_modality(mart).count() == 2


def test_mart_falls_back_to_student_labels_and_tolerates_text(spark, mart_file):
    table = editions.read_edition(spark, mart_file).where("CO_CURSO = '5'")
    row = mvp_course_mart(table.withColumn("QT_CONC", F.lit("n/d"))).first()
    assert (row.no_curso, row.qt_conc, row.qt_vg_total) == ("Música", 0, None)
    assert row.missing_capacity_component and not row.missing_student_component


def test_files_of_a_folder(spark, mart_file):
    folder = mart_file.rsplit("/", 1)[0]
    files = {(r.kind, r.year) for r in editions.edition_files(spark, folder).collect()}
    assert files == {("cursos", 2023), ("ies", 2023)}
    chosen = editions.select_edition_files(spark, folder)
    assert chosen["cursos"].endswith("CURSOS_2023.CSV") and chosen["ies"].endswith("IES_2023.csv")


def test_two_course_files_are_refused(spark, tmp_path):
    for name in ("CURSOS_A_2024.CSV", "CURSOS_B_2024.CSV"):
        (tmp_path / name).write_text("A\n1\n")
    with pytest.raises(ValueError, match="found 2"):
        editions.select_edition_files(spark, str(tmp_path))


def test_a_package_has_one_year(spark, tmp_path):
    for name in ("CURSOS_2023.CSV", "IES_2024.CSV"):
        (tmp_path / name).write_text("A\n1\n")
    with pytest.raises(ValueError, match="different years"):
        editions.select_edition_files(spark, str(tmp_path))


def test_file_profile(spark, mart_file):
    row = editions.profile_files(spark, [mart_file]).first()
    assert (row.data_row_count, row.column_count, row.columns[0]) == (6, 15, "NU_ANO_CENSO")


def test_edition_names():
    assert editions.edition_of("MICRODADOS_ED_SUP_IES_2022.CSV") == (2022, "ies")
    assert editions.edition_of("MICRODADOS_CADASTRO_CURSOS_2022.CSV") == (2022, "cursos")
    with pytest.raises(ValueError, match="no year"):
        editions.edition_of("CURSOS.CSV")
    with pytest.raises(ValueError, match="ambiguous"):
        editions.edition_of("CURSOS_2021_2022.CSV")
    with pytest.raises(ValueError, match="neither"):
        editions.edition_of("ALUNOS_2022.CSV")


# --- Layouts ------------------------------------------------------------------------

LAYOUTS = {
    2016: {"cursos": ["QT_MAT", "CO_CINE_ROTULO2", "TP_REDE", "NU_TURMAS"], "ies": ["CO_IES", "SG_IES", "NO_IES"]},
    2017: {"cursos": ["TP_REDE", "QT_MAT", "CO_CINE_ROTULO"], "ies": ["NO_IES", "CO_IES", "SG_IES"]},
    2018: {"cursos": ["CO_CINE_ROTULO", "TP_REDE", "QT_MAT", "IN_NOVO"], "ies": ["SG_IES", "CO_IES", "NO_IES"]},
    2019: {"cursos": ["QT_MAT", "TP_REDE", "CO_CINE_ROTULO"], "ies": ["CO_IES", "SG_IES", "NO_IES", "IN_POLO"]},
}


def test_common_and_single_columns(spark):
    layouts = layout.layout_table(spark, LAYOUTS)
    common = [r.column_name for r in layout.common_columns(layouts, "cursos").collect()]
    assert common == ["QT_MAT", "TP_REDE", "CO_CINE_ROTULO"]  # in the newest edition's order
    single = {r.year: r.columns for r in layout.single_edition_columns(layouts, "cursos").collect()}
    assert single == {2016: ["NU_TURMAS"], 2017: [], 2018: ["IN_NOVO"], 2019: []}
    drift = layout.layout_drift(layouts)
    assert drift.where("kind = 'ies' and common_column_count = 3").count() == 4


def test_missing_table(spark):
    broken = {**LAYOUTS, 2022: {"cursos": ["QT_MAT"]}}
    layouts = layout.layout_table(spark, broken)
    assert [r.year for r in layout.missing_tables(layouts, "ies").collect()] == [2022]
    with pytest.raises(ValueError, match="2022"):
        layout.require_tables(layouts, "ies")
    assert layout.require_tables(layouts, "cursos") is layouts


def test_dictionary_diff(spark):
    layouts = layout.layout_table(spark, {2024: {"cursos": ["A", "B"]}})
    dictionary = spark.createDataFrame([("cursos", "B"), ("cursos", "C")], "kind string, variable string")
    sides = {r.column_name: r.side for r in layout.dictionary_diff(layouts, dictionary).collect()}
    assert sides == {"A": "missing_in_dictionary", "C": "missing_in_file"}


def test_union_rules(spark):
    one = spark.createDataFrame([("1", "x")], "CO_CURSO string, CO_CINE_ROTULO2 string")
    two = spark.createDataFrame([("y", "2", "z")], "CO_CINE_ROTULO string, CO_CURSO string, CO_PROJETO string")
    joined = layout.union_editions({2021: two, 2020: one})
    assert joined.columns == ["co_cine_rotulo", "co_curso"]
    assert {tuple(r) for r in joined.collect()} == {("x", "1"), ("y", "2")}
    with pytest.raises(ValueError, match="two editions"):
        layout.union_editions({2021: two})
    with pytest.raises(ValueError, match="repeated"):
        layout.union_editions({2020: one.withColumn("CO_CINE_ROTULO", F.lit("w")), 2021: two})
    with pytest.raises(ValueError, match="not column names"):
        layout.validated_columns(["9BAD"])


def test_control_match(spark):
    manifest = spark.createDataFrame([("CURSOS.CSV", 1), ("IES.CSV", 2)], "table_name string, content_hash int")
    control = spark.createDataFrame([("cursos.csv", 1), ("outro.csv", 2)], "table_name string, content_hash int")
    found = {r.table_name: r for r in layout.control_match(manifest, control).collect()}
    assert found["CURSOS.CSV"].content_matches and found["CURSOS.CSV"].name_matches
    assert found["IES.CSV"].content_matches and not found["IES.CSV"].name_matches


# --- Profiles and tables --------------------------------------------------------------


def test_quality_profile(spark):
    names = (
        "nu_ano_censo tp_dimensao co_regiao co_uf co_municipio co_ies co_curso tp_modalidade_ensino "
        "tp_nivel_academico tp_grau_academico qt_curso qt_vg_total qt_inscrito_total qt_ing qt_mat qt_conc"
    ).split()
    # On site with everything; distance students in a town; a national offer without place or graduates; a repeat abroad.
    rows = [
        ["2019", "1", "1", "12", "77", "5", "6", "1", "1", "2", "1", "25", "44", "19", "61", "8"],
        ["2019", "2", "1", "12", "77", "5", "7", "2", "1", "2", "0", "0", "0", "3", "13", "2"],
        ["2019", "3", "", "", "", "5", "7", "2", "1", "2", "1", "70", "21", "0", "0", ""],
        ["2019", "2", "1", "12", "77", "5", "7", "2", "1", "2", "0", "0", "0", "4", "9", "0"],
    ]
    raw = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    profile = edition_profile(raw).first()
    assert (profile.row_count, profile.candidate_key_is_unique, profile.null_co_uf) == (4, False, 1)
    by_dimension = {r.dimension: r for r in dimension_profile(raw).collect()}
    assert by_dimension[1].vg_total_sum == 25 and by_dimension[2].ing_sum == 3 + 4
    assert by_dimension[3].geography_complete_row_count == 0
    assert by_dimension[3].conc_non_null == 0 and by_dimension[3].conc_non_zero == 1
    assert academic_level_counts(raw).first().row_count == 4


def test_bad_text_fails_in_staging(spark):
    from tests.census_fixture import raw_courses

    raw = raw_courses(spark).withColumn("qt_ing", F.lit("many"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        stage_courses(raw).collect()


def test_fingerprints_and_jaccard(spark):
    a = spark.range(10).withColumn("x", F.col("id") * 2)
    same = a.orderBy(F.desc("id"))
    other = a.withColumn("x", F.col("x") + 1)
    assert compare_fingerprints(fingerprint(a, "t"), fingerprint(same, "t")).first().matches
    assert not compare_fingerprints(fingerprint(a, "t"), fingerprint(other, "t")).first().matches
    assert jaccard(spark.range(0, 6), spark.range(4, 10), ["id"]).first().jaccard == 0.2


def test_shared_folder_is_the_session_setting(spark):
    assert tables.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = tables.written(spark.range(3), "three")
    assert kept.count() == 3 and "three" in kept.inputFiles()[0]
