"""Report sections over the snapshot and over the raw-text mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplypanel.functions.columns import dimension_label, lenient, safe_ratio
from supplypanel.operators.concentration import herfindahl, running_share
from supplypanel.operators.ranking import top_per_group
from supplypanel.plans.mart import RAW_KEYS, RAW_STUDENTS, RAW_CAPACITY

CONCENTRATION_POSITIONS = (1, 5, 10, 20, 50)


def modality_series(snapshot: DataFrame) -> DataFrame:
    """Seats, entrants and occupancy by year and modality; no seats counts as 0."""
    return (
        snapshot.groupBy("census_year", "teaching_modality")
        .agg(F.sum("offered_seats").alias("seats"), F.sum("entrants").alias("entrants"))
        .withColumn(
            "occupancy",
            F.when(F.coalesce("seats", F.lit(0)) == 0, F.lit(0.0)).otherwise(
                safe_ratio("entrants", "seats")
            ),
        )
        .orderBy("census_year", "teaching_modality")
    )


def _with_capacity(snapshot: DataFrame, year: int) -> DataFrame:
    return snapshot.where((F.col("census_year") == year) & (F.col("offered_seats") > 0))


def _unconverted():
    return F.sum(F.col("offered_seats") - F.col("entrants")).alias("unconverted")


def top_unconverted_institutions(
    snapshot: DataFrame, institutions: DataFrame, year: int, n: int = 12
) -> DataFrame:
    """Institutions with most seats left without entrants.

    Offers are summed per institution before the names are joined, so the
    join carries one row per institution.
    """
    per_institution = (
        _with_capacity(snapshot, year)
        .groupBy("institution_id")
        .agg(
            _unconverted(),
            safe_ratio(F.sum("entrants"), F.sum("offered_seats")).alias("occupancy"),
            F.count(F.lit(1)).alias("offers"),
        )
    )
    names = institutions.where(F.col("census_year") == year).select(
        "institution_id", "institution_name", "institution_state"
    )
    return (
        per_institution.join(names, "institution_id", "left")
        .select(
            "institution_id",
            F.coalesce("institution_name", F.concat(F.lit("IES "), "institution_id")).alias(
                "institution_name"
            ),
            "institution_state", "unconverted", "occupancy", "offers",
        )
        .orderBy(F.desc_nulls_first("unconverted"), "institution_id")
        .limit(n)
    )


def unconverted_concentration(
    snapshot: DataFrame, year: int, positions=CONCENTRATION_POSITIONS
) -> DataFrame:
    """Share of all unconverted seats held by the first 1, 5, 10… institutions."""
    members = _with_capacity(snapshot, year).groupBy("institution_id").agg(_unconverted())
    return running_share(members, "unconverted", ["institution_id"], positions)


def capacity_totals(snapshot: DataFrame, year: int) -> DataFrame:
    return _with_capacity(snapshot, year).agg(
        F.countDistinct("institution_id").alias("institutions"),
        _unconverted(),
        F.sum("offered_seats").alias("seats"),
    )


# --- Over the mart of raw text --------------------------------------------------


def mvp_by_modality(mart: DataFrame) -> DataFrame:
    """Size, occupancy and graduation intensity of each modality of an edition."""

    def total(column):  # an all-null sum is zero here
        return F.coalesce(F.sum(column), F.lit(0))

    return (
        mart.groupBy(
            F.col("nu_ano_censo").alias("census_year"), F.col("tp_modalidade_ensino").alias("modality_code")
        )
        .agg(
            F.count(F.lit(1)).alias("course_offerings"),
            F.countDistinct("co_ies").alias("institutions"),
            total("qt_vg_total").alias("offered_seats"),
            total("qt_inscrito_total").alias("applications"),
            total("qt_ing").alias("entrants"),
            total("qt_mat").alias("enrollments"),
            total("qt_conc").alias("graduates"),
        )
        .withColumns(
            {
                "weighted_seat_occupancy_rate": F.round(safe_ratio("entrants", "offered_seats"), 6),
                "graduation_intensity": F.round(safe_ratio("graduates", "enrollments"), 6),
            }
        )
        .orderBy("census_year", "modality_code")
    )


def _named(ranked: DataFrame, institutions: DataFrame | None, key: str) -> DataFrame:
    if institutions is None:
        return ranked.withColumn("institution_name", F.lit(None).cast("string"))
    names = institutions.select(
        lenient("co_ies", "bigint").alias(key), F.col("no_ies").alias("institution_name")
    ).groupBy(key).agg(F.max("institution_name").alias("institution_name"))
    return ranked.join(names, key, "left")


def mvp_concentration(mart: DataFrame, institutions: DataFrame | None = None, top: int = 10) -> DataFrame:
    """Each edition's most concentrated institutions with enough courses and students."""
    courses = mart.groupBy("nu_ano_censo", "co_ies", "co_curso").agg(
        F.coalesce(F.sum("qt_mat"), F.lit(0)).alias("qt_mat")
    )
    ranked = (
        courses.groupBy(
            F.col("nu_ano_censo").alias("census_year"), F.col("co_ies").alias("institution_id")
        )
        .agg(
            herfindahl("qt_mat").alias("enrollment_hhi"),
            F.count(F.lit(1)).alias("course_count"),
            F.sum("qt_mat").alias("enrollments"),
        )
        .where("course_count >= 5 and enrollments >= 1000")
    )
    ranked = top_per_group(
        ranked, ["census_year"],
        [F.round("enrollment_hhi", 9).desc_nulls_last(), F.col("institution_id")], top,
    )
    return (
        _named(ranked, institutions, "institution_id")
        .select(
            "census_year", "institution_id", "institution_name",
            F.round("enrollment_hhi", 6).alias("enrollment_hhi"), "course_count", "enrollments",
        )
        .orderBy("census_year", F.desc("enrollment_hhi"), "institution_id")
    )


def mvp_idle(mart: DataFrame, institutions: DataFrame | None = None, top: int = 10) -> DataFrame:
    """Each edition's offers with most seats left, among those of some size."""
    order = [
        F.desc_nulls_last("unconverted_seat_capacity"), "nu_ano_censo", "co_ies", "co_curso",
        "tp_modalidade_ensino",
    ]
    sized = mart.where((F.col("qt_vg_total") >= 100) & F.col("seat_occupancy_rate").isNotNull())
    ranked = top_per_group(sized, ["nu_ano_censo"], order, top)
    return (
        _named(ranked, institutions, "co_ies")
        .orderBy(*order)
        .select(
            F.col("nu_ano_censo").alias("census_year"),
            F.col("co_ies").alias("institution_id"),
            "institution_name",
            F.col("co_curso").alias("course_id"),
            F.col("no_curso").alias("course_name"),
            F.col("tp_modalidade_ensino").alias("modality_code"),
            F.col("qt_vg_total").alias("offered_seats"),
            F.col("qt_ing").alias("entrants"),
            F.round("seat_occupancy_rate", 6).alias("seat_occupancy_rate"),
            "unconverted_seat_capacity",
        )
    )


def mvp_overview(mart: DataFrame) -> DataFrame:
    """Rows, whether the key is unique, and how often a family is missing.

    Counted per key and then overall, so that the mart is computed once.
    """
    per_key = mart.groupBy(*RAW_KEYS).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if("missing_capacity_component").alias("_no_capacity"),
        F.count_if("missing_student_component").alias("_no_students"),
    )

    def total(column):
        return F.coalesce(F.sum(column), F.lit(0))

    return per_key.agg(
        total("_rows").alias("row_count"),
        (F.count_if(F.col("_rows") > 1) == 0).alias("unique_key"),
        total("_no_capacity").alias("missing_capacity"),
        total("_no_students").alias("missing_students"),
    )


# --- Profile of an edition's raw course table -------------------------------------

# The profiled columns and the candidate key of the course file.
PROFILE_COLUMNS = [
    "nu_ano_censo", "tp_dimensao", "co_regiao", "co_uf", "co_municipio", "co_ies", "co_curso",
    "tp_modalidade_ensino", "tp_nivel_academico", "tp_grau_academico",
    *RAW_CAPACITY, *RAW_STUDENTS,
]
CANDIDATE_KEY = ["tp_dimensao", "co_ies", "co_curso", "co_municipio", "tp_modalidade_ensino"]


def _profiled(raw: DataFrame) -> DataFrame:
    return raw.select(*[lenient(c, "bigint").alias(c) for c in PROFILE_COLUMNS])


def dimension_profile(raw: DataFrame) -> DataFrame:
    """Control counts and sums of each dimension of an edition.

    ``non_zero`` counts nulls too: a missing value is not equal to zero.
    """
    measures = [*RAW_CAPACITY, *RAW_STUDENTS]
    per_measure = []
    for m in measures:
        short = m.removeprefix("qt_")
        per_measure += [
            F.count(m).alias(f"{short}_non_null"),
            F.count_if(F.col(m).isNull() | (F.col(m) != 0)).alias(f"{short}_non_zero"),
            F.coalesce(F.sum(m), F.lit(0)).alias(f"{short}_sum"),
        ]
    located = (
        F.col("co_regiao").isNotNull() & F.col("co_uf").isNotNull() & F.col("co_municipio").isNotNull()
    )

    # Sums by the few codes, then by dimension; distinct counts from the keys alone. Both
    # are small for each task before they are shuffled, and no row is a set or is expanded.
    rows = _profiled(raw)
    code_columns = {"modalities": "tp_modalidade_ensino", "academic_levels": "tp_nivel_academico"}
    by_code = rows.groupBy("nu_ano_censo", "tp_dimensao", *code_columns.values()).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(located).alias("geography_complete_row_count"),
        *per_measure,
    )
    added = [
        "row_count", "geography_complete_row_count",
        *[f"{m.removeprefix('qt_')}_{kind}" for m in measures for kind in ("non_null", "non_zero", "sum")],
    ]

    def codes(name, column):  # small code domains, listed in order
        return F.array_join(F.array_sort(F.collect_set(column)), ",").alias(name)

    totals = by_code.groupBy("nu_ano_censo", "tp_dimensao").agg(
        *[F.sum(name).alias(name) for name in added], *[codes(*pair) for pair in code_columns.items()])
    keys = {"distinct_ies_count": "co_ies", "distinct_course_count": "co_curso"}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).alias("key")) for name, c in keys.items()]))
    distinct = (
        rows.select("nu_ano_censo", "tp_dimensao", each.alias("_")).select("nu_ano_censo", "tp_dimensao", "_.*").distinct()
        .groupBy(F.col("nu_ano_censo").alias("_year"), F.col("tp_dimensao").alias("_dimension"))
        .agg(*[F.count_if((F.col("name") == name) & F.col("key").isNotNull()).alias(name) for name in keys])
    )
    same = F.col("nu_ano_censo").eqNullSafe(F.col("_year")) & F.col("tp_dimensao").eqNullSafe(F.col("_dimension"))
    return (
        totals.join(distinct, same)
        .select(
            F.col("nu_ano_censo").alias("census_year"), F.col("tp_dimensao").alias("dimension"), *added, *code_columns, *keys)
        .withColumn("label", dimension_label("dimension"))
        .orderBy("census_year", "dimension")
    )


def edition_profile(raw: DataFrame) -> DataFrame:
    """Of each edition: row count, rows in a repeated key, and nulls of every profiled column.

    Counted per candidate key and then per edition, in one scan.
    """
    per_key = _profiled(raw).groupBy("nu_ano_censo", *CANDIDATE_KEY).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in PROFILE_COLUMNS],
    )
    repeated = F.coalesce(F.sum(F.when(F.col("_rows") > 1, F.col("_rows"))), F.lit(0))
    return per_key.groupBy(F.col("nu_ano_censo").alias("census_year")).agg(
        F.sum("_rows").alias("row_count"),
        repeated.alias("rows_in_duplicated_candidate_key"),
        (repeated == 0).alias("candidate_key_is_unique"),
        *[F.sum(f"null_{c}").alias(f"null_{c}") for c in PROFILE_COLUMNS],
    ).orderBy("census_year")


def academic_level_counts(raw: DataFrame) -> DataFrame:
    level = lenient("tp_nivel_academico", "int").alias("academic_level")
    year = lenient("nu_ano_censo", "bigint").alias("census_year")
    return (
        raw.groupBy(year, level).agg(F.count(F.lit(1)).alias("row_count"))
        .where(F.col("academic_level").isNotNull())
        .orderBy("census_year", "academic_level")
    )
