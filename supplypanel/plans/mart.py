"""The supply mart: one row per offer and year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplypanel.functions.columns import lenient, safe_ratio, supply_indicators
from supplypanel.operators.concentration import herfindahl
from supplypanel.operators.reconcile import failing_where, reconcile
from supplypanel.sources.versions import reload

# Staged column names.
KEYS = ["census_year", "institution_id", "course_id", "teaching_modality"]
OFFER = ["institution_id", "course_id", "teaching_modality"]
LABELS = [
    "course_name", "cine_label_code", "cine_label_name",
    "education_network", "administrative_category",
]
CAPACITY = ["course_count", "offered_seats", "applications"]
STUDENTS = ["entrants", "enrollments", "graduates"]


def course_supply(courses: DataFrame, buckets: int | None = None, unique: bool = True) -> DataFrame:
    """Undergraduate supply per offer and year, without double counting.

    On-site rows carry everything; distance capacity is national and distance
    students are counted by municipality; supply abroad is never read. Works
    on the series and on a single edition, whose labels are fewer. ``buckets``
    lays the result out by offer for a snapshot of as many buckets. An offer that
    has on-site as well as distance rows in a year would stand twice: the job
    fails with its key, unless ``unique`` is off.
    """
    dimension = F.col("dimension_type")
    labels = [c for c in LABELS if c in courses.columns]
    supply = reconcile(
        courses.where(F.col("academic_level") == 1),
        KEYS,
        capacity=dimension.isin(1, 3),
        students=dimension.isin(1, 2),
        together=dimension == 1,
        labels=labels,
        capacity_measures=CAPACITY,
        student_measures=STUDENTS,
        capacity_count="capacity_source_row_count",
        student_count="student_source_row_count",
        cluster=OFFER if buckets else (),
        partitions=buckets,
        unique="course_supply" if unique else None,
    )
    names = [c for c in labels if c in LABELS[:3]]
    rest = [c for c in labels if c not in names]
    return supply.select(
        *KEYS[:3], *names, KEYS[3], *rest, *CAPACITY, *STUDENTS,
        "capacity_source_row_count", "student_source_row_count",
    )


def course_sustainability(supply: DataFrame, institutions: DataFrame) -> DataFrame:
    """Supply with its institution and the cross-section indicators.

    The single-edition institutions also bring network and category. No join
    hint: Spark broadcasts the institutions where their size allows it.
    """
    wanted = [
        "institution_name", "institution_abbreviation", "education_network",
        "administrative_category", "institution_state",
    ]
    brought = [c for c in wanted if c in institutions.columns and c not in supply.columns]
    context = institutions.select("census_year", "institution_id", *brought)
    joined = supply.join(context, ["census_year", "institution_id"], "left")
    return joined.select(
        *supply.columns, *brought, *[c.alias(name) for name, c in supply_indicators().items()]
    )


def institution_portfolio(supply: DataFrame) -> DataFrame:
    """Concentration of enrolments over an institution's courses.

    A course counts once even if both modalities offer it.
    """
    institution = ["census_year", "institution_id"]
    courses = supply.groupBy(*institution, "course_id").agg(F.sum("enrollments").alias("enrollments"))
    return courses.groupBy(*institution).agg(
        F.sum("enrollments").alias("_enrollments"),
        F.count(F.lit(1)).alias("course_count"),
        herfindahl("enrollments").alias("enrollment_hhi"),
    ).withColumnRenamed("_enrollments", "enrollments")


def supply_snapshot(supply: DataFrame, table: str, buckets: int | None = None) -> DataFrame:
    """The mart as a table: pruned by year, bucketed by offer; a reload writes the years that differ and swaps them in at once.

    A mart laid out with the same number of buckets is not shuffled again.
    """
    return reload(supply, table, partition="census_year", cluster=OFFER, buckets=buckets)


def offer_years(courses: DataFrame) -> DataFrame:
    """The keys of ``course_supply`` alone: what a comparison of keys needs of it."""
    rows = courses.where((F.col("academic_level") == 1) & F.col("dimension_type").isin(1, 2, 3))
    return rows.select(*KEYS).distinct()


# --- The mart read straight from raw text of an edition -----------------------

# Published column names.
RAW_KEYS = ["nu_ano_censo", "co_ies", "co_curso", "tp_modalidade_ensino"]
RAW_LABELS = ["no_curso", "co_cine_rotulo", "no_cine_rotulo"]
RAW_CAPACITY = ["qt_curso", "qt_vg_total", "qt_inscrito_total"]
RAW_STUDENTS = ["qt_ing", "qt_mat", "qt_conc"]


def mvp_course_mart(raw: DataFrame, unique: bool = True) -> DataFrame:
    """Offer-years from raw text, tolerant of bad numbers.

    Unlike ``course_supply``: rows with a null key are dropped, a present
    family whose values are all null sums to zero, and distance labels fall
    back to the student side. Where a label differs within an offer, the
    smallest is taken, since rows of a distributed file have no first. An offer
    with on-site and distance rows in a year fails the job, unless ``unique`` is off.
    """
    dimension = lenient("tp_dimensao", "int")
    capacity, students = dimension.isin(1, 3), dimension.isin(1, 2)
    scoped = raw.where(dimension.isin(1, 2, 3) & (lenient("tp_nivel_academico", "int") == 1))
    rows = scoped.select(
        *[lenient(k, "bigint").alias(k) for k in RAW_KEYS],
        dimension.alias("_dimension"),
        *[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in RAW_LABELS],
        *[lenient(c, "bigint").alias(c) for c in RAW_CAPACITY + RAW_STUDENTS],
    ).dropna(subset=RAW_KEYS)

    # Per dimension first: at most three rows per offer reach the second step.
    per_dimension = rows.groupBy(*RAW_KEYS, "_dimension", *RAW_LABELS).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in RAW_CAPACITY + RAW_STUDENTS]
    )
    capacity = F.col("_dimension").isin(1, 3)
    students = F.col("_dimension").isin(1, 2)
    on_site = F.col("_dimension") == 1
    graduates = F.sum(F.when(students, F.col(RAW_STUDENTS[-1])))
    if unique:
        graduates = failing_where(F.min(on_site) != F.max(on_site), graduates, RAW_KEYS, "mvp_course_mart")
    offers = per_dimension.groupBy(*RAW_KEYS, *([] if unique else [on_site.alias("_on_site")])).agg(
        *[
            F.coalesce(F.min(F.when(capacity, F.col(c))), F.min(F.when(students, F.col(c)))).alias(c)
            for c in RAW_LABELS
        ],
        *[F.sum(F.when(capacity, F.col(c))).alias(c) for c in RAW_CAPACITY],
        *[F.sum(F.when(students, F.col(c))).alias(c) for c in RAW_STUDENTS[:-1]],
        graduates.alias(RAW_STUDENTS[-1]),
        (F.count_if(capacity) == 0).alias("missing_capacity_component"),
        (F.count_if(students) == 0).alias("missing_student_component"),
    )
    return offers.select(
        *RAW_KEYS, *RAW_LABELS, *RAW_CAPACITY, *RAW_STUDENTS,
        "missing_capacity_component", "missing_student_component",
        safe_ratio("qt_ing", "qt_vg_total").alias("seat_occupancy_rate"),
        safe_ratio("qt_inscrito_total", "qt_vg_total").alias("applications_per_seat"),
        (F.col("qt_vg_total") - F.col("qt_ing")).alias("unconverted_seat_capacity"),
        safe_ratio("qt_conc", "qt_mat").alias("graduation_intensity"),
    )
