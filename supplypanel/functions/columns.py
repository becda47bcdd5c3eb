"""Scalar expressions: typing, ratios, flags and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def typed(value: str | Column, data_type: str) -> Column:
    """Blank text becomes null, anything else must parse (ANSI cast)."""
    text = F.nullif(F.trim(_col(value)), F.lit(""))
    return text if data_type == "string" else text.cast(data_type)


def lenient(value: str | Column, data_type: str) -> Column:
    """Text that does not parse becomes null instead of failing.

    Blanks are common and set to null first: a failed parse costs far more.
    """
    return F.nullif(F.trim(_col(value)), F.lit("")).try_cast(data_type)


def safe_ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Double division that is null where the denominator is zero or null."""
    return _col(numerator).cast("double") / F.nullif(_col(denominator).cast("double"), F.lit(0.0))


def growth(current: str | Column, base: str | Column) -> Column:
    return safe_ratio(current, base) - F.lit(1.0)


def sum_where(condition: Column, value: str | Column) -> Column:
    """Sum over the rows that meet the condition; null if there are none."""
    return F.sum(F.when(condition, _col(value)))


def max_where(condition: Column, value: str | Column) -> Column:
    return F.max(F.when(condition, _col(value)))


def all_present(columns) -> Column:
    return reduce(lambda a, b: a & b, [_col(c).isNotNull() for c in columns])


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation that is null, not an error, on zero variance."""
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    return F.covar_pop(x, y) / spread


def supply_indicators() -> dict[str, Column]:
    """Ratios and flags of one offer-year, by name."""
    seats, entrants = F.col("offered_seats"), F.col("entrants")
    return {
        "seat_occupancy_rate": safe_ratio(entrants, seats),
        "applications_per_seat": safe_ratio("applications", seats),
        "unconverted_seat_capacity": seats - entrants,
        "graduation_intensity": safe_ratio("graduates", "enrollments"),
        "has_zero_offered_seats": seats == 0,
        "entrants_exceed_offered_seats": (entrants > seats) & (seats > 0),
        "missing_capacity_component": F.col("capacity_source_row_count").isNull(),
        "missing_student_component": F.col("student_source_row_count").isNull(),
    }


# What each dimension code stands for in the published files.
DIMENSION_LABELS = {
    1: "presencial_brasil",
    2: "ead_alunos_por_localidade_brasil",
    3: "ead_oferta_nacional",
    4: "ead_instituicoes_brasileiras_exterior",
}
UNKNOWN_DIMENSION = "categoria_desconhecida"


def dimension_label(code: str | Column) -> Column:
    label = F.lit(UNKNOWN_DIMENSION)
    for value, name in DIMENSION_LABELS.items():
        label = F.when(_col(code) == value, name).otherwise(label)
    return label
