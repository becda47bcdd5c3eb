"""Column layouts that drift between editions.

A layout table has one row per edition column: ``year, kind, position,
column_name``. It is as small as the headers it describes.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Other spellings of a column, and what a column name looks like.
COLUMN_ALIASES = {"CO_CINE_ROTULO2": "CO_CINE_ROTULO"}
COLUMN_NAME = r"^[A-Z][A-Z0-9_]*$"


def canonical_column(name: str, aliases=COLUMN_ALIASES) -> str:
    return aliases.get(name.upper(), name.upper())


def canonical_name(name: str | Column, aliases=COLUMN_ALIASES) -> Column:
    """The same rule as a column expression."""
    upper = F.upper(F.col(name) if isinstance(name, str) else name)
    result = upper
    for other, canonical in aliases.items():
        result = F.when(upper == other, canonical).otherwise(result)
    return result


def layout_table(spark: SparkSession, layouts: dict[int, dict[str, list[str]]]) -> DataFrame:
    """Layout rows from ``{year: {kind: [columns]}}``."""
    rows = [
        (year, kind, position, name)
        for year, kinds in layouts.items()
        for kind, names in kinds.items()
        for position, name in enumerate(names)
    ]
    return spark.createDataFrame(rows, "year int, kind string, position int, column_name string")


def _spellings(layouts: DataFrame, kind: str, aliases=COLUMN_ALIASES) -> DataFrame:
    return (
        layouts.where(F.col("kind") == kind)
        .groupBy("year", canonical_name("column_name", aliases).alias("column_name"))
        .agg(F.min("position").alias("position"))
    )


def missing_tables(layouts: DataFrame, kind: str) -> DataFrame:
    """Years of the series that have no table of this kind."""
    return (
        layouts.select("year").distinct()
        .join(layouts.where(F.col("kind") == kind).select("year").distinct(), "year", "left_anti")
    )


def require_tables(layouts: DataFrame, kind: str) -> DataFrame:
    """The same layouts, or an error naming the years without a table."""
    missing = sorted(row.year for row in missing_tables(layouts, kind).collect())
    if missing:
        raise ValueError(f"years without a '{kind}' table: {missing}")
    return layouts


def common_columns(layouts: DataFrame, kind: str) -> DataFrame:
    """Columns of every year, ordered as in the newest one."""
    years = layouts.agg(F.countDistinct("year")).scalar()
    newest = layouts.agg(F.max("year")).scalar()
    return (
        _spellings(layouts, kind)
        .groupBy("column_name")
        .agg(
            F.count(F.lit(1)).alias("_years"),
            F.max(F.when(F.col("year") == newest, F.col("position"))).alias("position"),
        )
        .where(F.col("_years") == years)
        .select("column_name", "position")
        .orderBy("position")
    )


def single_edition_columns(layouts: DataFrame, kind: str) -> DataFrame:
    """Columns that exist in one year only; every year has a row."""
    spelled = _spellings(layouts, kind)
    single = (
        spelled.groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("_years"), F.max("year").alias("year"))
        .where("_years = 1")
        .groupBy("year")
        .agg(F.array_sort(F.collect_list("column_name")).alias("columns"))
    )
    return (
        spelled.select("year").distinct()
        .join(single, "year", "left")
        .select("year", F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))
        .orderBy("year")
    )


def layout_drift(layouts: DataFrame, kinds=("cursos", "ies")) -> DataFrame:
    """Per kind and year: how many columns all years share, and the year's own."""
    parts = []
    for kind in kinds:
        shared = common_columns(layouts, kind).agg(F.count(F.lit(1))).scalar()
        parts.append(
            single_edition_columns(layouts, kind).select(
                F.lit(kind).alias("kind"),
                "year",
                shared.alias("common_column_count"),
                F.col("columns").alias("only_this_year"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def dictionary_diff(layouts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Columns without a dictionary entry and entries without a column.

    ``dictionary`` has ``kind, variable``; both sides are compared as written.
    """
    have = layouts.select("year", "kind", "column_name").distinct()
    known = (
        layouts.select("year", "kind").distinct()
        .join(dictionary.select("kind", F.col("variable").alias("column_name")).distinct(), "kind")
    )
    keys = ["year", "kind", "column_name"]
    return (
        have.join(known, keys, "left_anti").select(*keys, F.lit("missing_in_dictionary").alias("side"))
        .unionByName(
            known.join(have, keys, "left_anti").select(*keys, F.lit("missing_in_file").alias("side"))
        )
    )


def control_match(manifest: DataFrame, control: DataFrame) -> DataFrame:
    """Matches tables to a control list by content hash.

    Both have ``table_name, content_hash``. Names are compared without case.
    """
    expected = control.groupBy("content_hash").agg(F.min("table_name").alias("control_name"))
    return manifest.join(expected, "content_hash", "left").select(
        "table_name",
        "content_hash",
        F.col("control_name").isNotNull().alias("content_matches"),
        "control_name",
        F.coalesce(F.lower("control_name") == F.lower("table_name"), F.lit(False)).alias("name_matches"),
    )


def validated_columns(names) -> list[str]:
    """Lower-case column names, or an error for bad or repeated ones."""
    bad = [name for name in names if not re.match(COLUMN_NAME, name.upper())]
    if bad:
        raise ValueError(f"not column names: {bad}")
    lowered = [name.lower() for name in names]
    repeated = sorted({name for name in lowered if lowered.count(name) > 1})
    if repeated:
        raise ValueError(f"repeated columns: {repeated}")
    return lowered


def one_edition(table: DataFrame, aliases=COLUMN_ALIASES) -> DataFrame:
    """One edition by canonical name."""
    return table.toDF(*validated_columns([canonical_column(c, aliases) for c in table.columns]))


def union_editions(editions: dict[int, DataFrame], aliases=COLUMN_ALIASES) -> DataFrame:
    """All editions by canonical name, over the columns every one has.

    Only headers are compared here; the union itself is a narrow plan.
    """
    if len(editions) < 2:
        raise ValueError("a series needs at least two editions")
    renamed = {year: one_edition(table, aliases) for year, table in editions.items()}
    shared = set.intersection(*[set(table.columns) for table in renamed.values()])
    order = [c for c in renamed[max(renamed)].columns if c in shared]
    return reduce(DataFrame.unionByName, [renamed[y].select(*order) for y in sorted(renamed)])
