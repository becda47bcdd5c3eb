"""The raw course and institution tables, derived from order lines.

Stands in for the published editions: each order line becomes one course row
and each supplier one institution per year, as text, with integer arithmetic
only. Every dimension, both modalities, gaps, disappearances, unmeasurable
offers and the change from blank to zero occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1995, 2001
ZERO_CONVENTION_YEAR = 1998  # inapplicable measures are blank before, zero from here on
TRAIN_YEARS, TEST_YEARS = (1995, 1998), (1999, 1999)

# Published column names of the course file.
RAW_COURSE_COLUMNS = [
    "nu_ano_censo", "tp_dimensao", "co_regiao", "co_uf", "co_municipio", "co_ies", "co_curso",
    "no_curso", "co_cine_rotulo", "no_cine_rotulo", "tp_modalidade_ensino", "tp_nivel_academico",
    "tp_grau_academico", "tp_rede", "tp_categoria_administrativa", "tp_organizacao_academica",
    "qt_curso", "qt_vg_total", "qt_inscrito_total", "qt_ing", "qt_mat", "qt_conc",
]


def _numbers(lineitem: DataFrame) -> DataFrame:
    def hundredths(name):
        return F.round(F.col(name) * 100).cast("bigint")

    modality = F.when(F.col("l_linestatus") == "F", 1).otherwise(2)
    dimension = (
        F.when(F.col("l_linestatus") == "F", 1)
        .when(F.col("l_returnflag") == "A", 2)
        .when(F.col("l_returnflag") == "N", 3)
        .otherwise(4)
    )
    return lineitem.select(
        F.year("l_shipdate").cast("bigint").alias("year"),
        dimension.alias("dimension"),
        modality.alias("modality"),
        F.col("l_suppkey").alias("institution"),
        (F.col("l_partkey") % 30).alias("course"),
        (F.col("l_partkey") % 15).alias("field"),
        (F.col("l_orderkey") % 1000).alias("municipality"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.floor(F.col("l_extendedprice") / 1000).alias("enrolled"),
        hundredths("l_discount").alias("discount"),
        hundredths("l_tax").alias("tax"),
    )


def raw_courses(spark: SparkSession, folder: str) -> DataFrame:
    """All editions as one table of text, in one scan of the order lines."""
    rows = _numbers(spark.read.parquet(f"{folder}/lineitem.parquet"))
    c = F.col
    inapplicable = F.when(c("year") < ZERO_CONVENTION_YEAR, F.lit("")).otherwise(F.lit("0"))

    def measure(value: Column, dimensions) -> Column:
        return F.when(c("dimension").isin(*dimensions), value.cast("string")).otherwise(inapplicable)

    def located(value: Column) -> Column:
        return F.when(c("dimension") == 3, F.lit("")).otherwise(value.cast("string"))

    no_seats = (c("institution") + c("course") + c("year")) % 17 == 0
    text = {
        "nu_ano_censo": c("year"),
        "tp_dimensao": c("dimension"),
        "co_regiao": located(c("municipality") % 5 + 1),
        "co_uf": located(c("municipality") % 27 + 11),
        "co_municipio": located(c("municipality")),
        "co_ies": c("institution"),
        "co_curso": c("course"),
        "no_curso": F.concat(F.lit("Gestão "), c("course")),
        "co_cine_rotulo": F.concat(F.lit("F"), c("field")),
        "no_cine_rotulo": F.concat(F.lit("Área "), c("field")),
        "tp_modalidade_ensino": c("modality"),
        "tp_nivel_academico": F.when(c("tax") == 8, 2).otherwise(1),
        "tp_grau_academico": c("course") % 3 + 1,
        "tp_rede": c("institution") % 2 + 1,
        "tp_categoria_administrativa": c("institution") % 5 + 1,
        "tp_organizacao_academica": c("institution") % 4 + 1,
        "qt_curso": measure(F.lit(1), (1, 3)),
        "qt_vg_total": measure(F.when(no_seats, 0).otherwise(c("quantity")), (1, 3)),
        "qt_inscrito_total": measure(c("quantity") + 3 * c("line"), (1, 3)),
        "qt_ing": measure(F.expr("quantity * discount div 10"), (1, 2)),
        "qt_mat": measure(c("enrolled"), (1, 2)),
        "qt_conc": measure(F.expr("enrolled * tax div 10"), (1, 2)),
    }
    return rows.select(*[text[name].cast("string").alias(name) for name in RAW_COURSE_COLUMNS])


def raw_institutions(spark: SparkSession, folder: str) -> DataFrame:
    """One institution row per year and supplier."""
    supplier = spark.read.parquet(f"{folder}/supplier.parquet")
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    c = F.col
    years = F.sequence(F.lit(FIRST_YEAR), F.lit(LAST_YEAR))
    joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        "*", F.explode(years).alias("year")
    )
    text = {
        "nu_ano_censo": c("year"),
        "co_ies": c("s_suppkey"),
        "no_ies": c("s_name"),
        "sg_ies": F.concat(F.lit("S"), c("s_suppkey")),
        "tp_organizacao_academica": c("s_suppkey") % 4 + 1,
        "tp_rede": c("s_suppkey") % 2 + 1,
        "tp_categoria_administrativa": c("s_suppkey") % 5 + 1,
        "co_municipio_ies": c("s_suppkey") % 1000,
        "sg_uf_ies": c("n_name"),
    }
    return joined.select(*[value.cast("string").alias(name) for name, value in text.items()])


def as_edition(rows: DataFrame, year: int) -> DataFrame:
    """The rows of one year in that year's own layout.

    The field code is misspelt in one year, one column exists in a single
    year, and names are upper case as in the published headers.
    """
    rows = rows.select(*RAW_COURSE_COLUMNS)
    if year == ZERO_CONVENTION_YEAR:
        rows = rows.withColumnRenamed("co_cine_rotulo", "co_cine_rotulo2")
    if year == FIRST_YEAR + 1:
        rows = rows.withColumn("co_projeto", F.col("co_curso"))
    return rows.toDF(*[c.upper() for c in rows.columns])
