"""Yearly edition files: semicolon text, Latin-1, every column a string."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How the published files are written.
SEPARATOR = ";"
ENCODING = "ISO-8859-1"
COURSES = "cursos"
INSTITUTIONS = "ies"


def _reader(spark: SparkSession):
    return (
        spark.read.option("sep", SEPARATOR)
        .option("header", True)
        .option("encoding", ENCODING)
        .option("quote", '"')
        .option("escape", '"')
        .option("pathGlobFilter", "[!~]*.[cC][sS][vV]")
    )


def read_edition(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """One edition table, all text; only the asked columns are parsed."""
    table = _reader(spark).csv(path)
    return table.select(*columns) if columns else table


def write_edition(df: DataFrame, path: str) -> None:
    """Writes a table in the form ``read_edition`` reads."""
    (
        df.write.mode("overwrite")
        .option("sep", SEPARATOR)
        .option("header", True)
        .option("encoding", ENCODING)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def edition_kind(file_name: Column) -> Column:
    """Courses or institutions, from the file name; null if neither."""
    upper = F.upper(file_name)
    return F.when(upper.contains("CURSOS"), COURSES).when(upper.contains("IES"), INSTITUTIONS)


def edition_year(file_name: Column) -> Column:
    """The one four-digit year in a file name; null if none or several."""
    years = F.array_distinct(F.regexp_extract_all(file_name, F.lit(r"((?:19|20)\d{2})"), F.lit(1)))
    return F.when(F.size(years) == 1, years[0].cast("int"))


def edition_of(file_name: str) -> tuple[int, str]:
    """Year and kind of one file name, or an error that says what is wrong."""
    years = set(re.findall(r"(?:19|20)\d{2}", file_name))
    if len(years) != 1:
        raise ValueError(f"{'no' if not years else 'ambiguous'} year in file name: {file_name}")
    upper = file_name.upper()
    kinds = [kind for kind in (COURSES, INSTITUTIONS) if kind.upper() in upper]
    if not kinds:
        raise ValueError(f"neither a courses nor an institutions file: {file_name}")
    return int(years.pop()), kinds[0]


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def edition_files(spark: SparkSession, path: str) -> DataFrame:
    """The CSV files of a folder with year, kind and size; lock files left out."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(_file_name(F.col("path")).alias("file_name"), "path", F.col("length").alias("bytes"))
    )
    name = F.col("file_name")
    return files.where(~name.startswith("~$") & F.lower(name).endswith(".csv")).select(
        "path", "file_name", edition_kind(name).alias("kind"), edition_year(name).alias("year"), "bytes"
    )


def select_edition_files(spark: SparkSession, path: str) -> dict[str, str]:
    """Path of the one file of each kind; courses must be there exactly once.

    All files of a package must name the same year.
    """
    found: dict[str, list[str]] = {COURSES: [], INSTITUTIONS: []}
    years = set()
    # The candidates of one package; lock files, other files and CSVs of no kind are passed over.
    for row in edition_choices(spark, path).where("kind is not null").toLocalIterator():
        year, kind = edition_of(row.file_name)
        years.add(year)
        found[kind].append(row.path)
    if len(years) > 1:
        raise ValueError(f"files of different years in one package: {sorted(years)}")
    if len(found[COURSES]) != 1:
        raise ValueError(f"expected one courses CSV, found {len(found[COURSES])}")
    if len(found[INSTITUTIONS]) > 1:
        raise ValueError(f"expected at most one institutions CSV, found {len(found[INSTITUTIONS])}")
    return {kind: paths[0] for kind, paths in found.items() if paths}


def edition_choices(spark: SparkSession, path: str) -> DataFrame:
    """Every file of a folder: path, file_name, kind, year, outcome.

    A table that Spark wrote as a folder of parts counts as one file of that
    folder's name. ``outcome`` is ``chosen`` for the one file of its kind, ``second candidate``
    for each where a kind has several, ``no kind`` for other CSV files,
    ``lock file`` and ``not a CSV`` for what is passed over.
    """
    root = path.rstrip("/")
    scheme = "^[a-z0-9]+:/+"
    below = F.substr(F.regexp_replace(F.col("path"), scheme, "/"), F.lit(len(re.sub(scheme, "/", root)) + 2))
    name = F.split(below, "/")[0]
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select(name.alias("file_name")).distinct().withColumn("path", F.concat(F.lit(root + "/"), "file_name"))
    )
    name = F.col("file_name")
    kind = edition_kind(name)
    looked_at = F.when(name.startswith("~$"), "lock file").when(~F.lower(name).endswith(".csv"), "not a CSV").when(
        kind.isNull(), "no kind")
    listed = files.select("path", "file_name", kind.alias("kind"), edition_year(name).alias("year"), looked_at.alias("outcome"))
    candidates = listed.where("outcome is null").groupBy("kind").agg(F.count(F.lit(1)).alias("_candidates"))
    choice = F.when(F.col("outcome").isNotNull(), F.col("outcome")).when(F.col("_candidates") == 1, "chosen").otherwise(
        "second candidate")
    return listed.join(F.broadcast(candidates), "kind", "left").select(  # two kinds at most
        "path", "file_name", F.when(choice.isin("chosen", "second candidate"), F.col("kind")).alias("kind"), "year",
        choice.alias("outcome"))


def _record_counter():
    """What tasks run over (file, block start, line), as a closure, so that workers need no copy of this package."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def counted(batches):
        """For each (file, block): its first line, its record ends if it began outside and inside quotes, and its parity.

        Lines come in order inside a block. A quoted field may hold line breaks, so a
        line ends a record where the quotes so far are even in number; how many came
        before the block is known only later.
        """
        state: dict[tuple, list] = {}
        for batch in batches:
            lines = batch.column(2)
            odd = pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False).astype(np.int64) & 1
            filled = pc.binary_length(lines).to_numpy(zero_copy_only=False) > 0  # an empty line is no record
            block = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            begins = [0, *[i for i in range(1, len(block)) if block[i] != block[i - 1]], len(block)]
            for low, high in zip(begins, begins[1:]):
                if low < high:
                    held = state.setdefault(block[low], [lines[low].as_py(), 0, 0, 0])
                    parity = (np.cumsum(odd[low:high]) + held[3]) & 1
                    held[1] += int(((parity == 0) & filled[low:high]).sum())
                    held[2] += int(((parity == 1) & filled[low:high]).sum())
                    held[3] = int(parity[-1])
        rows = [(*at, *values) for at, values in state.items()]
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
            names=["file", "begin", "first", "ends_even", "ends_odd", "parity"])

    return counted


def profile_files(spark: SparkSession, paths) -> DataFrame:
    """Rows, column count and header of every path (a file, or a folder of parts), in one job over all of them.

    The header is the line at a file's start. Records are counted by the parity of
    quotes, block by block; the blocks of a file, few as they are, then tell
    which of a block's two counts holds. Line breaks inside quotes are no records,
    empty lines neither.
    """
    paths = list(paths)
    files = spark.read.option("pathGlobFilter", "[!~]*.[cC][sS][vV]").text(paths)
    lines = files.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"),
        F.col("value").cast("binary").alias("line"))
    blocks = lines.mapInArrow(
        _record_counter(), "file string, begin long, first binary, ends_even long, ends_odd long, parity long")
    of_file = Window.partitionBy("file").orderBy("begin")
    before = F.coalesce(F.sum("parity").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    counted = blocks.withColumn("_ends", F.when(before == 0, F.col("ends_even")).otherwise(F.col("ends_odd")))
    per_file = counted.groupBy("file").agg(
        F.sum("_ends").alias("records"), F.min_by("first", "begin").alias("header"))
    # The asked path of a file: the path itself or the folder above it.
    plain = F.regexp_replace(F.url_decode(F.col("file")), "^[a-z0-9]+:/+", "/")
    asked = F.coalesce(*[
        F.when((plain == local) | plain.startswith(local + "/"), F.lit(p))
        for p, local in ((p, re.sub("^[a-z0-9]+:/+", "/", p).rstrip("/")) for p in sorted(paths, key=len, reverse=True))
    ])
    header = F.split(F.regexp_replace(F.decode("header", ENCODING), r'[\r"]', ""), SEPARATOR)
    return per_file.select(asked.alias("path"), (F.col("records") - 1).alias("_rows"), header.alias("columns")).groupBy("path").agg(
        F.sum("_rows").alias("data_row_count"), F.min("columns").alias("columns"),
    ).select("path", "data_row_count", F.size("columns").alias("column_count"), "columns")
