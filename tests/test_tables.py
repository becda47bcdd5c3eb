"""Reloads of editions, manifests of key ranges, file profiles and guards inside jobs."""

from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from supplypanel.operators import ranges
from supplypanel.plans import mart
from supplypanel.sources import editions, tables, versions


def rows_of(spark, years=(2019, 2020, 2021), extra=0):
    made = [(y, k, k % 7, f"n{k}") for y in years for k in range(40 + extra)]
    return spark.createDataFrame(made, "year int, key long, value long, name string")


def held(spark, table):
    return sorted(tuple(r) for r in spark.table(table).select("year", "key", "value", "name").collect())


# --- Reloads --------------------------------------------------------------------------


def test_reload_writes_changed_editions_alone(spark):
    table, old = "reload_alone", rows_of(spark)
    versions.reload(old, table, partition="year", cluster=["key"], buckets=3)
    first = versions.manifest(spark, table)
    assert held(spark, table) == sorted(tuple(r) for r in old.collect())
    version = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'View Text'").first().data_type
    versions.reload(old.repartition(5), table, partition="year", cluster=["key"])  # nothing differs
    assert spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'View Text'").first().data_type == version
    new = old.withColumn("value", F.when((F.col("year") == 2020) & (F.col("key") == 3), 99).otherwise(F.col("value")))
    new = new.where("year > 2019").unionByName(rows_of(spark, [2022]))
    versions.reload(new, table, partition="year", cluster=["key"])
    second = versions.manifest(spark, table)
    assert set(second) == {"2020", "2021", "2022"}
    assert second["2021"] == first["2021"] and second["2020"][3] != first["2020"][3] == first["2021"][3]
    assert held(spark, table) == sorted(tuple(r) for r in new.select("year", "key", "value", "name").collect())


def test_a_failed_reload_leaves_the_old_rows(spark):
    table, old = "reload_failed", rows_of(spark)
    versions.reload(old, table, partition="year", cluster=["key"], buckets=2)
    before, manifest = held(spark, table), versions.manifest(spark, table)
    reader = spark.table(table)
    # The fingerprints succeed; the write of a later edition fails half-way.
    changed = old.withColumn("value", F.col("value") + 1)
    real = versions._describe

    def broken(*args):
        raise RuntimeError("lost in the middle")

    versions._describe = broken
    try:
        with pytest.raises(RuntimeError, match="in the middle"):
            versions.reload(changed, table, partition="year", cluster=["key"])
    finally:
        versions._describe = real
    assert held(spark, table) == before and versions.manifest(spark, table) == manifest
    failing = old.withColumn("value", F.when(F.col("year") == 2021, F.raise_error(F.lit("bad edition")).cast("long")).otherwise(0))
    with pytest.raises(PySparkException, match="bad edition"):
        versions.reload(failing, table, partition="year", cluster=["key"])
    assert held(spark, table) == before
    versions.reload(changed, table, partition="year", cluster=["key"])
    assert held(spark, table) == sorted((y, k, v + 1, n) for y, k, v, n in before)
    assert sorted(tuple(r) for r in reader.select("year", "key", "value", "name").collect()) == before  # a reader of the old version


def test_loads_that_nothing_reads_are_dropped(spark):
    table = "reload_drop"
    for extra in range(4):
        versions.reload(rows_of(spark, extra=extra), table, partition="year")
    names = [r.tableName for r in spark.sql(f"SHOW TABLES LIKE '{table}__*'").collect()]
    assert len([n for n in names if "__load_" in n]) == 2 and len([n for n in names if "__v_" in n]) == 4  # with manifests
    assert spark.table(table).count() == 3 * 43


def test_a_reloaded_table_is_pruned_and_read_without_a_shuffle(spark):
    table = "reload_plan"
    versions.reload(rows_of(spark), table, partition="year", cluster=["key"], buckets=4)
    plan = spark.table(table).groupBy("key").agg(F.sum("value"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    pruned = spark.table(table).where("year = 2020")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in pruned
    with pytest.raises(ValueError, match="plain table"):
        spark.range(3).write.saveAsTable("reload_plain")
        versions.reload(rows_of(spark), "reload_plain", partition="year")
    with pytest.raises(ValueError, match="no partition"):
        versions.reload(rows_of(spark).withColumn("year", F.lit(None).cast("int")), "reload_nulls", partition="year")


# --- Manifests of key ranges -------------------------------------------------------------


def test_one_changed_cell_is_found_in_its_range_alone(spark, tmp_path):
    old = spark.range(3000).selectExpr("id as key", "id % 9 as a", "cast(null as string) as b")
    new = old.withColumn("b", F.when(F.col("key") == 1234, "x"))
    for name, rows in (("old", old), ("new", new)):
        ranges.write_by_range(rows, str(tmp_path / name), ["key"])
    manifests = [ranges.tree_manifest(spark.read.parquet(str(tmp_path / n)).drop(ranges.RANGE), ["key"]) for n in ("old", "new")]
    leaves = ranges.differing_leaves(*manifests)
    assert leaves.count() == 1
    found = ranges.changed_rows(spark, str(tmp_path / "old"), str(tmp_path / "new"), ["key"], leaves)
    assert [(r.key, r.change, r.columns) for r in found.collect()] == [(1234, "changed", ["b"])]
    files = {f.rsplit(ranges.RANGE, 1)[1].split("/")[0] for f in found.inputFiles()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({ranges.RANGE}" in plan or f"{ranges.RANGE}#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(files) <= 1 << ranges.FILE_BITS


def test_ranges_name_added_removed_and_repeated_rows(spark, tmp_path):
    old = [(1, 1, "a"), (2, 1, "b"), (None, 1, "c"), (4, 1, "d"), (4, 1, "d"), (5, 5, None)]
    new = [(1, 1, "a"), (2, 2, "B"), (None, 1, "c"), (4, 1, "d"), (6, 1, None), (5, None, None)]
    for name, rows in (("old", old), ("new", new)):
        ranges.write_by_range(spark.createDataFrame(rows, "key long, v long, t string"), str(tmp_path / name), ["key"])
    manifests = [ranges.tree_manifest(spark.read.parquet(str(tmp_path / n)).drop(ranges.RANGE), ["key"]) for n in ("old", "new")]
    found = ranges.changed_rows(spark, str(tmp_path / "old"), str(tmp_path / "new"), ["key"], ranges.differing_leaves(*manifests))
    assert sorted((r.key, r.change, tuple(r.columns)) for r in found.collect()) == [
        (2, "changed", ("v", "t")), (4, "removed", ()), (5, "changed", ("v",)), (6, "added", ())]
    same = ranges.differing_leaves(manifests[0], manifests[0])
    assert same.isEmpty()
    nothing = ranges.changed_rows(spark, str(tmp_path / "old"), str(tmp_path / "old"), ["key"], same)
    assert nothing.isEmpty()


# --- File profiles -----------------------------------------------------------------------


def test_profiles_count_records_and_not_lines(spark, tmp_path):
    quoted = tmp_path / "CURSOS_2020.CSV"
    quoted.write_bytes('A;"B ç";C\n1;"two\nlines; ""quoted""\n\nand four";3\n\n2;x;y\n'.encode("latin-1") * 1)
    plain = tmp_path / "CURSOS_2021.csv"
    plain.write_text("A;B\r\n1;2\r\n3;4")
    empty = tmp_path / "CURSOS_2022.csv"
    empty.write_text("A;B;C;D\n")
    paths = [str(p) for p in (quoted, plain, empty)]
    found = {r.path: (r.data_row_count, r.column_count, r.columns) for r in editions.profile_files(spark, paths).collect()}
    assert found == {
        paths[0]: (2, 3, ["A", "B ç", "C"]), paths[1]: (2, 2, ["A", "B"]), paths[2]: (0, 4, ["A", "B", "C", "D"])}


def test_profiles_of_many_files_and_of_cut_files_are_one_job(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"CURSOS_{1960 + i}.csv").write_text("A;B\n" + "".join(f'{k};"x\ny{k}"\n' for k in range(i)))
    big = tmp_path / "folder" / "CURSOS_2023"
    big.mkdir(parents=True)
    for part in range(2):
        (big / f"part-{part}.csv").write_text("A;B\n" + "".join(f'{k};"line\n\n""{k}"""\n' for k in range(2000)))
    paths = [*[str(p) for p in tmp_path.glob("*.csv")], str(big)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")  # files are cut inside quotes
    try:
        found = editions.profile_files(spark, paths)
        assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
        counts = {r.path: r.data_row_count for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert counts == {**{str(tmp_path / f"CURSOS_{1960 + i}.csv"): i for i in range(60)}, str(big): 4000}


def test_choices_tell_why_a_file_is_passed_over(spark, tmp_path):
    for name in ("CURSOS_2020.CSV", "~$CURSOS_2020.CSV", "leiame.csv", "IES_2020.CSV", "IES_COPIA_2020.CSV", "CURSOS_2020.TXT"):
        (tmp_path / name).write_text("A\n1\n")
    found = {r.file_name: (r.kind, r.outcome) for r in editions.edition_choices(spark, str(tmp_path)).collect()}
    assert found == {
        "CURSOS_2020.CSV": ("cursos", "chosen"), "~$CURSOS_2020.CSV": (None, "lock file"), "leiame.csv": (None, "no kind"),
        "IES_2020.CSV": ("ies", "second candidate"), "IES_COPIA_2020.CSV": ("ies", "second candidate"),
        "CURSOS_2020.TXT": (None, "not a CSV")}
    with pytest.raises(ValueError, match="institutions CSV, found 2"):
        editions.select_edition_files(spark, str(tmp_path))


# --- Guards ------------------------------------------------------------------------------


def courses(spark, dimensions):
    columns = ("census_year int, institution_id int, course_id long, teaching_modality int, dimension_type int, academic_level int, "
               "course_name string, cine_label_code string, cine_label_name string, education_network int, "
               "administrative_category int, course_count long, offered_seats long, applications long, entrants long, "
               "enrollments long, graduates long")
    made = [(2020, 7, 77, None if d is None else 2, d or 1, 1, "n", "c", "l", 1, 1, 1, 10, 10, 5, 20, 2) for d in dimensions]
    return spark.createDataFrame(made, columns)


def test_a_spoilt_mart_fails_with_its_key(spark):
    good = mart.course_supply(courses(spark, [3, 2, 2])).collect()
    assert len(good) == 1 and good[0].enrollments == 40
    for buckets in (None, 3):
        with pytest.raises(PySparkException, match="course_supply: key .* is not unique: 2020, 7, 77, 2"):
            mart.course_supply(courses(spark, [1, 3, 2]), buckets).collect()
    assert mart.course_supply(courses(spark, [1, 3, 2]), unique=False).count() == 2
    assert mart.course_supply(courses(spark, [None, None])).count() == 1  # a null key is none that could repeat
    plan = mart.course_supply(courses(spark, [3, 2]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == mart.course_supply(
        courses(spark, [3, 2]), unique=False)._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_a_spoilt_raw_mart_fails_with_its_key(spark):
    text = courses(spark, [1, 3]).select(
        *[F.col(a).cast("string").alias(b) for a, b in zip(
            ("census_year", "institution_id", "course_id", "teaching_modality", "dimension_type", "academic_level", "course_name",
             "cine_label_code", "cine_label_name", "course_count", "offered_seats", "applications", "entrants", "enrollments", "graduates"),
            (*mart.RAW_KEYS, "tp_dimensao", "tp_nivel_academico", *mart.RAW_LABELS, *mart.RAW_CAPACITY, *mart.RAW_STUDENTS))])
    with pytest.raises(PySparkException, match="mvp_course_mart: key .* is not unique: 2020, 7, 77, 2"):
        mart.mvp_course_mart(text).collect()
    assert mart.mvp_course_mart(text, unique=False).count() == 2
    assert mart.mvp_course_mart(text.where("tp_dimensao = '3'")).count() == 1


@pytest.fixture
def order_lines(spark, tmp_path):
    """A folder with order lines of its own: 60 in each of two years."""
    rows = [(i, i, i % 5, 1, 10.0 + i % 7, 30000.0, 0.05, 0.01, "N", "F", datetime(1995 + i % 2, 3, 1)) for i in range(120)]
    spark.createDataFrame(
        rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_editions_come_from_the_source_without_a_sorted_copy(spark, order_lines):
    tables_before = {t.name for t in spark.catalog.listTables()}
    assert entry._years(spark, order_lines) == [1995, 1996]
    edition = entry._edition_source(spark, order_lines, 1996)
    plan = edition._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and all("lineitem.parquet" in f for f in edition.inputFiles())
    profile = entry.edition_file_profile(spark, order_lines).collect()
    assert sorted((r.year, r.data_row_count, r.column_count) for r in profile) == [(1995, 60, 22), (1996, 60, 23)]
    assert {t.name for t in spark.catalog.listTables()} == tables_before


def test_buckets_grow_with_the_source(spark, order_lines, monkeypatch):
    monkeypatch.setattr(tables, "BUCKET_ROWS", 5)
    state = entry._state(spark, order_lines)
    for table in (entry._name(spark, order_lines, "portfolio_snapshot"),
                  versions._current(spark, entry._name(spark, order_lines, "supply_snapshot"))):
        found = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
        assert int(found.data_type) == 120 // 5 > spark.sparkContext.defaultParallelism
    assert state.agg(F.sum("presencial_offers")).first()[0] == entry._snapshot(spark, order_lines).count() > 0


def test_a_reload_reads_one_computation_of_the_mart(spark, order_lines, monkeypatch):
    read, plain = [], mart.supply_snapshot

    def watched(supply, *more):
        read.extend(supply.inputFiles())
        return plain(supply, *more)

    monkeypatch.setattr(entry.mart, "supply_snapshot", watched)
    assert entry.snapshot_fingerprint(spark, order_lines).count() == 1
    assert read and not any("lineitem.parquet" in f for f in read)
