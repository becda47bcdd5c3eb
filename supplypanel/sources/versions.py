"""Tables of which only changed partitions are written, and that change as a whole.

A public name is a view over a version. A version is a catalog table whose
partitions lie where the load that wrote them put them; a load is a table of
its own with the partitions that differ. A reload

1. fingerprints the new rows by partition and compares with the version's manifest,
2. writes the partitions that differ aside, as a load,
3. describes the new version: old places for what is unchanged, new ones for the rest,
4. swaps the view, which is one step in the catalog.

Up to the last step readers see the old rows; a reload that fails before leaves
them, and may simply be run again. Loads that neither of the two newest
versions reads are dropped.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Property of a version in which its manifest is named.
MANIFEST = "supplypanel.manifest"


def partition_fingerprints(df: DataFrame, partition: str) -> DataFrame:
    """Rows and two lanes of content hash for each value of ``partition``, whatever the order of rows and columns."""
    columns = [F.col(c) for c in sorted(df.columns)]
    lane = lambda *seed: F.sum(F.xxhash64(*seed, *columns).cast("decimal(38,0)"))
    return df.groupBy(partition).agg(
        F.count(F.lit(1)).alias("row_count"), lane().alias("lane_a"), lane(F.lit("second lane")).alias("lane_b"))


def _prints(df: DataFrame, partition: str) -> dict[str, tuple]:
    """``partition_fingerprints`` on the driver: a row for each partition, so as many as there are editions."""
    found = {}
    for r in partition_fingerprints(df, partition).toLocalIterator():
        if r[partition] is None:
            raise ValueError(f"rows without {partition} have no partition")
        found[str(r[partition])] = (int(r.row_count), str(r.lane_a), str(r.lane_b))
    return found


def _exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def _current(spark: SparkSession, table: str) -> str | None:
    """The version that the public name shows."""
    if not _exists(spark, table):
        return None
    text = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'View Text'").first()
    if text is None:
        raise ValueError(f"{table} is a plain table and not a view over versions")
    return text.data_type.rsplit(" ", 1)[-1]


def manifest(spark: SparkSession, table: str) -> dict[str, tuple]:
    """For each partition of a version or a public name: rows, both lanes, load."""
    version = table if "__v_" in table else _current(spark, table)
    name = spark.sql(f"SHOW TBLPROPERTIES {version}").where(F.col("key") == MANIFEST).first().value
    rows = spark.table(name).collect()  # a row for each partition
    return {r.partition: (r.row_count, r.lane_a, r.lane_b, r.load) for r in rows}


def _location(spark: SparkSession, table: str) -> str:
    return spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first().data_type


def _layout(writer, partition: str, cluster, buckets: int):
    writer = writer.partitionBy(partition).format("parquet")
    return writer.bucketBy(buckets, *cluster).sortBy(*cluster) if cluster else writer


def reload(
    df: DataFrame, table: str, *, partition: str, cluster=(), buckets: int | None = None
) -> DataFrame:
    """Brings ``table`` to the rows of ``df`` and returns it; writes nothing where nothing differs.

    ``partition`` prunes, ``cluster`` buckets a partition so that windows and
    joins by those keys read it without a shuffle. ``buckets`` is that of the
    version before, or else as many as the session shuffles into. ``df`` is read
    once for its fingerprints, and once more for its changed partitions, whose
    filter reaches the source if the partition is a grouping key.
    """
    spark = df.sparkSession
    before = _current(spark, table)
    known = manifest(spark, before) if before else {}
    if before and cluster and buckets is None:
        found = spark.sql(f"DESCRIBE TABLE EXTENDED {before}").where("col_name = 'Num Buckets'").first()
        buckets = int(found.data_type)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(*[c for c in df.columns if c != partition], partition)
    mark = uuid4().hex[:12]
    load, version = f"{table}__load_{mark}", f"{table}__v_{mark}"
    if before:
        wanted = _prints(df, partition)
        changed = [p for p, prints in wanted.items() if known.get(p, ())[:3] != prints]
        if not changed and wanted.keys() == known.keys():
            return spark.table(table)
        chosen = ordered.where(F.col(partition).cast("string").isin(*changed)) if changed else None
    else:
        wanted, changed, chosen = {}, [], ordered

    if chosen is not None:
        laid = chosen.repartition(buckets, *cluster) if cluster else chosen
        _layout(laid.write, partition, cluster, buckets).saveAsTable(load)
        written = _prints(spark.table(load).select(*df.columns), partition)
        if before and written != {p: wanted[p] for p in changed}:
            spark.sql(f"DROP TABLE {load}")
            raise RuntimeError(f"{table}: the rows changed between their fingerprints and their write")
        wanted, changed = {**wanted, **written}, list(written)
    entries = {p: (*prints, load if p in changed else known[p][3]) for p, prints in wanted.items()}
    _describe(spark, ordered, table, version, entries, partition, cluster, buckets)
    # The one step that readers notice.
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM {version}")
    _forget(spark, table, [v for v in (version, before) if v])
    return spark.table(table)


def _describe(spark, df, table, version, entries, partition, cluster, buckets) -> None:
    """The version: a table without files of its own, its partitions, their manifest and its size."""
    names = f"{version}_manifest"
    rows = [(p, *e) for p, e in entries.items()]
    spark.createDataFrame(
        rows, "partition string, row_count long, lane_a string, lane_b string, load string"
    ).coalesce(1).write.saveAsTable(names)
    base = spark.catalog.currentDatabase() if "." not in table else table.rsplit(".", 1)[0]
    root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{version.replace('.', '_')}_{base}"
    _layout(df.limit(0).write, partition, cluster, buckets).option("path", root).saveAsTable(version)
    kind = df.schema[partition].dataType.simpleString()
    for p, (*_, load) in entries.items():
        value = f"'{p}'" if kind == "string" else p
        spark.sql(f"ALTER TABLE {version} ADD PARTITION ({partition} = {value}) "
                  f"LOCATION '{_location(spark, load)}/{partition}={p}'")
    spark.sql(f"ALTER TABLE {version} SET TBLPROPERTIES ('{MANIFEST}' = '{names}')")
    spark.sql(f"ANALYZE TABLE {version} COMPUTE STATISTICS")


def _forget(spark: SparkSession, table: str, versions: list[str]) -> None:
    """Drops versions other than ``versions``, and loads that none of these reads."""
    used = {entry[3] for v in versions for entry in manifest(spark, v).values()}
    held = {*versions, *(f"{v}_manifest" for v in versions), *used}
    short = table.rsplit(".", 1)[-1]
    for name in [r.tableName for r in spark.sql(f"SHOW TABLES LIKE '{short}__*'").collect()]:
        if name.startswith((f"{short}__load_", f"{short}__v_")) and name not in {h.rsplit(".", 1)[-1] for h in held}:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
