"""Written tables: the shared folder, snapshots and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Source rows behind one bucket of a table: what its tasks sort stays at some hundred megabytes.
BUCKET_ROWS = 1_000_000


def bucket_count(spark: SparkSession, source_rows: int) -> int:
    """Buckets of a table made from so many rows: the session's parallelism, or more where a bucket would grow with the data."""
    return max(spark.sparkContext.defaultParallelism, -(-source_rows // BUCKET_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return folder.rstrip("/") if folder else f"{warehouse}/shared"


def app_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application inside the shared one."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}"


def settled(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder: read again instead of computed again.

    Spark removes it with the DataFrame where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_folder(df.sparkSession)}/checkpoints")
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows once and reads them back: later plans start here."""
    spark = df.sparkSession
    folder = app_folder(spark, name)
    df.write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def materialize(
    df: DataFrame, table: str, *, partition: str, cluster=(), buckets: int | None = None
) -> DataFrame:
    """Reloads a snapshot table in place and returns it.

    The table is created empty when missing, then always overwritten as a
    whole, so views and plans built on it survive and a second run changes
    nothing. It is partitioned by ``partition`` for pruning and, with
    ``cluster``, bucketed so that windows and joins on those keys read it
    without a shuffle. Every bucket of a partition is one file.
    """
    spark = df.sparkSession
    ordered = df.select(*[c for c in df.columns if c != partition], partition)
    buckets = buckets or spark.sparkContext.defaultParallelism
    if not spark.catalog.tableExists(table):
        writer = ordered.limit(0).write.partitionBy(partition).format("parquet")
        if cluster:
            writer = writer.bucketBy(buckets, *cluster).sortBy(*cluster)
        writer.option("path", app_folder(spark, table)).saveAsTable(table)
    if cluster:
        ordered = ordered.repartition(buckets, *cluster)
    # The whole table, whatever the session's partition overwrite mode.
    ordered.write.option("partitionOverwriteMode", "static").insertInto(table, overwrite=True)
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
    return spark.table(table)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Writes one report section as a folder of files."""
    df.write.mode("overwrite").format(fmt).save(path)
