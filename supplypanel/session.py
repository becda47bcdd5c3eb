"""The Spark session the library is meant to run in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "supplypanel", master: str | None = None, **settings) -> SparkSession:
    """A session with ANSI arithmetic, UTC time and adaptive execution.

    Only behaviour is set here. Memory, executors and the shared folder
    (``spark.checkpoint.dir``) belong to the cluster's own configuration.
    Extra settings are given with ``__`` for the dots, as in
    ``spark__sql__shuffle__partitions=8``.
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()
