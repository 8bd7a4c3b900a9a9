"""Spark session and the shared folder jobs may write to."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str = "*", app: str = "pliego", **settings: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PLIEGO_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path below ``spark.checkpoint.dir``, or below the warehouse where that is unset: folders that every
    executor can reach. A cluster has to name one of the two, since the default warehouse is a folder of the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        named = spark.sparkContext.getConf().get("spark.sql.warehouse.dir")
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/pliego-work"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that end inside are deleted then, not when the driver's garbage is collected. For
    steps whose result is written: nothing reads their shuffles again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: later steps read it instead of computing them again, also after a lost executor. The
    shuffles that made them are deleted, so the scratch disk of a job is that of its largest step."""
    path = shared_folder(rows.sparkSession, name)
    with freeing_shuffles(rows.sparkSession):
        rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
