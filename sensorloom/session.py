"""Session set-up and the few decisions that depend on it."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()
_kept: list[str] = []


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the package relies on; sizes stay the cluster's own."""
    builder = (
        SparkSession.builder.appName("sensorloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call sites of column expressions cost half the time it takes to build a wide plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in the Python workers of an application, wherever they start."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sensorloom-package-")
    archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's, or one in the session's warehouse if none is named."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is not None:
            return current
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what keep() stores inside at the end. Results that are still needed then must be written inside by other means."""
    first = len(_kept)
    try:
        yield
    finally:
        made = _kept[first:]
        del _kept[first:]
        for path in made:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def keep(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder and go on from the stored table; the exchanges that led to it are dropped at once.

    partition_by names integer columns that become folders, so that a filter on them reads those only.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _kept.append(path)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
