"""Stage tables: written once in the shared folder, read by several jobs.

Long derivation chains are cut by writing the table and reading it back.  A
written table survives the loss of executors, prunes columns on each read, and
its size is known to the optimizer, so joins against it broadcast only when it
fits under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``, else one in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    return (path or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages").rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The application's own folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/emberline/{spark.sparkContext.applicationId}"
    if path not in _made:
        if not _made:
            atexit.register(clean)
        _made[path] = spark
    return path


def clean() -> None:
    """Delete what the sessions of this driver have staged, as far as they still run."""
    for path, spark in list(_made.items()):
        sc = spark.sparkContext
        if sc._jsc is not None:
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
        del _made[path]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside delete their shuffle files when they end.

    For tables that are staged or collected once.  A DataFrame made inside and
    used after would make its shuffles again each time.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
