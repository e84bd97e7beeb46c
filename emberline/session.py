"""Session settings the jobs are written for."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # call-site capture costs several driver round trips per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
# Long row-wise derivations compile to methods above the 8000-bytecode limit
# under which HotSpot refuses to compile; pass this to drivers and executors.
JAVA_OPTIONS = "-XX:-DontCompileHugeMethods"
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def build_session(
    app_name: str = "emberline",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with AQE on and UTC time.

    ``shuffle_partitions`` stays at the cluster's setting unless given: AQE
    merges small partitions, so a high number is the safe side for large runs.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def keep_methods_small(spark: SparkSession) -> None:
    """Plans whose one method HotSpot would refuse to compile run as several, in sessions without JAVA_OPTIONS too.

    A limit that the session's owner has chosen stays.
    """
    if spark.conf.get(METHOD_LIMIT) == "65535":
        spark.conf.set(METHOD_LIMIT, "8000")


_shipped: set[str] = set()
_shipping = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers the package as a zip file, once per application, as --py-files does."""
    with _shipping:  # fits that run side by side ship once
        if spark.sparkContext.applicationId not in _shipped:
            _ship(spark)
            _shipped.add(spark.sparkContext.applicationId)


def _ship(spark: SparkSession) -> None:
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="emberline-")  # of the driver, which serves the file to the executors
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, f"{package.name}_core.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
