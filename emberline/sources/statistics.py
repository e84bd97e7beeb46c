"""Column statistics of a parquet table that grows by appended files.

Statistics are kept for each data file beside the table, in ``_statistics``,
which readers of the table pass over.  Only files that are new since the last
call are read; what is known of files that are gone is left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = "file string, column_name string, n_values long, min_value double, max_value double"


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Files of a table with their size and time: what a reader would list."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    found, left = [], [folder]
    while left:
        for s in fs.listStatus(left.pop()):
            name = s.getPath().getName()
            if name[0] in "_.":
                continue
            if s.isDirectory():
                left.append(s.getPath())
            else:
                found.append(f"{s.getPath().toString()}|{s.getLen()}|{s.getModificationTime()}")
    return sorted(found)


def _known(spark: SparkSession, path: str) -> DataFrame:
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_statistics")
    if not folder.getFileSystem(sc._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], KEPT)
    return spark.read.schema(KEPT).parquet(folder.toString())


def unseen_files(spark: SparkSession, path: str, columns: Sequence[str]) -> list[str]:
    """Data files whose statistics of ``columns`` are not kept yet."""
    listed = spark.createDataFrame([(f,) for f in data_files(spark, path)], "file string")
    done = (
        _known(spark, path).filter(F.col("column_name").isin(*columns)).groupBy("file")
        .agg(F.countDistinct("column_name").alias("n")).filter(F.col("n") == len(set(columns)))
    )
    return sorted(r["file"] for r in listed.join(done, "file", "left_anti").collect())  # as many as the reader lists


def column_statistics(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_values, min_value, max_value) of numeric columns of the table at ``path``.

    A file that was replaced has another size or time and is read again.  A
    column without values has n_values 0 and null ends, and so has every
    column of a table without files.
    """
    columns = list(dict.fromkeys(columns))
    new = unseen_files(spark, path, columns)
    if new:
        names = {f.rsplit("|", 2)[0]: f for f in new}
        rows = spark.read.option("basePath", path).parquet(*names)
        stats = F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"), F.count(v).alias("n_values"),
                    F.min(v).alias("min_value"), F.max(v).alias("max_value"),
                )
                for c in columns
                for v in [F.col(f"`{c}`").cast("double")]
            ]
        )
        # part of a name is enough to tell the files of one table apart
        short = spark.createDataFrame([(k.rsplit("/", 1)[-1], k, v) for k, v in names.items()], "short string, whole string, file string")
        each = rows.groupBy(F.col("_metadata.file_name").alias("short"), F.col("_metadata.file_path").alias("whole")).agg(
            F.count("*").alias("rows"), stats.alias("s")
        )
        found = each.join(short.select("short", "file", F.col("whole").alias("named")), "short").filter(
            F.regexp_replace("whole", "^file:/+", "file:/") == F.regexp_replace("named", "^file:/+", "file:/")
        )
        kept = found.select("file", F.explode("s").alias("s")).select("file", "s.*")
        # files without a row are known, too
        empty = short.select("file").join(found.select("file"), "file", "left_anti").select(
            "file", F.explode(F.array(*map(F.lit, columns))).alias("column_name"), F.lit(0).cast("long").alias("n_values"),
            F.lit(None).cast("double").alias("min_value"), F.lit(None).cast("double").alias("max_value"),
        )
        kept.unionByName(empty).write.mode("append").parquet(f"{path}/_statistics")
    listed = spark.createDataFrame([(f,) for f in data_files(spark, path)], "file string")
    asked = spark.createDataFrame([(c,) for c in columns], "column_name string")
    known = _known(spark, path).dropDuplicates(["file", "column_name"]).join(listed, "file", "left_semi")
    merged = known.groupBy("column_name").agg(
        F.sum("n_values").alias("n_values"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value")
    )
    return asked.join(merged, "column_name", "left").withColumn("n_values", F.coalesce("n_values", F.lit(0)))
