"""Sources and sinks: delimited tables, lenient dates, stages, metadata, requests."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline import fixed_values as fv
from emberline.functions.expr import as_col


def _schema(headers: Mapping[str, str], types: Mapping[str, T.DataType]) -> T.StructType:
    return T.StructType(
        [T.StructField(h, types.get(n, T.StringType())) for h, n in headers.items()]
    )


PRICE_SCHEMA = _schema(
    fv.PRICE_SOURCE_HEADERS,
    {"domestic_price_inr": T.DoubleType(), "commercial_price_inr": T.DoubleType()},
)
WASTAGE_SCHEMA = _schema(
    fv.WASTAGE_SOURCE_HEADERS,
    {
        "guests": T.IntegerType(),
        "quantity_of_food": T.DoubleType(),
        "wastage_amount": T.DoubleType(),
    },
)
RECIPE_SCHEMA = _schema(
    fv.RECIPE_SOURCE_HEADERS,
    {"cook_time_mins": T.IntegerType(), "servings": T.IntegerType()},
)


def read_table_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    rename: Mapping[str, str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Delimited table with a header, its columns taken by trimmed name, then renamed.

    All columns are read as text, so there is no inference pass over the files;
    those of ``schema`` are cast, and a value of another type is null.  Columns
    may stand in any order among others; a missing one is an error.
    ``multi_line`` allows line breaks in quotes, at the price of unsplit files.
    """
    df = (
        spark.read.option("header", True).option("inferSchema", False)
        .option("multiLine", multi_line).option("escape", '"').csv(path)
    )
    found = {c.strip(): c for c in reversed(df.columns)}
    missing = [f.name for f in schema if f.name.strip() not in found]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    rename = rename or {}
    return df.select(
        *[
            F.col(f"`{found[f.name.strip()]}`").try_cast(f.dataType).alias(rename.get(f.name, f.name.strip()))
            for f in schema
        ]
    )


def parse_day(c: Column | str, fmt: str = "dd-MMM-yy") -> Column:
    """Text to date, null when malformed.

    Two-digit years 69-99 belong to the 1900s and 00-68 to the 2000s.
    """
    d = F.try_to_timestamp(as_col(c), F.lit(fmt)).cast("date")
    if "yyyy" in fmt:
        return d
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def parse_date_lenient(
    df: DataFrame, source: str, target: str = "date", fmt: str = "dd-MMM-yy"
) -> DataFrame:
    """Adds ``target`` and drops rows whose text is no date."""
    return df.withColumn(target, parse_day(source, fmt)).filter(F.col(target).isNotNull())


def write_stage(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> str:
    """Persist a processed or final table; returns the path.

    Rows are rebalanced by partition value first: small pieces are merged, and
    a heavy value is split over several writers, so it never funnels through one.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def column_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: non-null count, min, max.  One aggregate pass."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(v).alias("n_values"),
                F.min(v).alias("min_value"),
                F.max(v).alias("max_value"),
            ).alias(c)
        )
    wide = df.agg(F.array(*aggs).alias("stats"))
    return wide.select(F.explode("stats").alias("s")).select("s.*")


def dataset_metadata(
    df: DataFrame,
    scaled: Sequence[str],
    targets: Sequence[str],
    label_maps: Mapping[str, Mapping[str, int]] | None = None,
    rates: Mapping[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """One-row table with a JSON document that describes the data set."""

    def ranges(cols):
        return F.struct(
            F.array(*[F.lit(c) for c in cols]).alias("columns"),
            F.array(*[F.min(F.col(c).cast("double")) for c in cols]).alias("min"),
            F.array(*[F.max(F.col(c).cast("double")) for c in cols]).alias("max"),
        )

    stats = df.agg(
        F.count("*").alias("total_rows"),
        ranges(scaled).alias("features"),
        ranges(targets).alias("targets"),
    ).withColumn("total_columns", F.lit(len(df.columns)))
    return stats.select(
        "total_rows",
        "total_columns",
        F.to_json(
            F.struct(
                "total_rows",
                "total_columns",
                "features",
                "targets",
                F.lit(json.dumps(label_maps or {}, sort_keys=True)).alias("label_maps"),
                F.lit(json.dumps(rates or {}, sort_keys=True)).alias("rates"),
            )
        ).alias("metadata_json"),
    )


METADATA_SCHEMA = (
    "total_rows long, total_columns int, "
    "features struct<columns: array<string>, min: array<double>, max: array<double>>, "
    "targets struct<columns: array<string>, min: array<double>, max: array<double>>, "
    "label_maps string, rates string"
)


def write_metadata(metadata: DataFrame, path: str) -> str:
    """The one-row metadata table as a JSON text file."""
    metadata.select(F.col("metadata_json").alias("value")).write.mode("overwrite").text(path)
    return path


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata document back as columns."""
    return spark.read.text(path).select(F.from_json("value", METADATA_SCHEMA).alias("m")).select("m.*")


def metadata_ranges(metadata: DataFrame) -> DataFrame:
    """(part, column_name, min_value, max_value) rows of a metadata document."""
    parts = [
        metadata.select(
            F.lit(part).alias("part"),
            F.explode(
                F.arrays_zip(
                    F.col(f"{part}.columns").alias("column_name"),
                    F.col(f"{part}.min").alias("min_value"),
                    F.col(f"{part}.max").alias("max_value"),
                )
            ).alias("z"),
        ).select("part", "z.*")
        for part in ("features", "targets")
    ]
    return parts[0].unionByName(parts[1])


REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("caterer_id", T.StringType()),
        T.StructField("caterer_name", T.StringType()),
        T.StructField("experience_yrs", T.IntegerType()),
        T.StructField("num_burners", T.IntegerType()),
        T.StructField("business_size", T.StringType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("headcount", T.IntegerType()),
        T.StructField("num_dishes", T.IntegerType()),
        T.StructField("duration_hrs", T.DoubleType()),
        T.StructField("menu_profile", T.StringType()),
        T.StructField("is_festival_season", T.BooleanType()),
    ]
)
BATCH_SCHEMA = T.StructType(
    [
        T.StructField("events", T.ArrayType(REQUEST_SCHEMA)),
        T.StructField("budget_inr", T.DoubleType()),
        T.StructField("use_lp", T.BooleanType()),
    ]
)


def fill_request_defaults(df: DataFrame) -> DataFrame:
    """Missing request fields take their default; the event date has none."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in fv.REQUEST_DEFAULTS.items()}
    )


CORRUPT = "_corrupt_record"
#: With the text of a document that does not parse or holds a field of another type.
CHECKED_SCHEMA = T.StructType([*BATCH_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])


def parse_batches(df: DataFrame, json_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, ``events``, ``budget_inr`` and the corrupt text of each document."""
    options = {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}
    parsed = df.select(*keep, F.from_json(json_col, CHECKED_SCHEMA, options).alias("b"))
    return parsed.select(*keep, "b.*")


def document_reason() -> Column:
    """Why a parsed document gives no request; null if it does."""
    return F.when(F.col(CORRUPT).isNotNull(), "malformed document").when(
        F.coalesce(F.size("events"), F.lit(-1)) <= 0, "no events"
    )


def ingest_requests(df: DataFrame, json_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Batch documents (one JSON text per row) to one row per event request.

    A document that does not parse or holds a field of another type gives
    none: no value is invented for it.  See :func:`rejected_documents`.
    """
    parsed = parse_batches(df, json_col, keep).filter(F.col(CORRUPT).isNull())
    return explode_requests(parsed, keep)


def rejected_documents(df: DataFrame, json_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and ``reason`` of the documents that give no request."""
    parsed = parse_batches(df, json_col, keep).withColumn("reason", document_reason())
    return parsed.filter(F.col("reason").isNotNull()).select(*keep, "reason")


def explode_requests(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Parsed batch documents (``events``, ``budget_inr``) to one row per request.

    The outer form keeps the optimizer from adding size and null tests on the
    array, each of which would parse the document once more.
    """
    rows = df.select(
        *keep, "budget_inr", F.posexplode_outer("events").alias("position", "r")
    ).filter(F.col("position").isNotNull())
    return fill_request_defaults(rows.select(*keep, "budget_inr", "position", "r.*"))
