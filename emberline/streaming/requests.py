"""Plan requests as they arrive.

The request operators are stateless, so a stream runs the same functions as a
table: no state store, no watermark, and each request is planned in the
micro-batch that reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from emberline.operators import modelling, planning, quality, serving
from emberline.sources import tables
from emberline.sources.staging import stage

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        *tables.BATCH_SCHEMA.fields,
        T.StructField("place", T.StringType()),
        T.StructField(tables.CORRUPT, T.StringType()),
    ]
)


def read_request_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Stream of batch documents, one JSON object per line."""
    return (
        spark.readStream.schema(DOCUMENT_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .option("columnNameOfCorruptRecord", tables.CORRUPT)
        .json(path)
    )


def split_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted requests, rejected) of batch documents; works on tables and streams.

    Rejected are requests out of range, with their position, and documents
    that are malformed or hold no event, without one.
    """
    keep = ["request_id", "place"]
    if tables.CORRUPT not in documents.columns:
        documents = documents.withColumn(tables.CORRUPT, F.lit(None).cast("string"))
    bad = documents.withColumn("reason", tables.document_reason()).filter("reason is not null").select(
        "request_id", F.lit(None).cast("int").alias("position"), F.array("reason").alias("reasons")
    )
    rows = tables.explode_requests(documents.filter(F.col(tables.CORRUPT).isNull()), keep)
    accepted, rejected = quality.split_requests(rows)
    return accepted, rejected.select("request_id", "position", "reasons").unionByName(bad)


def plan_requests(
    documents: DataFrame, models: modelling.Models | None = None
) -> tuple[DataFrame, DataFrame]:
    """(plans, rejected) of batch documents; works on tables and streams.

    With ``models`` the plans blend their prediction in and carry it; without,
    the rule alone decides.
    """
    accepted, rejected = split_documents(documents)
    if models is None:
        events = accepted.withColumn("lead_days", planning.lead_days("place"))
        return planning.plan_events(events, keep=("request_id", "position")), rejected
    return serving.plan_requests(accepted, models, ("request_id", "position"), F.col("place")), rejected


def _pinned(spark: SparkSession, folder: str, batch_id: int, root: str) -> str:
    """The models' version a micro-batch is planned with: noted before it is first tried, kept when it is tried again."""
    fs, notes = modelling.storage(spark, folder)
    if fs.exists(notes):
        for s in fs.listStatus(notes):
            number, version = s.getPath().getName().split("=", 1)
            if int(number) == batch_id:
                return version
    version = modelling.current_version(spark, root)
    fs, note = modelling.storage(spark, f"{folder}/{batch_id}={version}")
    fs.create(note, False).close()
    return version


def serve_requests(
    documents: DataFrame, root: str, plans: str, batches: str, dead_letters: str, checkpoint: str
) -> StreamingQuery:
    """Plan a stream of batch documents with the published models; ends when all that is there is done.

    Every micro-batch reads the current version anew and is planned with that
    one alone, so models can be published while the stream runs.  Plans, one
    row a batch with its procurement, and rejected requests and documents go to
    three parquet folders, in a part named by the micro-batch that a repeated
    try overwrites.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = _pinned(spark, f"{checkpoint}/versions", batch_id, root)
        models = modelling.load_version(spark, root, version)
        documents = stage(batch, "micro-batch")
        planned, rejected = plan_requests(documents, models)
        planned = stage(planned.withColumn("model_version", F.lit(version)), "planned")
        good = documents.filter(F.col(tables.CORRUPT).isNull()) if tables.CORRUPT in documents.columns else documents
        for rows, path in (
            (planned, plans), (serving.optimise_batches(planned, good.filter("size(events) > 0")), batches), (rejected, dead_letters),
        ):
            rows.write.mode("overwrite").parquet(f"{path}/micro_batch={batch_id}")

    return (
        documents.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a parquet folder; processes what is there, then stops.

    The checkpoint folder makes the sink exactly-once across restarts.
    """
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
