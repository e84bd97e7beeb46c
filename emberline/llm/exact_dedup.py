"""Exact dedup by skew-safe combining, in DataFrame operations only.

Rows are first combined inside each map task (the partial aggregate), then per
digest and salt, then over the salts.  Every step groups by the digest and the
whole text, so two texts that share a digest stay two groups.  A text held by a
third of all rows reaches the global step as one row per salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.sources.staging import stage

SALTS = 16
HOT_SHARE = 1000  # a group of more than 1/1000 of the rows is hot: fewer than 1000 groups


def _digest(df: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.withColumns({"_t": text, "_h": F.unhex(F.sha2(text.cast("binary"), 256))})


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: _h (SHA-256), keep_id (largest id), group_size."""
    base = _digest(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_raw")), "_raw")
    base = base.select("_id", "_h", "_t", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"))
    salted = base.groupBy("_h", "_salt", "_t").agg(F.max("_id").alias("_id"), F.count("*").alias("_n"))
    texts = salted.groupBy("_h", "_t").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    return texts.select("_h", F.md5("_t").alias("_h2"), "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Every row of ``docs`` with the group of its text.

    Returns doc_id, keep_id, group_size, kept, text_sha256.  Null text counts
    as empty.  The row with the largest id stays; rows that repeat both id and
    text carry the same flags; rows without an id count in the group and stay
    only if no row of the group has an id.  An empty table gives no rows, other
    columns are ignored.
    """
    top = stage(winners(docs, id_col, text_col, salts), "texts")
    light = _digest(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_raw")), "_raw")
    light = stage(light.select("doc_id", "_h", F.md5("_t").alias("_h2")), "digests")
    if not top.groupBy("_h", "_h2").count().filter("count > 1").isEmpty():
        raise ValueError("two texts share both their SHA-256 and their MD5")
    keys = ["_h", "_h2"]
    total = top.agg(F.sum("group_size")).first()[0] or 0
    is_hot = F.col("group_size") > max(1, total // HOT_SHARE)
    hot, cold = top.filter(is_hot), top.filter(~is_hot)
    tagged = light.join(F.broadcast(hot), keys, "left")  # hot: fewer than 1000 rows
    rows = tagged.filter("group_size is not null").unionByName(
        tagged.filter("group_size is null").drop("keep_id", "group_size").join(cold, keys)
    )
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_h")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    As :func:`exact_groups`; of rows that repeat both id and text, one stays.
    """
    top = stage(winners(docs, id_col, text_col), "texts")
    light = _digest(docs.select(F.col(f"`{id_col}`").alias("_keep"), F.col(f"`{text_col}`").alias("_raw")), "_raw")
    tied = stage(light.groupBy("_h", "_keep").count().filter("count > 1").drop("count"), "tied")
    rows = docs.select(F.struct("*").alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_raw"))
    left = _digest(rows, "_raw").select("_row", "_id", "_h")
    right = top.select(F.col("_h").alias("_wh"), "keep_id")
    kept = left.join(right, (F.col("_h") == F.col("_wh")) & F.col("_id").eqNullSafe(F.col("keep_id")), "left_semi")
    if tied.isEmpty():
        return kept.select("_row.*")
    mark = tied.select(F.col("_h").alias("_th"), "_keep")
    same = (F.col("_h") == F.col("_th")) & F.col("_id").eqNullSafe(F.col("_keep"))
    once = kept.join(mark, same, "left_semi").dropDuplicates(["_h"])
    return kept.join(mark, same, "left_anti").select("_row.*").unionByName(once.select("_row.*"))
