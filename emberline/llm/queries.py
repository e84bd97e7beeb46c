"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.expr import rnd
from emberline.llm.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(m: int, of: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo m."""
    return F.pmod(F.crc32(F.col(of).cast("string")), F.lit(m))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.mixing import mixture

    mixed = mixture(table(spark, sf_dir, "documents"))
    return mixed.select(
        "_row.doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("tokens"),
        rnd("_weight", 9).alias("cell_weight"),
        rnd("_probability", 9).alias("probability"),
        F.col("_kept").alias("kept"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from emberline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.quality import classify

    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5) != 0)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.lm_scoring import score

    scored = score(table(spark, sf_dir, "documents"), fold(5) != 1)
    return scored.select(
        "doc_id", (fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.language_id import identify

    found = identify(table(spark, sf_dir, "documents"), fold(4) != 2)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.near_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.merkle import build_manifest, lower_ascii, source_tops, verify

    text = F.col("text").cast("string")
    manifest = build_manifest(table(spark, sf_dir, "documents"), F.when(fold(5) == 0, lower_ascii(text)))
    roots = source_tops(manifest).select(
        F.col("tree").alias("_source"), F.lower(F.hex("subroot")).alias("subroot")
    )
    rows = verify(manifest)
    return rows.join(roots, rows.source.eqNullSafe(roots._source)).select(
        "doc_id", "leaf", "subroot", F.lit(manifest.root.hex() if manifest.root else None).cast("string").alias("root"),
        "proof_sha256", "folded_root", "verified",
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.lexical_search import build_index, search

    index = build_index(table(spark, sf_dir, "documents"))
    return search(index, table(spark, sf_dir, "benchmark"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from emberline.llm.token_files import read_documents, write_token_files
    from emberline.sources.staging import new_path

    folder = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return read_documents(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_packing, op3_neighbours, op4_quality, op5_exact_dedup, op6_lm_scoring,
        op7_suffix_dedup, op8_language_id, op9_near_dedup, op10_url_filter,
        op11_merkle, op12_lexical_search, op13_token_files,
    )
}
