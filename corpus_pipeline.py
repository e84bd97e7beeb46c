"""Documents to training sequences: five stages, each written and read again.

ORACLE_SQL is None: learned language scores and tokenizer ids have no SQL form;
tests/llm compares the stages with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberline.llm.exact_dedup import exact_dedup
from emberline.llm.language_id import keep_known
from emberline.llm.mixing import sample_mixture
from emberline.llm.near_dedup import near_dedup
from emberline.llm.packing import pack
from emberline.llm.queries import fold, table
from emberline.llm.shipping import ship
from emberline.sources.staging import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a score of 0.3 or more; ``lang`` becomes the language found.

    Null texts and texts without a letter go.  Without any labelled row all
    rows stay as they are.  Null and repeated ids and repeated rows are judged
    each by their own text; an empty table stays empty; other columns stay.
    """
    ship(spark)
    return keep_known(docs, fold(4) != 2, found_col="lang")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest id.

    A null text counts as empty.  Of rows that repeat both id and text one
    stays; a row without an id stays only if no row of its text has one.
    """
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, at 0.8 of their five-word shingles or more: the smallest id.

    Texts without words are near to nothing and stay; so do rows without an
    id.  Rows that repeat an id stay or go together.
    """
    ship(spark)
    return near_dedup(docs, threshold=80, per_band=5)  # a pair at 0.8 is missed by all bands with 3e-6


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares follow the targets of source, language and topic.

    A missing source or language is a group of its own.  Texts without words
    have no tokens to draw and go; repeated rows share one draw.
    """
    return sample_mixture(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    A null or empty text is its end token alone; null and repeated ids are
    packed row by row; an empty table gives no pieces.
    """
    ship(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("packing", sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
