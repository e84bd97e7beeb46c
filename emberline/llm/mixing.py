"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are counted into cells of (source, language, topic).  Cell weights
are raked until their sums meet the target share of every source, language and
topic; the cells then say with which probability a document is drawn.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.sources.staging import stage

MARGINS = ("_source", "_lang", "_topic")
ROUNDS = 8  # of raking; each adjusts all three margins
BUDGET = 0.5  # share of the tokens to be drawn
FLATTEN = 0.5  # a source's target share grows with its tokens to this power
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """A coarse topic from the form of a text: marked-up, list, note or article.

    Stands in for a topic column where a corpus has none.
    """
    marks = F.length(F.regexp_replace(text, r"[^#$%&*|<>{}=_\[\]]", ""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (
        F.when(marks * 25 > F.length(text), "markup")
        .when(lines * 60 > F.length(text), "list")
        .when(F.length(text) < 600, "note")
        .otherwise("article")
    )


def tagged(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> DataFrame:
    """_row (all columns), _source, _lang, _topic, _tokens and the uniform draw _u of each row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.md5(text)))), 1, 8), 16, 10)
    return docs.select(F.struct("*").alias("_row"), *[
        c.alias(k)
        for k, c in {
            "_source": F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NONE)),
            "_lang": F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NONE)),
            "_topic": F.coalesce(topic_of(text) if topic is None else topic.cast("string"), F.lit(NONE)),
            "_tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
            "_u": draw.cast("double") / F.lit(4294967296.0),
        }.items()
    ])


def _target(cells: DataFrame, margin: str, power: float, given: Mapping[str, float] | None) -> DataFrame:
    """(margin, target): shares that add up to 1 over the values that have tokens."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("_t")).filter("_t > 0")
    if given is None:
        raw = F.pow(F.col("_t"), F.lit(power))
    else:
        raw = F.lit(0.0)
        for k, v in given.items():
            raw = F.when(F.col(margin) == k, F.lit(float(v))).otherwise(raw)
    sums = sums.select(margin, raw.alias("_r"))
    total = sums.agg(F.sum("_r").alias("all")).first()["all"] or 0.0
    return sums.select(margin, (F.col("_r") / F.lit(total) if total else F.lit(0.0)).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Cells (three margins, tokens) with ``weight``: token shares fitted to all targets.

    Each step multiplies the cells of one margin value by target / current sum.
    The cell table is written after each round.
    """
    total = cells.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    fitted = cells.filter("tokens > 0").withColumn("weight", F.col("tokens") / F.lit(float(total or 1)))
    for _ in range(rounds):
        for margin in MARGINS:
            now = fitted.groupBy(margin).agg(F.sum("weight").alias("_now"))
            factor = now.join(targets[margin], margin).select(
                margin, F.when(F.col("_now") > 0, F.col("target") / F.col("_now")).otherwise(0.0).alias("_f")
            )
            fitted = fitted.join(factor, margin).withColumn("weight", F.col("weight") * F.col("_f")).drop("_f")
        fitted = stage(fitted.select(*MARGINS, "tokens", "weight"), "raked")
    return fitted


def calibrate(fitted: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Adds ``probability``: min(1, level * weight / tokens), drawing ``budget`` of all tokens on average.

    The level is raised until the cells that are not yet taken whole make up
    for those that are; each step reads the cell table once.
    """
    total = fitted.agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w")).first()
    wanted, level = budget * (total["t"] or 0), None
    while True:
        free = F.lit(True) if level is None else F.col("weight") * F.lit(level) < F.col("tokens")
        part = fitted.agg(
            F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(~free, F.col("tokens"))).alias("t")
        ).first()
        if not part["w"]:
            break
        rise = (wanted - (part["t"] or 0)) / part["w"]
        if level is not None and rise <= level * (1 + 1e-9):
            break
        level = rise
    return fitted.withColumn("probability", F.least(F.lit(1.0), F.lit(level or 0.0) * F.col("weight") / F.col("tokens")))


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    source_targets: Mapping[str, float] | None = None,
    lang_targets: Mapping[str, float] | None = None,
    topic_targets: Mapping[str, float] | None = None,
    budget: float = BUDGET,
) -> DataFrame:
    """Rows of ``docs`` as the struct _row, with _source, _lang, _topic, _tokens, _weight, _probability, _kept.

    Without given targets, source shares follow the square root of the tokens,
    language shares too, and topics their own tokens.  Null margins form the
    value `(none)`.  A document without words has weight 0 and probability 0,
    because it brings no token.  A value whose target is 0 is never drawn.  The
    draw is a hash of the id (of the text where the id is null), so repeated
    rows share it.  An empty table gives no rows.
    """
    rows = tagged(docs, id_col, text_col, source_col, lang_col, topic)
    cells = stage(
        rows.select(*MARGINS, "_tokens").groupBy(*MARGINS).agg(F.sum("_tokens").alias("tokens")), "cells"
    )
    given = {"_source": (FLATTEN, source_targets), "_lang": (FLATTEN, lang_targets), "_topic": (1.0, topic_targets)}
    targets = {m: stage(_target(cells, m, *given[m]), "targets") for m in MARGINS}
    fitted = stage(calibrate(rake(cells, targets), budget), "calibrated").select(
        *MARGINS, F.col("weight").alias("_weight"), F.col("probability").alias("_probability")
    )
    return (
        rows.join(fitted, list(MARGINS), "left")
        .withColumns({
            "_weight": F.coalesce("_weight", F.lit(0.0)),
            "_probability": F.when(F.col("_tokens") > 0, F.coalesce("_probability", F.lit(0.0))).otherwise(F.lit(0.0)),
        })
        .withColumn("_kept", F.col("_u") < F.col("_probability"))
    )


def sample_mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns."""
    return mixture(docs, **options).filter("_kept").select("_row.*")
