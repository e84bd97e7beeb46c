"""Equi joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SALTS = 64


def _salt(salts: int) -> Column:
    """Salt by position: neighbouring rows get different salts, so clustered keys are spread.

    The result of a salted join does not depend on the salt a row gets.
    """
    return F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")


def hot_keys(df: DataFrame, key: str, share: float = 0.001) -> list:
    """Keys that hold more than ``share`` of the rows: fewer than 1/share values.

    Counts are combined map side; only the keys above the line are gathered.
    """
    counts = df.groupBy(key).count()
    total = df.select(F.count("*").alias("n")).first()["n"]
    floor = max(10_000.0, total * share)
    rows = counts.filter((F.col("count") > floor) & F.col(key).isNotNull()).select(key).collect()
    return [r[0] for r in rows]


def skew_safe_join(
    big: DataFrame, small: DataFrame, key: str, hot: Sequence | None = None,
    how: str = "inner", salts: int = SALTS,
) -> DataFrame:
    """``big`` joined to ``small`` (one row per key) with hot keys salted.

    Rows of a hot key are spread over ``salts`` join keys and the matching row
    of ``small`` is repeated once per salt; all other keys join as they are.
    Neither side is hinted: the optimizer broadcasts ``small`` when its size
    allows and sort-merges otherwise.
    """
    hot = hot_keys(big, key) if hot is None else list(hot)
    if not hot:
        return big.join(small, key, how)
    is_hot = F.col(key).isin(hot)
    left = big.withColumn("_salt", F.when(is_hot | F.col(key).isNull(), _salt(salts)).otherwise(F.lit(0)))
    right = small.withColumn(
        "_salt",
        F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")


def _mark_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    mark = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    return df.join(mark, list(keys), "left")


def dimension_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left",
    salts: int = SALTS, share: float = 0.001, least: float = 10_000.0,
) -> DataFrame:
    """Join to a pre-aggregated table (one row per key).

    Nothing is hinted: the optimizer broadcasts ``small`` if its known size
    allows and shuffles otherwise.  The keys that hold more than ``share`` of
    the rows of ``big`` (fewer than 1/share) are salted on both sides, and so
    are rows without a key, which match nothing.  All of it is one lazy plan:
    no job runs before the result is asked for.
    """
    total = big.select(F.count("*").alias("n")).scalar()
    floor = F.greatest(F.lit(float(least)), total * F.lit(float(share)))
    hot = big.groupBy(*keys).count().filter(F.col("count") > floor).select(*keys)
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    left = _mark_hot(big, hot, keys).withColumn(
        "_salt", F.when(F.col("_hot") | keyless, _salt(salts)).otherwise(F.lit(0))
    )
    right = _mark_hot(small, hot, keys).withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
                F.array(F.lit(0))
            )
        ),
    )
    joined = left.drop("_hot").join(right.drop("_hot"), [*keys, "_salt"], how)
    return joined.drop("_salt")
