"""Data set reports: plain aggregates over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline import fixed_values as fv
from emberline.functions.expr import count_if, fixed_sum, rnd


def dataset_summary(df: DataFrame) -> DataFrame:
    n = F.count("*")
    return df.agg(
        n.alias("n_events"),
        rnd(fixed_sum("consumption_kg", 2) / n, 1).alias("avg_consumption_kg"),
        F.max("consumption_kg").alias("max_consumption_kg"),
        rnd(F.sum("cylinders_needed") / n, 1).alias("avg_cylinders_needed"),
        rnd(F.sum("ran_out_of_gas") / n * F.lit(100.0), 1).alias("stockout_rate_pct"),
        F.min("commercial_price_inr").alias("min_price_inr"),
        F.max("commercial_price_inr").alias("max_price_inr"),
        count_if(F.col("wedding_season") == 1).alias("wedding_season_events"),
        count_if(F.col("covid_period") == 1).alias("covid_period_events"),
    )


def share_of(df: DataFrame, column: str) -> DataFrame:
    """Share of each value in %, 1 decimal."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("n_total")).scalar()
    return counts.withColumn("share_pct", rnd(F.col("n") / total * F.lit(100.0), 1))


def monthly_mean(df: DataFrame, value: str = "consumption_kg", places: int = 2) -> DataFrame:
    return df.groupBy("month").agg(
        rnd(fixed_sum(value, places) / F.count(value), 1).alias(f"avg_{value}")
    )


def type_profile(df: DataFrame) -> DataFrame:
    """Share and mean consumption per event type."""
    by_type = df.groupBy("event_type").agg(
        F.count("*").alias("n"),
        rnd(fixed_sum("consumption_kg", 2) / F.count("*"), 1).alias("avg_consumption_kg"),
    )
    total = df.agg(F.count("*").alias("n_total")).scalar()
    return by_type.withColumn("share_pct", rnd(F.col("n") / total * F.lit(100.0), 1))


def benchmark_check(df: DataFrame, band: tuple = fv.KG_PER_GUEST_BAND) -> DataFrame:
    """kg per guest per event type against the benchmark band."""
    per_guest = rnd(F.col("consumption_kg") / F.col("headcount"), 4)
    return (
        df.withColumn("_kg", per_guest)
        .groupBy("event_type")
        .agg(
            F.count("*").alias("n_events"),
            rnd(fixed_sum("_kg", 4) / F.count("*"), 4).alias("avg_kg_per_guest"),
            count_if(~F.col("_kg").between(*band)).alias("n_out_of_band"),
        )
        .withColumn("in_band", F.col("avg_kg_per_guest").between(*band).cast("int"))
    )


def stockout_rate(df: DataFrame, label: str = "ran_out_of_gas", warn_above: float = 40.0):
    rate = F.try_divide(F.sum(label), F.count("*")) * F.lit(100.0)
    return df.agg(
        F.count("*").alias("n_events"),
        F.sum(label).alias("stockout_events"),
        rnd(rate, 1).alias("stockout_rate_pct"),
        (rate > warn_above).cast("int").alias("rate_warning"),
    )


def top_k(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """The ``k`` rows with the largest ``by``; ties go to the lower ``tie``.

    Each task keeps its own best ``k`` before the merge.
    """
    return df.orderBy(F.col(by).desc(), F.col(tie)).limit(k)


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)
