"""Wastage records: category mapping, rates, observed and benchmark rates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import fixed_values as fv
from emberline.functions.expr import as_col, fixed_avg, lookup, rnd


def remap_category(c: Column | str, mapping: Mapping, default) -> Column:
    """Mapped value; unknown and null go to ``default``."""
    return lookup(c, mapping, default)


def wastage_rate(wasted: Column | str, quantity: Column | str) -> Column:
    """Wasted share of the quantity (at least 1), 4 decimals."""
    return rnd(as_col(wasted) / F.greatest(as_col(quantity), F.lit(1.0)), 4)


def process_wastage(df: DataFrame) -> DataFrame:
    """Raw records with mapped categories and the wastage rate."""
    return df.withColumns(
        {
            "event_type": remap_category(
                "event_type_raw", fv.EVENT_TYPE_OF_RAW, fv.DEFAULT_EVENT_TYPE
            ),
            "wastage_rate": wastage_rate("wastage_amount", "quantity_of_food"),
            "cooking_intensity": remap_category(
                "preparation", fv.INTENSITY_OF_PREPARATION, fv.DEFAULT_INTENSITY
            ),
            "season": remap_category("seasonality", fv.SEASON_OF_RAW, fv.DEFAULT_SEASON),
        }
    )


def mean_rate_by_type(processed: DataFrame) -> DataFrame:
    """Mean observed wastage rate per event type."""
    return processed.groupBy("event_type").agg(
        rnd(fixed_avg("wastage_rate", 4), 8).alias("mean_wastage_rate"),
        F.count("*").alias("n_records"),
    )


def rates_by_order(lines: DataFrame, order: str, wasted: Column, quantity: Column) -> DataFrame:
    """Line count, summed rate (in ten-thousandths) and number of rates of each order.

    Lines are combined map side, so an order of any size is one row a task.
    """
    rate = wastage_rate(wasted, quantity)
    return lines.groupBy(order).agg(
        F.count("*").alias("n_lines"),
        F.sum(F.floor(rate * F.lit(10_000.0) + F.lit(0.5))).alias("rate_units"),
        F.count(rate).alias("n_rates"),
    )


def mean_rate_of_orders(orders: DataFrame) -> DataFrame:
    """As :func:`mean_rate_by_type`, from orders (event_type, n_lines, rate_units, n_rates) instead of their lines."""
    return orders.groupBy("event_type").agg(
        rnd(F.try_divide(F.sum("rate_units") / F.lit(10_000.0), F.sum("n_rates")), 8).alias("mean_wastage_rate"),
        F.sum("n_lines").alias("n_records"),
    )


def rate_lookup(events: DataFrame, observed: DataFrame) -> DataFrame:
    """Adds ``wastage_rate``: observed mean, else benchmark, else the default.

    ``observed`` holds one row per event type; it is cut to the vocabulary of
    eight types, which bounds what is broadcast.
    """
    rates = observed.filter(F.col("event_type").isin(*fv.EVENT_TYPES)).select(
        "event_type", F.col("mean_wastage_rate").alias("_observed")
    )
    return (
        events.join(F.broadcast(rates), "event_type", "left")
        .withColumn(
            "wastage_rate",
            F.coalesce(
                "_observed",
                lookup("event_type", fv.BENCHMARK_WASTAGE_RATE),
                F.lit(fv.DEFAULT_WASTAGE_RATE),
            ),
        )
        .drop("_observed")
    )
