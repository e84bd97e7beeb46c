"""Monthly price series: grid, interpolation, lags, lookup.

All windows are partitioned by series; a partition holds the months of one
series (12 rows a year), so its size is set by the calendar and not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline import fixed_values as fv
from emberline.functions.expr import rnd
from emberline.sources.tables import parse_date_lenient


def anchors_table(spark: SparkSession, series: str = "commercial") -> DataFrame:
    """The six published price anchors as (series, date, commercial_price_inr)."""
    raw = spark.createDataFrame(
        [(series, d, p) for d, p in fv.PRICE_ANCHORS],
        "series string, date_str string, commercial_price_inr double",
    )
    return parse_date_lenient(raw, "date_str").select("series", "date", "commercial_price_inr")


def month_grid(
    anchors: DataFrame,
    keys: Sequence[str],
    start: str | date | None = None,
    end: str | date | None = None,
    date_col: str = "date",
) -> DataFrame:
    """Every month between ``start`` and ``end`` for each series.

    Without bounds the grid runs over each series' own first to last anchor.
    """
    spans = anchors.groupBy(*keys).agg(
        (F.lit(start).cast("date") if start else F.trunc(F.min(date_col), "MM")).alias("_from"),
        (F.lit(end).cast("date") if end else F.trunc(F.max(date_col), "MM")).alias("_to"),
    )
    step = F.expr("interval 1 month")
    return spans.select(
        *keys, F.explode(F.sequence("_from", "_to", step)).alias(date_col)
    )


def grid_left_join(
    anchors: DataFrame,
    keys: Sequence[str],
    start: str | date | None = None,
    end: str | date | None = None,
    date_col: str = "date",
) -> DataFrame:
    """Month grid left joined to the anchors on (series, month)."""
    grid = month_grid(anchors, keys, start, end, date_col)
    return grid.join(anchors, [*keys, date_col], "left")


def interpolate_linear(
    df: DataFrame, keys: Sequence[str], order: str, value: str, target: str | None = None
) -> DataFrame:
    """Fill gaps linearly by position in the series.

    After the last known value it is carried on; before the first known value
    the first one is used.
    """
    target = target or value
    upto = Window.partitionBy(*keys).orderBy(order)
    back = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = upto.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = F.col(value).isNotNull()
    with_pos = df.withColumn("_pos", F.row_number().over(upto))
    ends = with_pos.withColumns(
        {
            "_v0": F.last(value, ignorenulls=True).over(back),
            "_p0": F.last(F.when(known, F.col("_pos")), ignorenulls=True).over(back),
            "_v1": F.first(value, ignorenulls=True).over(ahead),
            "_p1": F.first(F.when(known, F.col("_pos")), ignorenulls=True).over(ahead),
        }
    )
    filled = (
        F.when(known, F.col(value))
        .when(F.col("_v0").isNull(), F.col("_v1"))
        .when(F.col("_v1").isNull(), F.col("_v0"))
        .otherwise(
            F.col("_v0")
            + (F.col("_v1") - F.col("_v0"))
            * (F.col("_pos") - F.col("_p0"))
            / (F.col("_p1") - F.col("_p0"))
        )
    )
    return ends.withColumn(target, filled).drop("_pos", "_v0", "_p0", "_v1", "_p1")


def lag_features(
    df: DataFrame, keys: Sequence[str], order: str, value: str, names: Sequence[str]
) -> DataFrame:
    """Lag 1, 2, ... under the given names; leading rows stay null."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({n: F.lag(value, i).over(w) for i, n in enumerate(names, start=1)})


def diff_feature(
    df: DataFrame, keys: Sequence[str], order: str, value: str, name: str
) -> DataFrame:
    """Change against the previous row; 0 on the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.coalesce(F.col(value) - F.lag(value, 1).over(w), F.lit(0.0)))


def monthly_series(
    anchors: DataFrame,
    keys: Sequence[str] = ("series",),
    start: str | date | None = None,
    end: str | date | None = None,
    value: str = "commercial_price_inr",
) -> DataFrame:
    """Anchors to a complete monthly series with lags and monthly change."""
    s = grid_left_join(anchors, keys, start, end)
    s = interpolate_linear(s, keys, "date", value)
    s = lag_features(s, keys, "date", value, ("price_lag1", "price_lag2"))
    s = diff_feature(s, keys, "date", value, "price_mom_change")
    return s.withColumns({"year": F.year("date"), "month": F.month("date")}).select(
        *keys, "date", value, "year", "month", "price_lag1", "price_lag2", "price_mom_change"
    )


def reference_series(spark: SparkSession) -> DataFrame:
    """The monthly commercial price series the event table is priced with."""
    return monthly_series(anchors_table(spark), ("series",), *fv.PRICE_GRID)


def series_summary(df: DataFrame, date_col: str = "date", value: str = "commercial_price_inr"):
    """Row count, price range and year range in one aggregate."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.min(value).alias("min_price"),
        F.max(value).alias("max_price"),
        F.min(F.year(date_col)).alias("first_year"),
        F.max(F.year(date_col)).alias("last_year"),
    )


def price_lookup(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Events left joined to one monthly series on (year, month).

    A month the series does not cover takes fixed values; a covered month
    keeps its null lags, which are imputed later.  ``prices`` has one row per
    calendar month and is cut to three centuries, which bounds what is
    broadcast: a shuffle on the few (year, month) keys would pile the events
    up in as many tasks.
    """
    names = {
        "commercial_price_inr": "commercial_price_inr",
        "price_lag1_inr": "price_lag1",
        "price_lag2_inr": "price_lag2",
        "price_mom_change_inr": "price_mom_change",
    }
    side = prices.filter(F.col("year").between(1900, 2199)).select(
        "year",
        "month",
        F.lit(True).alias("_hit"),
        *[F.col(src).alias(f"_{out}") for out, src in names.items()],
    )
    joined = events.join(F.broadcast(side), ["year", "month"], "left")
    priced = joined.withColumns(
        {
            out: F.when(F.col("_hit").isNull(), F.lit(fv.PRICE_MISS[out])).otherwise(
                rnd(F.col(f"_{out}"), 2)
            )
            for out in names
        }
    )
    return priced.drop("_hit", *[f"_{out}" for out in names])
