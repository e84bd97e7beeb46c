"""Dealer demand: daily curve, spikes, shifting of orders, KPIs.

Plans are pre-aggregated to one row per (dealer, day) before anything is
joined or ordered; a dealer's window then holds the days of the planning
window.  Ranking the plans of one day goes through ``ordered_position``, so a
dealer-day may hold any share of the plans.

``plans`` has event_id, dealer, recommended_order_date,
latest_safe_order_date, cylinders_to_order, stockout_risk_pct and, for the
KPIs, the remaining plan columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline import fixed_values as fv
from emberline.functions.expr import as_col, count_if, fixed_sum, flag, rnd
from emberline.operators.joins import dimension_join
from emberline.operators.ordered import ordered_position
from emberline.sources.staging import stage

DAY = "recommended_order_date"
SPIKE_SHARE = 0.80


def _as_of(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def daily_orders(plans: DataFrame, as_of: str, days: int = 30, keys=("dealer",)) -> DataFrame:
    """Cylinders per dealer and order day inside the window.

    The date range is a plain filter, so it reaches the scan of a plan table.
    """
    start = _as_of(as_of)
    return (
        plans.filter((F.col(DAY) >= start) & (F.col(DAY) < F.date_add(start, days)))
        .groupBy(*keys, F.col(DAY).alias("date"))
        .agg(F.sum("cylinders_to_order").alias("cylinders"))
    )


def demand_curve(plans: DataFrame, as_of: str, days: int = 30, keys=("dealer",)) -> DataFrame:
    """Raw demand for every dealer and every day of the window (0 where none).

    One scan: sums per dealer and day, then at most ``days`` day sums per
    dealer as a map, from which the date grid is filled.  A dealer whose
    orders all fall outside the window still gets a curve.
    """
    start = _as_of(as_of)
    inside = (F.col(DAY) >= start) & (F.col(DAY) < F.date_add(start, days))
    daily = (
        plans.withColumn("date", F.when(inside, F.col(DAY)))
        .groupBy(*keys, "date")
        .agg(F.sum("cylinders_to_order").alias("cylinders"))
    )
    day_sum = F.when(F.col("date").isNotNull(), F.struct("date", "cylinders"))
    per_dealer = daily.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(day_sum)).alias("_by_day")
    )
    grid = F.sequence(start, F.date_add(start, days - 1))
    return per_dealer.withColumn("date", F.explode(grid)).select(
        *keys,
        "date",
        F.coalesce(F.try_element_at("_by_day", F.col("date")), F.lit(0)).cast("long").alias("raw_demand"),
        (F.weekday("date") >= 5).alias("is_weekend"),
    )


def rolling_mean_centered(
    df: DataFrame, keys: Sequence[str], order: str, value: str, target: str
) -> DataFrame:
    """Mean over the previous, this and the next row; shorter at the edges."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-1, 1)
    mean = F.sum(F.col(value)).over(w) / F.count(F.col(value)).over(w)
    return df.withColumn(target, rnd(mean, 1))


def capacity_columns(raw: Column | str, capacity: Column | int) -> dict[str, Column]:
    cap = capacity if isinstance(capacity, Column) else F.lit(capacity)
    return {
        "capacity_pressure": rnd(as_col(raw) / cap * F.lit(100.0), 1),
        "spike_flag": as_col(raw) > cap * F.lit(SPIKE_SHARE),
    }


def demand_curve_full(
    plans: DataFrame, as_of: str, capacity: Column | int, days: int = 30, keys=("dealer",)
) -> DataFrame:
    """Curve with the smoothed mean, capacity pressure and spike flag."""
    curve = demand_curve(plans, as_of, days, keys)
    curve = rolling_mean_centered(curve, keys, "date", "raw_demand", "smoothed_demand")
    return curve.withColumns(capacity_columns("raw_demand", capacity))


def spike_days(
    plans: DataFrame, as_of: str, capacity: Column | int, days: int = 30, keys=("dealer",)
) -> DataFrame:
    """Dealer-days above 80 % of the capacity: at most dealers x days rows."""
    daily = daily_orders(plans, as_of, days, keys)
    flagged = daily.withColumns(capacity_columns("cylinders", capacity))
    return flagged.filter("spike_flag").select(*keys, F.col("date").alias(DAY))


def shift_rank(
    plans: DataFrame, as_of: str, capacity: Column | int, days: int = 30, keys=("dealer",)
) -> DataFrame:
    """Plans of spike days ranked by risk, then id; the first half are candidates."""
    spikes = spike_days(plans, as_of, capacity, days, keys)
    return _rank_spikes(dimension_join(plans, spikes, [*keys, DAY], "left_semi"), keys)


def _rank_spikes(on_spike: DataFrame, keys) -> DataFrame:
    risk_tenths = F.floor(F.col("stockout_risk_pct") * F.lit(10.0) + F.lit(0.5)).cast("int")
    ranked = ordered_position(on_spike, [*keys, DAY], risk_tenths, "event_id")
    return ranked.withColumns(
        {
            "shift_rank": F.col("prefix") + 1,
            "day_plans": F.col("group_total"),
            "is_candidate": F.col("prefix") < F.floor(F.col("group_total") / F.lit(2)),
        }
    ).drop("prefix", "group_total")


def shift_plan(
    plans: DataFrame,
    as_of: str,
    capacity: Column | int,
    days: int = 30,
    keys=("dealer",),
    guard: str = "documented",
) -> DataFrame:
    """Moves the low-risk half of each spike day 2 days (risk < 15) or 1 day ahead.

    ``guard`` ``documented`` keeps a move that stays on or before the latest
    safe date; ``reference`` requires the new date to be on or after it, which
    no earlier date satisfies, so nothing moves.  Each order moves at most
    once.  All plans are returned, with ``original_order_date`` and
    ``shifted_days``.  Plans of other days pass through, so only those of spike
    days are moved and ranked.
    """
    if guard not in ("documented", "reference"):
        raise ValueError("guard must be 'documented' or 'reference'")
    spikes = spike_days(plans, as_of, capacity, days, keys).withColumn("_spike", F.lit(True))
    marked = dimension_join(plans, spikes, [*keys, DAY])
    ranked = _rank_spikes(marked.filter("_spike").drop("_spike"), keys)
    step = F.when(F.col("stockout_risk_pct") < 15, 2).otherwise(1)
    target = F.date_sub(F.col(DAY), step)
    latest = F.col("latest_safe_order_date")
    allowed = target <= latest if guard == "documented" else target >= latest
    moves = F.when(F.col("is_candidate") & allowed, step)
    out = ranked.select(*plans.columns, moves.alias("_step")).unionByName(
        marked.filter("_spike is null").select(*plans.columns, F.lit(None).cast("int").alias("_step"))
    )
    out = out.withColumns(
        {
            "original_order_date": F.col(DAY),
            "shifted_days": F.coalesce("_step", F.lit(0)),
        }
    )
    out = out.withColumn(DAY, F.date_sub(F.col(DAY), F.col("shifted_days")))
    if "optimization_notes" in plans.columns:
        out = out.withColumn(
            "optimization_notes",
            F.when(
                F.col("shifted_days") > 0,
                F.concat(
                    "optimization_notes", F.format_string(fv.NOTE_SHIFTED, F.col("shifted_days"))
                ),
            ).otherwise(F.col("optimization_notes")),
        )
    return out.drop("_step")


def smoothed_curve(
    plans: DataFrame,
    shifted: DataFrame,
    as_of: str,
    capacity: Column | int,
    days: int = 30,
    keys=("dealer",),
) -> DataFrame:
    """Curve before and after shifting; the reduction is negative on receiving days."""
    raw = demand_curve_full(plans, as_of, capacity, days, keys)
    after = daily_orders(shifted, as_of, days, keys).withColumnRenamed("cylinders", "_after")
    base = F.when(F.col("raw_demand") == 0, F.lit(1)).otherwise(F.col("raw_demand"))
    return (
        raw.join(after, [*keys, "date"], "left")
        .withColumn("smoothed_orders", F.coalesce("_after", F.lit(0)).cast("long"))
        .withColumn(
            "peak_reduction_pct",
            rnd((F.col("raw_demand") - F.col("smoothed_orders")) / base * F.lit(100.0), 1),
        )
        .drop("_after")
    )


def _plan_totals(plans: DataFrame, keys: Sequence[str]) -> DataFrame:
    return plans.groupBy(*keys).agg(
        F.count("*").alias("n_plans"),
        F.sum("cylinders_to_order").alias("cylinders"),
        fixed_sum("estimated_cost_inr", 0).alias("cost"),
        fixed_sum("stockout_risk_pct", 1).alias("risk"),
        fixed_sum("wastage_estimate_kg", 2).alias("waste"),
        count_if(F.col("recommendation_tier") == "RED").alias("n_red"),
        count_if(F.col("stockout_risk_pct") > 50).alias("n_stockout"),
    )


def regional_summary(
    plans: DataFrame, curve: DataFrame, capacity: Column | int, keys=("dealer",)
) -> DataFrame:
    """Eleven KPIs per dealer: totals over all plans, peaks over the window."""
    cap = capacity if isinstance(capacity, Column) else F.lit(capacity)
    days = curve.groupBy(*keys).agg(
        F.max("raw_demand").alias("peak_demand_cylinders"),
        rnd(F.sum("raw_demand") / F.count("*"), 1).alias("avg_daily_demand"),
        count_if(F.col("spike_flag")).alias("spike_days_count"),
    )
    return (
        _plan_totals(plans, keys)
        .join(days, list(keys))
        .select(
            *keys,
            F.col("n_plans").alias("total_caterers"),
            F.col("cylinders").alias("total_cylinders_30d"),
            F.col("cost").alias("total_revenue_inr"),
            rnd(F.col("risk") / F.col("n_plans"), 1).alias("avg_stockout_risk_pct"),
            "peak_demand_cylinders",
            "avg_daily_demand",
            cap.alias("dealer_capacity"),
            "spike_days_count",
            F.col("n_red").alias("high_risk_caterers"),
            rnd(F.col("avg_daily_demand") / cap * F.lit(100.0), 1).alias(
                "capacity_utilization_pct"
            ),
        )
    )


def before_after(
    plans: DataFrame,
    curve: DataFrame,
    keys=("dealer",),
    naive_waste: float = 1.4,
    naive_cost: float = 1.08,
) -> DataFrame:
    """Naive booking against the plan: the factors are assumptions, not findings."""
    peaks = curve.groupBy(*keys).agg(
        F.max("raw_demand").alias("peak_before"), F.max("smoothed_orders").alias("peak_after")
    )
    t = _plan_totals(plans, keys).join(peaks, list(keys))
    t = t.withColumns(
        {"_nw": F.col("waste") * F.lit(naive_waste), "_nc": F.col("cost") * F.lit(naive_cost)}
    )
    return t.select(
        *keys,
        F.col("n_plans").alias("total_events"),
        F.col("n_stockout").alias("before_stockout_events"),
        rnd("_nw", 1).alias("before_wastage_kg"),
        rnd("_nc", 2).alias("before_cost_inr"),
        "peak_before",
        rnd(F.col("risk") / F.col("n_plans"), 1).alias("after_avg_risk_pct"),
        rnd("waste", 1).alias("after_wastage_kg"),
        F.col("cost").alias("after_cost_inr"),
        "peak_after",
        rnd(
            (F.col("_nw") - F.col("waste")) / F.greatest(F.col("_nw"), F.lit(1.0)) * F.lit(100.0), 1
        ).alias("wastage_reduction_pct"),
        rnd(F.col("_nc") - F.col("cost"), 2).alias("cost_saving_inr"),
        rnd(
            (F.col("peak_before") - F.col("peak_after"))
            / F.greatest(F.col("peak_before"), F.lit(1))
            * F.lit(100.0),
            1,
        ).alias("peak_demand_reduction_pct"),
    )


def regional_forecast(
    plans: DataFrame,
    as_of: str,
    capacity: Column | int,
    days: int = 30,
    keys=("region", "dealer"),
    guard: str = "documented",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, before/after, curve) for all regions and dealers at once.

    ``plans`` should be a staged table: it is read by several jobs.
    """
    shifted = shift_plan(plans, as_of, capacity, days, keys, guard)
    curve = stage(smoothed_curve(plans, shifted, as_of, capacity, days, keys), "curve")
    return (
        regional_summary(plans, curve, capacity, keys),
        before_after(plans, curve, keys),
        curve,
    )


def forecast_table(
    plans: DataFrame, as_of: str, capacity: Column | int, days: int = 30,
    keys=("region", "dealer"), guard: str = "documented",
) -> DataFrame:
    """Summary and before/after side by side, one row per dealer."""
    summary, change, _ = regional_forecast(plans, as_of, capacity, days, keys, guard)
    return summary.join(change, list(keys))


def delivery_cap(
    plans: DataFrame, daily_cap: int, keys=("dealer",), day: str = DAY
) -> DataFrame:
    """Running cylinders of a dealer-day by risk (highest first), then id.

    Adds ``running_cylinders``, ``day_cylinders``, ``within_cap`` for the plan
    and ``day_over_cap`` for its day.
    """
    level = -F.floor(F.col("stockout_risk_pct") * F.lit(10.0) + F.lit(0.5)).cast("int")
    ranked = ordered_position(
        plans, [*keys, day], level, "event_id", weight=F.col("cylinders_to_order")
    )
    running = F.col("prefix") + F.col("cylinders_to_order")
    return ranked.withColumns(
        {
            "running_cylinders": running,
            "day_cylinders": F.col("group_total"),
            "within_cap": flag(running <= daily_cap),
            "day_over_cap": flag(F.col("group_total") > daily_cap),
        }
    ).drop("prefix", "group_total")


def caterer_rollup(plans: DataFrame, floor_score: float = 65.0) -> DataFrame:
    """Wastage and efficiency per caterer; low mean efficiency is flagged."""
    mean_eff = rnd(fixed_sum("efficiency_score", 1) / F.count("*"), 1)
    return (
        plans.groupBy("caterer_id")
        .agg(
            F.count("*").alias("n_events"),
            rnd(fixed_sum("predicted_consumption_kg", 2), 2).alias("total_kg"),
            rnd(fixed_sum("wastage_estimate_kg", 2), 2).alias("total_wastage_kg"),
            mean_eff.alias("avg_efficiency"),
        )
        .withColumns(
            {
                "wastage_pct": rnd(
                    F.col("total_wastage_kg")
                    / F.greatest(F.col("total_kg"), F.lit(1.0))
                    * F.lit(100.0),
                    2,
                ),
                "inefficient": flag(F.col("avg_efficiency") < floor_score),
            }
        )
    )
