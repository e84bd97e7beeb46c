"""Procurement plan of an event: quantity, dates, risk, cost, tier, actions.

After the caterer's profile is joined, every step is a column expression, so
the whole plan is one map stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import fixed_values as fv
from emberline.functions.expr import as_col, fixed_sum, lookup, rnd
from emberline.operators.joins import dimension_join, skew_safe_join


def profile_join(
    events: DataFrame, profiles: DataFrame, on: str = "caterer_id", hot: Sequence | None = None
) -> DataFrame:
    """Events with their caterer's profile (inner, n:1).

    The profile table grows with the data, so it is never hinted; caterers
    with a large share of the events (``hot``, found by counting when not
    given) are salted.
    """
    return skew_safe_join(events, profiles, on, hot)


def lead_days(
    place: Column | str,
    table: Mapping[str, int] = fv.DELIVERY_LEAD_DAYS,
    default: int = fv.DEFAULT_LEAD_DAYS,
) -> Column:
    """Delivery days of a city or region."""
    return lookup(place, table, default)


def rule_consumption(festival: Column | str = "is_festival_season") -> Column:
    """Rule-based fuel estimate in kg (at least 1.5, 2 decimals)."""
    per_100 = lookup("menu_profile", fv.GAS_PER_100_GUESTS, fv.DEFAULT_GAS_PER_100_GUESTS)
    kg = (
        F.col("headcount")
        / F.lit(100.0)
        * per_100
        * (F.col("duration_hrs") / F.lit(5.0))
        * (F.lit(1.0) + (F.col("num_burners") - 4) * F.lit(0.03))
        * F.greatest(F.lit(0.85), F.lit(1.0) - F.col("experience_yrs") * F.lit(0.008))
        * F.when(as_col(festival).cast("boolean"), F.lit(1.2)).otherwise(F.lit(1.0))
        * F.greatest(F.lit(0.8), F.col("num_dishes") / F.lit(5.0))
    )
    return rnd(F.greatest(F.lit(1.5), kg), 2)


def blend(rule_kg: Column | str, ml_kg: Column | str) -> Column:
    """70 % model, 30 % rule; the rule alone without a positive prediction."""
    rule, ml = as_col(rule_kg), as_col(ml_kg)
    return F.when(ml > 0, rnd(ml * F.lit(0.7) + rule * F.lit(0.3), 2)).otherwise(rule)


def cylinders_with_buffer(
    kg: Column | str, experience: Column | str, buffer: float = 0.10
) -> Column:
    """Cylinders for ``kg`` plus a safety share that shrinks with experience."""
    exp = as_col(experience)
    share = F.when(exp < 3, F.lit(0.20)).when(exp < 6, F.lit(0.15)).otherwise(F.lit(buffer))
    need = as_col(kg) * (F.lit(1.0) + share) / F.lit(fv.USABLE_KG_PER_CYLINDER)
    return F.greatest(F.lit(1), F.ceil(need).cast("int"))


def stockout_risk(
    kg: Column | str, cylinders: Column | str, experience: Column | str
) -> Column:
    """Uncovered share of the demand in %, raised for little experience, at most 99."""
    kg, exp = as_col(kg), as_col(experience)
    gap = (kg - as_col(cylinders) * F.lit(fv.USABLE_KG_PER_CYLINDER)) / F.greatest(kg, F.lit(1.0))
    penalty = F.when(exp < 3, F.lit(1.5)).when(exp < 6, F.lit(1.2)).otherwise(F.lit(1.0))
    return rnd(
        F.least(F.lit(99.0), F.greatest(F.lit(0.0), gap * F.lit(100.0)) * penalty), 1
    )


def latest_order_date(event_date: Column | str, lead: Column | str) -> Column:
    return F.date_sub(as_col(event_date), (as_col(lead) + 1).cast("int"))


def recommended_order_date(
    event_date: Column | str,
    lead: Column | str,
    risk: Column | str,
    experience: Column | str,
    festival: Column | str | None = None,
    festival_days: int = 0,
) -> Column:
    """Latest date less days for risk and inexperience (and festivals if set)."""
    r = as_col(risk)
    days = (
        as_col(lead)
        + 1
        + F.when(r > 50, 3).when(r > 25, 1).otherwise(0)
        + F.when(as_col(experience) < 3, 2).otherwise(0)
    )
    if festival is not None and festival_days:
        days = days + F.when(as_col(festival).cast("boolean"), festival_days).otherwise(0)
    return F.date_sub(as_col(event_date), days.cast("int"))


def planner_wastage_rate(event_type: Column | str, experience: Column | str) -> Column:
    rate = lookup(event_type, fv.PLANNER_WASTAGE_RATE, fv.DEFAULT_WASTAGE_RATE)
    return rate * F.when(as_col(experience) > 8, F.lit(0.7)).otherwise(F.lit(1.0))


def wastage_estimate(kg: Column | str, rate: Column) -> Column:
    return rnd(as_col(kg) * rate, 2)


def order_cost(cylinders: Column | str, price: int | Column = fv.CYLINDER_PRICE_INR) -> Column:
    p = price if isinstance(price, Column) else F.lit(price)
    return (as_col(cylinders) * p).cast("double")


def efficiency_score(kg: Column | str, wastage: Column | str, cylinders: Column | str) -> Column:
    """100 less 1.5 points per percent of fuel wasted or over-ordered, floor 0."""
    kg = as_col(kg)
    over = F.greatest(F.lit(0.0), as_col(cylinders) * F.lit(fv.USABLE_KG_PER_CYLINDER) - kg)
    lost = (as_col(wastage) + over) / F.greatest(kg, F.lit(1.0)) * F.lit(100.0)
    return rnd(F.greatest(F.lit(0.0), F.lit(100.0) - lost * F.lit(1.5)), 1)


def tier(risk: Column | str, efficiency: Column | str) -> Column:
    r, e = as_col(risk), as_col(efficiency)
    return (
        F.when((r > 50) | (e < 40), "RED").when((r > 25) | (e < 65), "AMBER").otherwise("GREEN")
    )


def action_items(
    risk: Column | str,
    cylinders: Column | str,
    experience: Column | str,
    rate: Column,
    event_type: Column | str,
    festival: Column | str,
    headcount: Column | str,
) -> Column:
    """Messages whose condition holds, in fixed order; a default if none does."""
    exp = as_col(experience)
    messages = F.array(
        F.when(
            as_col(risk) > 50, F.format_string(fv.ACTION_HIGH_RISK, as_col(cylinders) + 1)
        ),
        F.when(exp < 3, F.lit(fv.ACTION_NOVICE)),
        F.when(rate > 0.10, F.format_string(fv.ACTION_WASTAGE, as_col(event_type))),
        F.when(as_col(festival).cast("boolean"), F.lit(fv.ACTION_FESTIVAL)),
        F.when((as_col(headcount) > 500) & (exp < 5), F.lit(fv.ACTION_LARGE)),
    )
    kept = F.filter(messages, lambda m: m.isNotNull())
    return F.when(F.size(kept) == 0, F.array(F.lit(fv.ACTION_DEFAULT))).otherwise(kept)


def notes(rule_kg: Column | str, final_kg: Column | str, ml_kg: Column | str | None) -> Column:
    """How the quantity was found, numbers to one decimal."""
    rule, final = rnd(rule_kg, 1), rnd(final_kg, 1)
    plain = F.format_string(fv.NOTE_RULE, rule, final)
    if ml_kg is None:
        return plain
    ml = as_col(ml_kg)
    return F.when(
        ml.isNotNull() & (ml != 0), F.format_string(fv.NOTE_BLENDED, rule, rnd(ml, 1), final)
    ).otherwise(plain)


PLAN_COLUMNS = (
    "caterer_id", "event_date", "predicted_consumption_kg", "cylinders_to_order",
    "recommended_order_date", "latest_safe_order_date", "stockout_risk_pct",
    "wastage_estimate_kg", "estimated_cost_inr", "efficiency_score", "recommendation_tier",
    "action_items", "optimization_notes",
)


def plan_events(
    events: DataFrame,
    ml_kg: str | None = None,
    price: int | Column = fv.CYLINDER_PRICE_INR,
    keep: tuple[str, ...] = ("event_id",),
    festival_days: int = 0,
) -> DataFrame:
    """Complete plan per event: ``keep`` columns plus the thirteen plan columns.

    ``events`` holds the event and its caterer's profile (headcount,
    num_dishes, duration_hrs, menu_profile, event_type, event_date,
    is_festival_season, experience_yrs, num_burners, lead_days).
    """
    df = events.withColumn("_rule", rule_consumption())
    kg = blend("_rule", ml_kg) if ml_kg else F.col("_rule")
    df = df.withColumn("predicted_consumption_kg", kg)
    df = df.withColumns(
        {
            "cylinders_to_order": cylinders_with_buffer(
                "predicted_consumption_kg", "experience_yrs"
            ),
            "_rate": planner_wastage_rate("event_type", "experience_yrs"),
        }
    )
    df = df.withColumns(
        {
            "stockout_risk_pct": stockout_risk(
                "predicted_consumption_kg", "cylinders_to_order", "experience_yrs"
            ),
            "wastage_estimate_kg": wastage_estimate("predicted_consumption_kg", F.col("_rate")),
            "estimated_cost_inr": order_cost("cylinders_to_order", price),
        }
    )
    df = df.withColumns(
        {
            "recommended_order_date": recommended_order_date(
                "event_date", "lead_days", "stockout_risk_pct", "experience_yrs",
                "is_festival_season", festival_days,
            ),
            "latest_safe_order_date": latest_order_date("event_date", "lead_days"),
            "efficiency_score": efficiency_score(
                "predicted_consumption_kg", "wastage_estimate_kg", "cylinders_to_order"
            ),
            "action_items": action_items(
                "stockout_risk_pct", "cylinders_to_order", "experience_yrs", F.col("_rate"),
                "event_type", "is_festival_season", "headcount",
            ),
            "optimization_notes": notes("_rule", "predicted_consumption_kg", ml_kg),
        }
    )
    df = df.withColumn("recommendation_tier", tier("stockout_risk_pct", "efficiency_score"))
    names = [*keep, *[c for c in PLAN_COLUMNS if c not in keep]]
    return df.select(*names)


# ---- batches under a budget ----------------------------------------------


def batch_totals(
    events: DataFrame, batch: str, batches: DataFrame | None = None,
    kg: str = "consumption_kg", price: int = fv.CYLINDER_PRICE_INR,
) -> DataFrame:
    """Status, cylinders, cost and excess fuel of each batch.

    The cheapest order that avoids a stockout is the minimum count per event,
    so the linear program has a closed form: it is feasible exactly when the
    minimum fits the budget.  No budget (null or 0) is no limit.  Batches
    listed in ``batches`` (batch key, budget_inr) without events are reported.
    """
    need = F.greatest(F.lit(1), F.ceil(F.col(kg) / F.lit(fv.USABLE_KG_PER_CYLINDER)).cast("int"))
    excess = F.greatest(F.lit(0.0), need * F.lit(fv.USABLE_KG_PER_CYLINDER) - F.col(kg))
    sums = events.groupBy(batch).agg(
        F.count("*").alias("n_events"),
        F.sum(need).alias("_cyl"),
        fixed_sum(excess, 4).alias("_excess"),
    )
    if batches is None:
        out = sums.withColumn("budget_inr", F.lit(None).cast("double"))
    else:
        out = batches.select(batch, "budget_inr").join(sums, batch, "left")
    cost = F.col("_cyl") * F.lit(price)
    fits = (
        F.col("budget_inr").isNull() | (F.col("budget_inr") == 0) | (cost <= F.col("budget_inr"))
    )
    status = (
        F.when(F.col("n_events").isNull(), fv.BATCH_EMPTY)
        .when(fits, fv.BATCH_OPTIMAL)
        .otherwise(fv.BATCH_OVER_BUDGET)
    )
    ok = F.col("status") == fv.BATCH_OPTIMAL
    return out.withColumn("status", status).select(
        batch,
        "status",
        F.coalesce("n_events", F.lit(0)).alias("n_events"),
        "budget_inr",
        F.when(ok, F.col("_cyl")).alias("total_cylinders"),
        F.when(ok, cost).alias("total_cost_inr"),
        F.when(ok, rnd("_excess", 2)).alias("total_wastage_kg"),
    )


def batch_procurement(
    events: DataFrame, batch: str, batches: DataFrame | None = None,
    kg: str = "consumption_kg", price: int = fv.CYLINDER_PRICE_INR,
) -> DataFrame:
    """Allocation per event with its batch's status.

    Batch totals are pre-aggregated to one row per batch before they are joined
    back, and hot batches are salted, so a batch of any size stays spread over
    tasks.  Events whose batch is null or not listed in ``batches`` are kept
    with the status of an unlisted batch and the rule's allocation.
    """
    totals = batch_totals(events, batch, batches, kg, price)
    need = F.ceil(F.col(kg) / F.lit(fv.USABLE_KG_PER_CYLINDER)).cast("int")
    ok = F.col("status") == fv.BATCH_OPTIMAL
    minimum = F.greatest(F.lit(1), need)
    joined = dimension_join(events, totals.select(batch, "status"), [batch], "left").withColumn(
        "status", F.coalesce("status", F.lit(fv.BATCH_UNLISTED))
    )
    return joined.select(
        "event_id",
        batch,
        "event_date",
        F.col(kg).alias("consumption_kg"),
        "status",
        F.when(ok, minimum).alias("cylinders_lp"),
        minimum.alias("cylinders_rule"),
        F.when(ok, F.lit(0.0)).alias("lp_saving_pct"),
    )


def batch_summary(plans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals per batch of plans, or over all; an empty set without keys gives 0 events and nulls."""
    return plans.groupBy(*keys).agg(
        F.count("*").alias("total_events"),
        F.sum("cylinders_to_order").alias("total_cylinders"),
        fixed_sum("estimated_cost_inr", 0).alias("total_cost_inr"),
        rnd(F.try_divide(fixed_sum("stockout_risk_pct", 1), F.count("*")), 1).alias(
            "avg_stockout_risk"
        ),
        F.coalesce(F.count_if(F.col("recommendation_tier") == "RED"), F.lit(0)).alias(
            "high_risk_events"
        ),
    )
