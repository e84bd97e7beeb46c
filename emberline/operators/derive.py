"""Event derivation: season, weather, consumption, orders, lead days, labels.

Row-wise column expressions only: one map stage, no shuffle.  Random effects
come from :func:`hash_uniform`, one salt per draw, so a task that runs again
yields the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import fixed_values as fv
from emberline.functions.expr import (
    as_col, by_month, clamp, flag, hash_uniform, lookup, rnd, trunc_int, uniform_between,
)


def season_columns(month: Column | str = "month") -> dict[str, Column]:
    return {
        "wedding_season": by_month(month, [r[1] for r in fv.CALENDAR]),
        "festival_flag": by_month(month, [r[2] for r in fv.CALENDAR]),
        "festival_name": by_month(month, [r[3] for r in fv.CALENDAR]),
        "demand_multiplier": by_month(month, [r[4] for r in fv.CALENDAR]),
    }


def season_lookup(df: DataFrame, month: str = "month") -> DataFrame:
    """Wedding and festival flags, festival name and demand multiplier."""
    return df.withColumns(season_columns(month))


def weather_lookup(df: DataFrame, month: str = "month") -> DataFrame:
    """Monthly normals of temperature and rain."""
    return df.withColumns(
        {
            "temp_mean_c": by_month(month, [r[5] for r in fv.CALENDAR]),
            "precipitation_mm": by_month(month, [r[6] for r in fv.CALENDAR]),
        }
    )


def is_monsoon(month: Column | str = "month") -> Column:
    return flag(as_col(month).isin(*fv.MONSOON_MONTHS))


def _month_number(year: Column, month: Column) -> Column:
    return year * 12 + month


def shock_factor(
    year: Column | str = "year",
    month: Column | str = "month",
    shocks: Sequence[tuple] = fv.DEMAND_SHOCKS,
) -> Column:
    """Demand factor of the shock calendar, 1 outside it."""
    at = _month_number(as_col(year), as_col(month))
    out = F
    for y0, m0, y1, m1, factor in shocks:
        out = out.when(at.between(y0 * 12 + m0, y1 * 12 + m1), F.lit(factor))
    return out.otherwise(F.lit(1.0)) if shocks else F.lit(1.0)


def shock_flag(
    year: Column | str = "year",
    month: Column | str = "month",
    shocks: Sequence[tuple] = fv.DEMAND_SHOCKS,
) -> Column:
    at = _month_number(as_col(year), as_col(month))
    cond = F.lit(False)
    for y0, m0, y1, m1, _ in shocks:
        cond = cond | at.between(y0 * 12 + m0, y1 * 12 + m1)
    return flag(cond)


def consumption_kg(
    gas: Column | str,
    multiplier: Column | str,
    shock: Column | str,
    noise: Column,
) -> Column:
    """Fuel used by an event in kg (2 decimals, within 1.5-500)."""
    longer = clamp((F.col("duration_hrs") - F.lit(4.0)) * F.lit(0.05), -0.15, 0.40)
    kg = (
        F.col("headcount")
        * F.col("num_dishes")
        * as_col(gas)
        * (F.lit(1.0) + longer)
        * (F.lit(1.0) + (F.col("num_burners") - 4) * F.lit(0.02))
        * as_col(multiplier)
        * as_col(shock)
        * noise
    )
    return rnd(clamp(kg, *fv.CONSUMPTION_LIMITS), 2)


def cylinders_for(kg: Column | str) -> Column:
    """Cylinders that hold ``kg``."""
    return F.ceil(as_col(kg) / F.lit(fv.USABLE_KG_PER_CYLINDER)).cast("int")


def wastage_kg(
    kg: Column | str, rate: Column | str, experience: Column | str, noise: Column
) -> Column:
    """Fuel wasted: falls 2 % per year of experience, down to 60 %."""
    skill = F.greatest(F.lit(0.6), F.lit(1.0) - as_col(experience) * F.lit(0.02))
    return rnd(as_col(kg) * as_col(rate) * skill * noise, 3)


def accuracy_tier(experience: Column | str) -> Column:
    exp = as_col(experience)
    return F.when(exp > 10, 3).when(exp > 5, 2).when(exp > 2, 1).otherwise(0)


def _ranged_draw(tier: Column, ranges: Sequence[tuple[float, float]], u: Column) -> Column:
    """Low end plus width of the tier's range times ``u`` (which appears once)."""
    low = F.get(F.array(*[F.lit(float(lo)) for lo, _ in ranges]), tier)
    width = F.get(F.array(*[F.lit(round(float(hi - lo), 10)) for lo, hi in ranges]), tier)
    return low + width * u


def cylinders_ordered(
    needed: Column | str,
    experience: Column | str,
    u: Column,
    ranges: Sequence[tuple[float, float]] = fv.TRAINING_LABEL_ACCURACY,
) -> Column:
    """Cylinders a caterer of this experience orders (at least 1)."""
    draw = _ranged_draw(accuracy_tier(experience), ranges, u)
    return F.greatest(F.lit(1), trunc_int(as_col(needed) * draw))


def stockout_first_label(
    ordered: Column, needed: Column, season: Column, headcount: Column, experience: Column,
    u_shock: Column, u_surge: Column,
) -> Column:
    """First label: short order, or season shock, or large event run by a novice."""
    short = ordered < needed
    shock = (season == 1) & (u_shock < F.lit(0.08))
    surge = (headcount > 500) & (experience <= 3) & (u_surge < F.lit(0.15))
    return flag(short | shock | surge)


def stockout_training_label(
    ordered: Column, needed: Column, season: Column, lead: Column, headcount: Column,
    experience: Column, u_shock: Column, u_surge: Column,
) -> Column:
    """Training label: the shock needs a late order, the surge a very large event."""
    short = ordered < needed
    shock = (season == 1) & (lead <= 1) & (u_shock < F.lit(0.12))
    surge = (headcount > 1000) & (experience <= 2) & (u_surge < F.lit(0.10))
    return flag(short | shock | surge)


def order_lead_days(experience: Column | str, u: Column) -> Column:
    """Days between order and event: wider and later with experience."""
    exp = as_col(experience)
    tier = F.when(exp < 5, 0).when(exp < 10, 1).when(exp < 15, 2).otherwise(3)
    return trunc_int(_ranged_draw(tier, fv.LEAD_DAY_RANGES, u))


def derive_events(
    events: DataFrame,
    seed: str = "42",
    accuracy: Sequence[tuple[float, float]] = fv.TRAINING_LABEL_ACCURACY,
) -> DataFrame:
    """Season, consumption, orders, lead days and the training label.

    ``events`` needs event_id, year, month, headcount, num_dishes,
    duration_hrs, num_burners, experience_yrs and menu_profile; a column
    ``gas_intensity_per_serving`` is used when present.
    """

    def u(tag):
        return hash_uniform(f"{seed}{tag}", "event_id")

    df = season_lookup(events)
    if "gas_intensity_per_serving" not in df.columns:
        df = df.withColumn(
            "gas_intensity_per_serving",
            F.coalesce(
                lookup("menu_profile", fv.GAS_PER_SERVING), F.lit(fv.DEFAULT_GAS_PER_SERVING)
            ),
        )
    df = df.withColumns(
        {"shock_factor": shock_factor(), "covid_period": shock_flag(), "is_monsoon": is_monsoon()}
    )
    df = df.withColumn(
        "consumption_kg",
        consumption_kg(
            "gas_intensity_per_serving",
            "demand_multiplier",
            "shock_factor",
            uniform_between(0.88, 1.14, u("n")),
        ),
    )
    df = df.withColumn("cylinders_needed", cylinders_for("consumption_kg"))
    df = df.withColumns(
        {
            "cylinders_ordered": cylinders_ordered(
                "cylinders_needed", "experience_yrs", u("a"), accuracy
            ),
            "order_lead_days": order_lead_days("experience_yrs", u("l")),
        }
    )
    return df.withColumn(
        "ran_out_of_gas",
        stockout_training_label(
            F.col("cylinders_ordered"), F.col("cylinders_needed"), F.col("wedding_season"),
            F.col("order_lead_days"), F.col("headcount"), F.col("experience_yrs"),
            u("s"), u("g"),
        ),
    )
