"""Recipe text: filters, gas rate, menu profile, profile statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import fixed_values as fv
from emberline.functions.expr import as_col, contains_any, fixed_avg, lookup, rnd


def _text(c: Column | str) -> Column:
    """Lower-case text; a null becomes the word ``nan`` (it matches no list)."""
    return F.lower(F.coalesce(as_col(c), F.lit("nan")))


def filter_recipes(df: DataFrame) -> DataFrame:
    """Recipes with ingredients, cook time in (0, 300] and 1-100 servings."""
    return df.filter(
        F.col("ingredients").isNotNull()
        & (F.col("cook_time_mins") > 0)
        & (F.col("cook_time_mins") <= 300)
        & F.col("servings").between(1, 100)
    )


def gas_rate(
    ingredients: Column | str,
    course: Column | str,
    high: Sequence[str] = fv.HIGH_HEAT_WORDS,
    low: Sequence[str] = fv.LOW_HEAT_WORDS,
    medium: Sequence[str] = fv.MEDIUM_HEAT_WORDS,
) -> Column:
    """kg of gas per hour from the first matching word tier, else the course.

    Tiers are tried in the order high, low, medium; words match anywhere in
    the whole text, also inside longer words.
    """
    ing, crs = _text(ingredients), _text(course)
    rate = (
        F.when(contains_any(ing, high), F.lit(fv.HIGH_HEAT_RATE))
        .when(contains_any(ing, low), F.lit(fv.LOW_HEAT_RATE))
        .when(contains_any(ing, medium), F.lit(fv.MEDIUM_HEAT_RATE))
    )
    for marks, value in fv.COURSE_RATES:
        rate = rate.when(contains_any(crs, marks), F.lit(value))
    return rate.otherwise(F.lit(fv.DEFAULT_HEAT_RATE))


def gas_per_serving(minutes: Column | str, rate: Column | str, servings: Column | str) -> Column:
    return rnd(as_col(minutes) / F.lit(60.0) * as_col(rate) / as_col(servings), 5)


def menu_profile(
    course: Column | str,
    diet: Column | str,
    ingredients: Column | str,
    nonveg_elaborate: Sequence[str] = fv.NONVEG_ELABORATE_WORDS,
    veg_elaborate: Sequence[str] = fv.VEG_ELABORATE_WORDS,
) -> Column:
    """Menu profile of a recipe; the first rule that holds decides."""
    crs, dt, ing = _text(course), _text(diet), _text(ingredients)
    main = contains_any(crs, fv.MAIN_COURSE_MARKS)
    nonveg = contains_any(dt, fv.NONVEG_DIET_MARKS)
    return (
        F.when(contains_any(ing, ["biryani"]) | contains_any(crs, ["biryani"]), "biryani_special")
        .when(contains_any(crs, fv.SNACK_COURSE_MARKS), "snacks_only")
        .when(main & nonveg & contains_any(ing, nonveg_elaborate), "nonveg_elaborate")
        .when(main & nonveg, "nonveg_simple")
        .when(main & contains_any(ing, veg_elaborate), "veg_elaborate")
        .when(main, "veg_simple")
        .otherwise("mixed_standard")
    )


def process_recipes(df: DataFrame) -> DataFrame:
    """Filtered recipes with gas rate, gas per serving and menu profile."""
    return (
        filter_recipes(df)
        .withColumn("gas_rate_kg_per_hr", gas_rate("ingredients", "course"))
        .withColumn(
            "gas_per_serving_kg",
            gas_per_serving("cook_time_mins", "gas_rate_kg_per_hr", "servings"),
        )
        .withColumn("menu_profile", menu_profile("course", "diet", "ingredients"))
    )


def gas_by_profile(processed: DataFrame) -> DataFrame:
    """Mean, sample deviation and count of gas per serving, 5 decimals."""
    return processed.groupBy("menu_profile").agg(
        rnd(fixed_avg("gas_per_serving_kg", 5), 5).alias("gas_intensity_mean"),
        rnd(F.stddev_samp("gas_per_serving_kg"), 5).alias("gas_intensity_std"),
        F.count("*").alias("recipe_count"),
    )


def cook_time_by_profile(processed: DataFrame) -> DataFrame:
    return processed.groupBy("menu_profile").agg(
        rnd(F.sum("cook_time_mins") / F.count("cook_time_mins"), 1).alias("avg_cook_time_mins")
    )


def commercial_rates(by_profile: DataFrame) -> DataFrame:
    """Commercial gas rate for each of the seven profiles.

    The observed mean is divided by the batch efficiency; profiles without
    recipes take their fixed rate.
    """
    spark = by_profile.sparkSession
    vocabulary = spark.createDataFrame(
        list(fv.GAS_PER_SERVING.items()), "menu_profile string, fixed_rate double"
    )
    observed = by_profile.select(
        "menu_profile",
        rnd(F.col("gas_intensity_mean") / F.lit(fv.COMMERCIAL_EFFICIENCY), 5).alias("_observed"),
    )
    return vocabulary.join(observed, "menu_profile", "left").select(
        "menu_profile",
        F.coalesce("_observed", "fixed_rate").alias("gas_intensity_per_serving"),
    )


def menu_rates(processed: DataFrame) -> DataFrame:
    """Commercial gas rate and mean cook time of each of the seven profiles, from one pass over the recipes.

    As :func:`commercial_rates` and :func:`cook_time_by_profile`; profiles
    without recipes take their fixed rate and the default time.
    """
    seen = processed.groupBy("menu_profile").agg(
        rnd(rnd(fixed_avg("gas_per_serving_kg", 5), 5) / F.lit(fv.COMMERCIAL_EFFICIENCY), 5).alias("_gas"),
        rnd(F.sum("cook_time_mins") / F.count("cook_time_mins"), 1).alias("_cook"),
    )
    vocabulary = processed.sparkSession.createDataFrame(
        list(fv.GAS_PER_SERVING.items()), "menu_profile string, fixed_rate double"
    )
    return vocabulary.join(seen, "menu_profile", "left").select(
        "menu_profile",
        F.coalesce("_gas", "fixed_rate").alias("gas_intensity_per_serving"),
        F.coalesce("_cook", F.lit(fv.DEFAULT_COOK_MINUTES)).alias("avg_cook_time_mins"),
    )


def menu_lookup(
    events: DataFrame, rates: DataFrame | None = None, cook_times: DataFrame | None = None
) -> DataFrame:
    """Adds gas intensity, typical dishes and cook time of the event's menu.

    ``rates`` and ``cook_times`` have one row per profile; they are cut to the
    vocabulary of seven, which bounds what is broadcast.  Without them the
    fixed values are used.
    """
    fixed_gas = F.coalesce(
        lookup("menu_profile", fv.GAS_PER_SERVING), F.lit(fv.DEFAULT_GAS_PER_SERVING)
    )
    out = events
    gas = fixed_gas
    known = F.col("menu_profile").isin(*fv.MENU_PROFILES)
    gas_col, cook_col = F.col("gas_intensity_per_serving").alias("_gas"), F.col("avg_cook_time_mins").alias("_cook")
    if rates is not None and rates is cook_times:
        sides = [rates.filter(known).select("menu_profile", gas_col, cook_col)]
    else:
        sides = [t.filter(known).select("menu_profile", c) for t, c in ((rates, gas_col), (cook_times, cook_col)) if t is not None]
    for side in sides:
        out = out.join(F.broadcast(side), "menu_profile", "left")
    if rates is not None:
        gas = F.coalesce(F.col("_gas"), F.lit(fv.DEFAULT_GAS_PER_SERVING))
    cook = F.lit(fv.DEFAULT_COOK_MINUTES)
    if cook_times is not None:
        cook = F.coalesce(F.col("_cook"), F.lit(fv.DEFAULT_COOK_MINUTES))
    return out.withColumns(
        {
            "gas_intensity_per_serving": rnd(gas, 5),
            "typical_dishes": F.coalesce(
                lookup("menu_profile", fv.DISHES_PER_MENU), F.lit(fv.DEFAULT_DISHES)
            ),
            "avg_cook_time_mins": rnd(cook, 1),
        }
    ).drop("_gas", "_cook")
