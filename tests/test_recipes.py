import pytest
from pyspark.sql import functions as F

from emberline.operators import recipes, wastage

SCHEMA = "k string, ingredients string, course string, diet string, cook_time_mins int, servings int"


@pytest.mark.parametrize(
    "ingredients,course,rate",
    [
        ("Sunflower Oil, rice", "Lunch", 0.35),
        ("poori with steam", "Lunch", 0.35),
        ("boil in oil", "Lunch", 0.18),
        ("GHEE", "Lunch", 0.28),
        ("rice", "Snack", 0.30),
        ("rice", "South Indian Appetizer", 0.30),
        ("rice", "Dessert", 0.22),
        ("rice", "World Breakfast", 0.20),
        ("rice", "Lunch", 0.26),
        (None, None, 0.26),
        ("x" * 20_000 + " poori", "Lunch", 0.35),
    ],
)
def test_gas_rate(spark, ingredients, course, rate):
    df = spark.createDataFrame([(ingredients, course)], "i string, c string")
    assert df.select(recipes.gas_rate("i", "c")).first()[0] == rate


@pytest.mark.parametrize(
    "course,diet,ingredients,profile",
    [
        ("Dessert", "Vegetarian", "Biryani masala", "biryani_special"),
        ("Biryani", "Vegetarian", "rice", "biryani_special"),
        ("Snack", "Non Vegeterian", "butter", "snacks_only"),
        ("Main Course", "Non Vegeterian", "tikka", "nonveg_elaborate"),
        ("Dinner", "High Protein Non Vegetarian", "egg", "nonveg_simple"),
        ("Lunch", "Vegetarian", "cashew", "veg_elaborate"),
        ("Lunch", "Vegetarian", "tikka", "veg_simple"),
        ("Side Dish", "Vegetarian", "butter", "mixed_standard"),
        (None, None, None, "mixed_standard"),
    ],
)
def test_menu_profile(spark, course, diet, ingredients, profile):
    df = spark.createDataFrame([(course, diet, ingredients)], "c string, d string, i string")
    assert df.select(recipes.menu_profile("c", "d", "i")).first()[0] == profile


def test_filter_bounds(spark):
    rows = [
        (f"{t}/{s}", "rice", "Lunch", "Vegetarian", t, s)
        for t in (0, 1, 300, 301, None) for s in (0, 1, 100, 101, None)
    ] + [("no text", None, "Lunch", "Vegetarian", 10, 10)]
    kept = {r["k"] for r in recipes.filter_recipes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {"1/1", "1/100", "300/1", "300/100"}


def test_rates_fall_back_per_profile(spark):
    rows = [("a", "rice", "Lunch", "Vegetarian", 60, 1), ("b", "boil", "Lunch", "Vegetarian", 60, 1)]
    done = recipes.process_recipes(spark.createDataFrame(rows, SCHEMA))
    stats = recipes.gas_by_profile(done).collect()
    assert [(r["menu_profile"], r["gas_intensity_mean"], r["recipe_count"]) for r in stats] == [("veg_simple", 0.22, 2)]
    assert stats[0]["gas_intensity_std"] == pytest.approx(0.05657)
    rates = {r[0]: r[1] for r in recipes.commercial_rates(recipes.gas_by_profile(done)).collect()}
    assert len(rates) == 7
    assert rates["veg_simple"] == pytest.approx(0.06286)
    assert rates["biryani_special"] == 0.0124


def test_wastage_rate_and_maps(spark):
    df = spark.createDataFrame(
        [("Wedding", "Buffet", "Winter", 0.0, 0.5), ("Picnic", None, "Spring", 30.0, 1.0)],
        "event_type_raw string, preparation string, seasonality string, quantity_of_food double, wastage_amount double",
    )
    got = [tuple(r) for r in wastage.process_wastage(df).select("event_type", "cooking_intensity", "season", "wastage_rate").collect()]
    assert got == [("wedding", "high", "winter", 0.5), ("festival_event", "medium", "all", 0.0333)]
    ev = spark.createDataFrame([("wedding",), ("dhaba_daily",), ("other",)], "event_type string")
    observed = wastage.mean_rate_by_type(wastage.process_wastage(df))
    rates = {r["event_type"]: r["wastage_rate"] for r in wastage.rate_lookup(ev, observed).collect()}
    assert rates == {"wedding": 0.5, "dhaba_daily": 0.05, "other": 0.09}


def test_menu_lookup_defaults(spark):
    ev = spark.createDataFrame([("veg_elaborate",), ("unknown",)], "menu_profile string")
    got = {r["menu_profile"]: (r["gas_intensity_per_serving"], r["typical_dishes"], r["avg_cook_time_mins"])
           for r in recipes.menu_lookup(ev).collect()}
    assert got == {"veg_elaborate": (0.0128, 7, 30.0), "unknown": (0.012, 5, 30.0)}


def test_menu_lookup_joins_one_table_once(spark):
    menus = spark.createDataFrame(
        [("veg_simple", 0.02, 40.0), ("snacks_only", None, 12.5), ("unknown", 9.0, 9.0)],
        "menu_profile string, gas_intensity_per_serving double, avg_cook_time_mins double",
    )
    ev = spark.createDataFrame([(1, "veg_simple"), (2, "snacks_only"), (3, "unknown"), (4, None)], "id int, menu_profile string")
    once = recipes.menu_lookup(ev, rates=menus, cook_times=menus)
    twice = recipes.menu_lookup(ev, rates=menus, cook_times=menus.select("*"))
    assert sorted(once.collect(), key=str) == sorted(twice.collect(), key=str)
    plans = [df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") for df in (once, twice)]
    assert plans == [1, 2]


def test_draws_are_read_as_whole_numbers(spark):
    """The draw of the first 32 bits of an md5, which no step reads from text as a double."""
    from hashlib import md5

    from emberline.functions.expr import hash_uniform

    df = spark.range(200).select("id", hash_uniform("42n", "id").alias("u"))
    assert all(r.u == int(md5(f"42n:{r.id}".encode()).hexdigest()[:8], 16) / 2**32 for r in df.collect())
    assert "as bigint) as double)" in df._jdf.queryExecution().optimizedPlan().toString()
