"""Adapters from the star-schema tables to the planner's inputs.

``events_view`` and the other row-wise views are lazy.  ``event_table``,
``plan_table`` and the modelling tables are staged once per session and folder
because many queries read them and their derivation chains are long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import fixed_values as fv
from emberline.functions.expr import by_month, flag, hash_uniform, lookup, rnd, uniform_between
from emberline.operators import derive, features, joins, planning, prices, recipes, wastage
from emberline.session import keep_methods_small
from emberline.sources.staging import stage

AS_OF = "2024-11-01"
CAPACITY = 200
REGION_LEAD_DAYS = {"AFRICA": 1, "AMERICA": 2, "ASIA": 2, "EUROPE": 2}

_cache: dict[tuple, object] = {}


def fingerprint(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files in a folder and of its sub-folders' entries."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/*")
    found = folder.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(folder) or []
    return tuple((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found)


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """One build per application, state of the folder's files, and name."""
    keep_methods_small(spark)
    key = (spark.sparkContext.applicationId, sf_dir, fingerprint(spark, sf_dir), name)
    if key not in _cache:
        _cache[key] = build()
    return _cache[key]


def staged(spark, sf_dir, name, build: Callable[[], DataFrame]) -> DataFrame:
    return once(spark, sf_dir, name, lambda: stage(build(), name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of a source table; its schema is read from the footer once."""
    path = f"{sf_dir}/{name}.parquet"
    schema = once(spark, sf_dir, f"schema of {name}", lambda: spark.read.parquet(path).schema)
    return spark.read.schema(schema).parquet(path)


# ---- events --------------------------------------------------------------


def caterer_profiles(spark, sf_dir) -> DataFrame:
    """One profile per customer; dealer = nation, region = region."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    located = n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("dealer"), F.col("r_name").alias("region")
    )
    return c.join(located, c.c_nationkey == located.n_nationkey).select(
        F.col("c_custkey").alias("caterer_id"),
        (F.lit(1) + F.col("c_custkey") % 25).cast("int").alias("experience_yrs"),
        (F.lit(2) + F.col("c_custkey") % 18).cast("int").alias("num_burners"),
        F.when(F.col("c_acctbal") < 3000, "small")
        .when(F.col("c_acctbal") < 8000, "medium")
        .otherwise("large")
        .alias("business_size"),
        "dealer",
        "region",
    )


def order_lines(spark, sf_dir) -> DataFrame:
    """Line count and wastage sums of each order: the one pass over the lines, kept for the session."""
    l = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), (F.col("l_quantity") - 1).alias("quantity"),
        (F.col("l_quantity") * F.col("l_discount")).alias("wasted"),
    )
    return staged(
        spark, sf_dir, "order-lines", lambda: wastage.rates_by_order(l, "event_id", F.col("wasted"), F.col("quantity"))
    )


def observed_rates(spark, sf_dir) -> DataFrame:
    """Mean wastage rate by event type; the type comes with the order, so lines are not joined."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"), raw_kind("o_orderpriority").alias("raw")
    )
    kind = wastage.remap_category("raw", fv.EVENT_TYPE_OF_RAW, fv.DEFAULT_EVENT_TYPE)
    return wastage.mean_rate_of_orders(order_lines(spark, sf_dir).join(o, "event_id").withColumn("event_type", kind))


def raw_kind(priority: str):
    """The kind of event an order's priority stands for."""
    kinds = {
        "1-URGENT": "Wedding", "2-HIGH": "Corporate", "3-MEDIUM": "Birthday",
        "4-NOT SPECIFIED": "Social Gathering",
    }
    return lookup(priority, kinds)


def event_requests(spark, sf_dir) -> DataFrame:
    """One event per order; dishes = order lines + 1."""
    o = table(spark, sf_dir, "orders")
    lines = order_lines(spark, sf_dir).select("event_id", "n_lines")
    base = o.select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_custkey").alias("caterer_id"),
        F.col("o_orderdate").cast("date").alias("event_date"),
        F.get(F.array(*map(F.lit, fv.EVENT_TYPES)), (F.col("o_orderkey") % 8).cast("int")).alias(
            "event_type"
        ),
        F.get(
            F.array(*map(F.lit, fv.MENU_PROFILES)),
            ((F.col("o_orderkey") + F.col("o_custkey")) % 7).cast("int"),
        ).alias("menu_profile"),
        (F.lit(10) + F.floor(F.col("o_totalprice") / 200)).cast("int").alias("headcount"),
        (F.lit(2) + (F.col("o_orderkey") % 81) / F.lit(10.0)).alias("duration_hrs"),
    )
    joined = base.join(lines, "event_id", "left")
    return joined.select(
        *base.columns,
        F.greatest(F.lit(2), F.coalesce("n_lines", F.lit(0)) + 1).cast("int").alias("num_dishes"),
    )


def hot_caterers(spark, sf_dir) -> list:
    """Counted on the order table alone: one column is read."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("caterer_id"))
    return once(spark, sf_dir, "hot-caterers", lambda: joins.hot_keys(keys, "caterer_id"))


def events_view(spark, sf_dir) -> DataFrame:
    """Events with their caterer's profile, the input of the planner."""
    ev = planning.profile_join(
        event_requests(spark, sf_dir), caterer_profiles(spark, sf_dir),
        hot=hot_caterers(spark, sf_dir),
    )
    month = F.month("event_date")
    return ev.withColumns(
        {
            "year": F.year("event_date") + 22,
            "month": month,
            "day": F.day("event_date"),
            "festival_flag": by_month(month, [r[2] for r in fv.CALENDAR]),
            "is_festival_season": by_month(month, [r[2] for r in fv.CALENDAR]) == 1,
            "lead_days": planning.lead_days("region", REGION_LEAD_DAYS),
        }
    )


# ---- recipes, wastage, prices ---------------------------------------------


def recipes_view(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    course = ("Main Course", "Snack", "Dessert", "Breakfast", "Lunch", "Appetizer")
    diet = (
        F.when(F.col("lang") == "en", "Vegetarian")
        .when(F.col("lang") == "de", "Non Vegeterian")
        .when(F.col("lang") == "fr", "High Protein Non Vegetarian")
        .otherwise("Eggetarian")
    )
    return d.select(
        F.col("doc_id").alias("recipe_id"),
        F.col("text").alias("ingredients"),
        F.get(F.array(*map(F.lit, course)), (F.col("doc_id") % 7).cast("int")).alias("course"),
        diet.alias("diet"),
        (F.col("n_chars") % 331).cast("int").alias("cook_time_mins"),
        (F.col("doc_id") % 104).cast("int").alias("servings"),
    )


def wastage_view(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate"
    )
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"
    )
    hot = once(spark, sf_dir, "hot-orders", lambda: joins.hot_keys(l, "l_orderkey"))
    prep = F.col("l_linenumber") % 4
    month = F.month("l_shipdate")
    return joins.skew_safe_join(l, o, "l_orderkey", hot).select(
        "l_orderkey",
        "l_linenumber",
        raw_kind("o_orderpriority").alias("event_type_raw"),
        (F.col("l_quantity") - 1).alias("quantity_of_food"),
        (F.col("l_quantity") * F.col("l_discount")).alias("wastage_amount"),
        F.when(prep == 0, "Buffet").when(prep == 1, "Sit-down Dinner").when(prep == 2, "Finger Food")
        .alias("preparation"),
        F.when(month.isin(11, 12, 1, 2), "Winter").when(month.isin(4, 5, 6), "Summer")
        .when(month == 9, "All Seasons").alias("seasonality"),
    )


def price_anchor_view(spark, sf_dir) -> DataFrame:
    """Half-yearly anchors per nation: the mean price of all its orders of the half-year."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # sums per customer first: the join sees one row per (customer, half-year)
    start = F.make_date(F.year("o_orderdate"), F.when(F.month("o_orderdate") < 7, 1).otherwise(7), F.lit(1))
    per_customer = o.groupBy("o_custkey", start.alias("half")).agg(
        F.sum(F.floor(F.col("o_totalprice") * 100 + F.lit(0.5))).alias("cents"),
        F.count("*").alias("n"),
    )
    yearly = (
        per_customer.join(c, per_customer.o_custkey == c.c_custkey)
        .groupBy("c_nationkey", "half")
        .agg(rnd(F.sum("cents") / F.lit(100.0) / F.sum("n"), 2).alias("commercial_price_inr"))
    )
    return yearly.join(n, yearly.c_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("series"),
        F.col("half").alias("date"),
        "commercial_price_inr",
    )


NATION_GRID = ("1995-01-01", "2001-12-01")


def nation_series(spark, sf_dir) -> DataFrame:
    return prices.monthly_series(price_anchor_view(spark, sf_dir), ("series",), *NATION_GRID)


def menu_table(spark, sf_dir) -> DataFrame:
    """Observed gas rate and cook time of each of the seven menus."""
    return staged(
        spark, sf_dir, "menus", lambda: recipes.menu_rates(recipes.process_recipes(recipes_view(spark, sf_dir)))
    )


def events_with_menu(spark, sf_dir) -> DataFrame:
    menus = menu_table(spark, sf_dir)
    return recipes.menu_lookup(events_view(spark, sf_dir), rates=menus, cook_times=menus)


# ---- derived tables --------------------------------------------------------


def build_event_table(spark, sf_dir) -> DataFrame:
    """The event table: consumption, orders, labels, prices, weather, wastage."""
    ev = derive.weather_lookup(derive.derive_events(events_with_menu(spark, sf_dir)))
    ev = prices.price_lookup(ev, prices.reference_series(spark))
    ev = wastage.rate_lookup(ev, observed_rates(spark, sf_dir))
    noise = uniform_between(0.8, 1.2, hash_uniform("42w", "event_id"))
    ev = ev.withColumn(
        "wastage_kg", derive.wastage_kg("consumption_kg", "wastage_rate", "experience_yrs", noise)
    )
    return ev.withColumn("wastage_rate", rnd("wastage_rate", 4)).drop("typical_dishes")


def event_table(spark, sf_dir) -> DataFrame:
    return staged(spark, sf_dir, "events", lambda: build_event_table(spark, sf_dir))


def feature_table(spark, sf_dir) -> DataFrame:
    return staged(
        spark, sf_dir, "features", lambda: features.add_features(features.clean_events(event_table(spark, sf_dir)))
    )


def model_inputs(df: DataFrame) -> DataFrame:
    """Columns of the modelling table, without planner-only columns."""
    drop = ("caterer_id", "lead_days", "shock_factor", "is_festival_season", "event_date",
            "region", "dealer")
    return df.drop(*drop)


def encoded(spark, sf_dir) -> DataFrame:
    """The feature table with its categories encoded: every feature of the models, unscaled and with gaps."""
    rows = model_inputs(feature_table(spark, sf_dir))
    return staged(spark, sf_dir, "encoded", lambda: features.encode(rows, features.fit_label_classes(rows)))


def normalised(spark, sf_dir) -> tuple[DataFrame, dict]:
    def build():
        df, params = features.normalise(model_inputs(feature_table(spark, sf_dir)))
        return stage(df, "normalised"), params

    return once(spark, sf_dir, "normalised", build)


def build_plan_table(spark, sf_dir) -> DataFrame:
    """Plans whose risk comes from the ordered count, on dates folded into 45 days."""
    e = event_table(spark, sf_dir)
    day = F.date_add(
        F.lit("2024-11-04").cast("date"),
        ((F.col("event_id") * 7 + F.col("caterer_id")) % 45).cast("int"),
    )
    p = e.select(
        "event_id", "caterer_id", "region", "dealer", "event_type", "headcount", "experience_yrs",
        "is_festival_season",
        (F.lit(1) + F.col("caterer_id") % 3).cast("int").alias("lead_days"),
        day.alias("event_date"),
        F.col("consumption_kg").alias("predicted_consumption_kg"),
        F.col("cylinders_ordered").alias("cylinders_to_order"),
    )
    p = p.withColumn(
        "stockout_risk_pct",
        planning.stockout_risk("predicted_consumption_kg", "cylinders_to_order", "experience_yrs"),
    )
    rate = planning.planner_wastage_rate("event_type", "experience_yrs")
    p = p.withColumns(
        {
            "recommended_order_date": planning.recommended_order_date(
                "event_date", "lead_days", "stockout_risk_pct", "experience_yrs"
            ),
            "latest_safe_order_date": planning.latest_order_date("event_date", "lead_days"),
            "wastage_estimate_kg": planning.wastage_estimate("predicted_consumption_kg", rate),
            "estimated_cost_inr": planning.order_cost("cylinders_to_order"),
        }
    )
    p = p.withColumn(
        "efficiency_score",
        planning.efficiency_score(
            "predicted_consumption_kg", "wastage_estimate_kg", "cylinders_to_order"
        ),
    )
    return p.withColumn(
        "recommendation_tier", planning.tier("stockout_risk_pct", "efficiency_score")
    )


def plan_table(spark, sf_dir) -> DataFrame:
    return staged(spark, sf_dir, "plans", lambda: build_plan_table(spark, sf_dir))


def prediction_view(spark, sf_dir) -> DataFrame:
    """Labels with made-to-measure scores (tied), and a rule-based regression."""
    e = event_table(spark, sf_dir)
    score = rnd(
        F.lit(0.5) * hash_uniform("42p", "event_id")
        + F.lit(0.4) * F.col("ran_out_of_gas") * hash_uniform("42q", "event_id"),
        2,
    )
    return e.select(
        "event_id",
        F.col("ran_out_of_gas").alias("label"),
        score.alias("score"),
        flag(score >= 0.5).alias("prediction"),
        F.col("consumption_kg").alias("actual"),
        planning.rule_consumption("is_festival_season").alias("predicted"),
    )
