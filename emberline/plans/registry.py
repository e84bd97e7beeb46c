"""All queries, by name.  The suffix is the capability id of the blueprint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import fixed_values as fv
from emberline.functions.expr import flag, hash_uniform, rnd
from emberline.operators import (
    derive, features, metrics, planning, prices, quality, recipes, regional, reports, wastage,
)
from emberline.operators.ordered import median_table
from emberline.plans import views as v
from emberline.plans.modelling_queries import MODEL_QUERIES
from emberline.sources import tables
from emberline.sources.staging import new_path
from emberline.sources.statistics import column_statistics

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ("region", "dealer")
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


# ---- sources and sinks -----------------------------------------------------


@query("read_table_csv_s1")
def _(spark, d):
    padded = {n: f" {h} " for h, n in fv.PRICE_SOURCE_HEADERS.items()}
    path = new_path(spark, "anchors-csv")
    # columns in another order, padded names, a column too many
    anchors = v.price_anchor_view(spark, d).select(
        F.col("commercial_price_inr").alias(padded["commercial_price_inr"]),
        F.col("series").alias("not wanted"),
        rnd(F.col("commercial_price_inr") / 2, 2).alias(padded["domestic_price_inr"]),
        F.date_format("date", "dd-MMM-yy").alias(padded["date_str"]),
    )
    tables.write_stage(anchors, path, "csv")
    return tables.read_table_csv(spark, path, tables.PRICE_SCHEMA, fv.PRICE_SOURCE_HEADERS)


@query("parse_date_lenient_s2")
def _(spark, d):
    text = F.when(F.col("o_orderkey") % 10 == 0, F.lit("not a date")).otherwise(
        F.date_format("o_orderdate", "dd-MMM-yy")
    )
    src = v.table(spark, d, "orders").select("o_orderkey", text.alias("date_str"))
    return tables.parse_date_lenient(src, "date_str")


@query("write_stage_s3")
def _(spark, d):
    path = tables.write_stage(
        v.event_table(spark, d), new_path(spark, "events-by-year"), partition_by=["year"]
    )
    return (
        spark.read.parquet(path)
        .groupBy("year")
        .agg(F.count("*").alias("n_events"), F.sum("cylinders_needed").alias("cylinders"))
    )


RANGED = [*fv.TARGETS, "price_lag1_inr", "price_lag2_inr", "headcount"]


@query("column_ranges_s4")
def _(spark, d):
    return tables.column_ranges(v.event_table(spark, d), RANGED)


@query("column_statistics_s4")
def _(spark, d):
    """Ranges of a table that was appended to: the second call reads the second part's files alone."""
    e = v.event_table(spark, d).select("event_id", *RANGED)
    path = new_path(spark, "appended")
    e.filter("event_id % 3 > 0").write.parquet(path)
    column_statistics(spark, path, RANGED)
    e.filter("event_id % 3 = 0").write.mode("append").parquet(path)
    return column_statistics(spark, path, RANGED)


@query("write_metadata_s4")
def _(spark, d):
    f = v.model_inputs(v.feature_table(spark, d))
    doc = tables.dataset_metadata(
        f, features.scaled_columns(f), fv.TARGETS,
        {c: {w: i for i, w in enumerate(ws)} for c, ws in features.fit_label_classes(f).items()},
        {"wastage": fv.BENCHMARK_WASTAGE_RATE, "gas": fv.GAS_PER_SERVING},
    )
    path = tables.write_metadata(doc, new_path(spark, "metadata"))
    return tables.metadata_ranges(tables.read_metadata(spark, path))


@query("ingest_requests_s6")
def _(spark, d):
    ev = v.events_view(spark, d)
    some = F.col("event_id") % 3
    request = F.struct(
        F.concat(F.lit("CAT"), F.col("caterer_id").cast("string")).alias("caterer_id"),
        F.when(some != 0, F.col("experience_yrs")).alias("experience_yrs"),
        F.when(some != 1, F.col("headcount")).alias("headcount"),
        F.col("event_date"),
        F.when(some != 2, F.col("menu_profile")).alias("menu_profile"),
        F.when(some == 0, F.col("is_festival_season")).alias("is_festival_season"),
    )
    second = F.struct(F.date_add("event_date", 1).alias("event_date"))
    docs = ev.select(
        "event_id",
        F.to_json(
            F.struct(
                F.array(
                    request,
                    F.struct(
                        *[
                            second["event_date"].alias(c)
                            if c == "event_date"
                            else F.lit(None).cast(t).alias(c)
                            for c, t in (
                                ("caterer_id", "string"), ("experience_yrs", "int"),
                                ("headcount", "int"), ("event_date", "date"),
                                ("menu_profile", "string"), ("is_festival_season", "boolean"),
                            )
                        ]
                    ),
                ).alias("events"),
                F.when(F.col("event_id") % 2 == 0, F.lit(50000.0)).alias("budget_inr"),
            )
        ).alias("body"),
    )
    return tables.ingest_requests(docs, "body", keep=["event_id"]).withColumn(
        "is_festival_season", flag(F.col("is_festival_season"))
    )


# ---- recipes and wastage ---------------------------------------------------

LETTER_HIGH, LETTER_LOW, LETTER_MED = ("sch", "qu"), ("ing", "eau"), ("ent", "on")
LETTER_NONVEG, LETTER_VEG = ("th", "au"), ("he", "er")


@query("filter_recipes_p1")
def _(spark, d):
    return recipes.filter_recipes(v.recipes_view(spark, d)).select(
        "recipe_id", "cook_time_mins", "servings"
    )


@query("gas_rate_t1")
def _(spark, d):
    r = v.recipes_view(spark, d)
    return r.select("recipe_id", recipes.gas_rate("ingredients", "course").alias("gas_rate"))


@query("gas_rate_other_words_t1")
def _(spark, d):
    r = v.recipes_view(spark, d)
    rate = recipes.gas_rate("ingredients", "course", LETTER_HIGH, LETTER_LOW, LETTER_MED)
    return r.select("recipe_id", rate.alias("gas_rate"))


@query("gas_per_serving_t2")
def _(spark, d):
    return recipes.process_recipes(v.recipes_view(spark, d)).select(
        "recipe_id", "gas_per_serving_kg"
    )


@query("menu_profile_t3")
def _(spark, d):
    r = v.recipes_view(spark, d)
    return r.select(
        "recipe_id", recipes.menu_profile("course", "diet", "ingredients").alias("menu_profile")
    )


@query("menu_profile_other_words_t3")
def _(spark, d):
    r = v.recipes_view(spark, d)
    profile = recipes.menu_profile("course", "diet", "ingredients", LETTER_NONVEG, LETTER_VEG)
    return r.select("recipe_id", profile.alias("menu_profile"))


@query("gas_by_profile_a2")
def _(spark, d):
    return recipes.gas_by_profile(recipes.process_recipes(v.recipes_view(spark, d)))


@query("cook_time_by_profile_a3")
def _(spark, d):
    return recipes.cook_time_by_profile(recipes.process_recipes(v.recipes_view(spark, d)))


@query("commercial_rates_t4")
def _(spark, d):
    processed = recipes.process_recipes(v.recipes_view(spark, d))
    return recipes.commercial_rates(recipes.gas_by_profile(processed))


@query("menu_lookup_j3")
def _(spark, d):
    processed = recipes.process_recipes(v.recipes_view(spark, d))
    return recipes.menu_lookup(
        v.event_requests(spark, d),
        recipes.commercial_rates(recipes.gas_by_profile(processed)),
        recipes.cook_time_by_profile(processed),
    ).select("event_id", "gas_intensity_per_serving", "typical_dishes", "avg_cook_time_mins")


@query("remap_category_p3")
def _(spark, d):
    return wastage.process_wastage(v.wastage_view(spark, d)).select(
        "l_orderkey", "l_linenumber", "event_type", "cooking_intensity", "season"
    )


@query("wastage_rate_p4")
def _(spark, d):
    return v.wastage_view(spark, d).select(
        "l_orderkey",
        "l_linenumber",
        wastage.wastage_rate("wastage_amount", "quantity_of_food").alias("wastage_rate"),
    )


@query("mean_rate_by_type_a1")
def _(spark, d):
    return v.observed_rates(spark, d)


@query("mean_rate_of_records_a1")
def _(spark, d):
    """The same from single records, where a record's type is its own."""
    return wastage.mean_rate_by_type(wastage.process_wastage(v.wastage_view(spark, d)))


@query("rate_lookup_j5")
def _(spark, d):
    return wastage.rate_lookup(v.event_requests(spark, d), v.observed_rates(spark, d)).select(
        "event_id", "event_type", "wastage_rate"
    )


# ---- prices ----------------------------------------------------------------


@query("grid_left_join_j1")
def _(spark, d):
    return prices.grid_left_join(v.price_anchor_view(spark, d), ("series",), *v.NATION_GRID)


@query("interpolate_linear_w1")
def _(spark, d):
    return v.nation_series(spark, d).select("series", "date", "commercial_price_inr")


@query("lag_features_w2")
def _(spark, d):
    return v.nation_series(spark, d).select("series", "date", "price_lag1", "price_lag2")


@query("diff_feature_w3")
def _(spark, d):
    return v.nation_series(spark, d).select("series", "date", "price_mom_change")


@query("series_summary_a4")
def _(spark, d):
    return prices.series_summary(v.price_anchor_view(spark, d))


@query("price_lookup_j2")
def _(spark, d):
    return prices.price_lookup(
        v.events_view(spark, d).select("event_id", "year", "month"), prices.reference_series(spark)
    )


# ---- joins -----------------------------------------------------------------


@query("season_lookup_j4")
def _(spark, d):
    return derive.season_lookup(
        v.event_requests(spark, d).select("event_id", F.month("event_date").alias("month"))
    )


@query("weather_lookup_j6")
def _(spark, d):
    return derive.weather_lookup(
        v.event_requests(spark, d).select("event_id", F.month("event_date").alias("month"))
    )


@query("profile_join_j7")
def _(spark, d):
    return planning.profile_join(v.event_requests(spark, d), v.caterer_profiles(spark, d))


@query("delivery_lead_j8")
def _(spark, d):
    return v.events_view(spark, d).select("event_id", "region", "lead_days")


@query("calendar_demand_join_j10")
def _(spark, d):
    return regional.demand_curve(v.plan_table(spark, d), v.AS_OF, keys=KEYS).select(
        *KEYS, "date", "raw_demand"
    )


# ---- derivation ------------------------------------------------------------


def _derived(*cols):
    return lambda spark, d: derive.derive_events(v.events_with_menu(spark, d)).select("event_id", *cols)


QUERIES["derive_consumption_v1"] = _derived("consumption_kg")
QUERIES["shock_factor_v2"] = _derived("shock_factor", "covid_period")
QUERIES["cylinders_needed_v3"] = _derived("cylinders_needed")
QUERIES["derive_stockout_v6"] = _derived("cylinders_ordered", "ran_out_of_gas")
QUERIES["order_lead_days_v7"] = _derived("order_lead_days")


@query("wastage_kg_v4")
def _(spark, d):
    return v.event_table(spark, d).select("event_id", "wastage_rate", "wastage_kg")


@query("first_label_v5")
def _(spark, d):
    e = v.event_table(spark, d)
    ordered = derive.cylinders_ordered(
        "cylinders_needed", "experience_yrs", hash_uniform("42a1", "event_id"),
        fv.FIRST_LABEL_ACCURACY,
    )
    e = e.withColumn("ordered", ordered)
    return e.select(
        "event_id",
        "ordered",
        derive.stockout_first_label(
            F.col("ordered"), F.col("cylinders_needed"), F.col("wedding_season"),
            F.col("headcount"), F.col("experience_yrs"),
            hash_uniform("42s1", "event_id"), hash_uniform("42g1", "event_id"),
        ).alias("stockout"),
    )


@query("event_table_v")
def _(spark, d):
    return v.event_table(spark, d).drop("is_festival_season", "shock_factor")


# ---- cleaning and features ---------------------------------------------------

NARROW = {
    "headcount": (100, 2000), "consumption_kg": (5.0, 300.0), "cylinders_needed": (1, 15),
    "duration_hrs": (2.5, 9.5), "wastage_kg": (0.5, None), "order_lead_days": (1, 9),
}


@query("clean_events_p2")
def _(spark, d):
    return features.clean_events(v.event_table(spark, d)).select("event_id", "consumption_kg")


@query("clean_report_p2")
def _(spark, d):
    return features.clean_report(v.event_table(spark, d), NARROW)


@query("select_features_p5")
def _(spark, d):
    e = v.model_inputs(v.feature_table(spark, d))
    classes = features.fit_label_classes(e)
    return features.select_features(features.one_hot(features.label_encode(e, classes)))


@query("coerce_numeric_p6")
def _(spark, d):
    o = v.table(spark, d, "orders")
    mixed = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    src = o.select("o_orderkey", mixed.alias("a"), F.col("o_orderpriority").alias("b"))
    return features.coerce_numeric(src, ["a", "b"])


@query("inverse_scale_clip_p7")
def _(spark, d):
    lo, hi = fv.CONSUMPTION_LIMITS
    scaled = rnd(hash_uniform("42z", "event_id") * 1.2 - 0.1, 4)
    return v.event_table(spark, d).select(
        "event_id", features.inverse_scale_clip(scaled, lo, hi).alias("kg")
    )


def _feature(*cols):
    return lambda spark, d: features.add_features(v.event_table(spark, d)).select("event_id", *cols)


QUERIES["rate_features_f1"] = _feature("kg_per_guest", "kg_per_burner_hr")
QUERIES["size_features_f2"] = _feature("log_headcount", "event_scale", "dish_load")
QUERIES["month_cycle_f3"] = _feature("month_sin", "month_cos")
QUERIES["season_intensity_f4"] = _feature("season_intensity")
QUERIES["condition_flags_f5"] = _feature(
    "heat_stress", "price_surge_flag", "is_monsoon", "novice_peak_season"
)
QUERIES["price_index_f6"] = _feature("price_index")
QUERIES["experience_tier_f7"] = _feature("experience_tier")


@query("label_encode_e1")
def _(spark, d):
    e = v.feature_table(spark, d)
    return features.label_encode(e, features.fit_label_classes(e)).select(
        "event_id", *[f"{c}_enc" for c in fv.ENCODED]
    )


@query("vocabulary_encode_e1")
def _(spark, d):
    """A column with as many classes as there are clerks and days."""
    o = v.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.concat_ws(" ", F.col("o_orderdate").cast("date").cast("string"), F.col("o_custkey").cast("string")).alias("visit"),
        F.col("o_orderpriority").alias("priority"),
    )
    vocabulary = features.fit_vocabulary(o, ["visit", "priority"])
    return features.encode_by_vocabulary(o, vocabulary, ["visit", "priority"]).select("event_id", "visit_enc", "priority_enc")


@query("one_hot_e2")
def _(spark, d):
    return features.one_hot(v.event_table(spark, d)).select(
        "event_id", *[f"etype_{t}" for t in fv.EVENT_TYPES]
    )


LAGS = ["price_lag1_inr", "price_lag2_inr"]


@query("median_e3")
def _(spark, d):
    f = v.feature_table(spark, d)
    return median_table(f, [*features.scaled_columns(v.model_inputs(f)), *fv.TARGETS])


@query("impute_e3")
def _(spark, d):
    e = v.event_table(spark, d).select("event_id", *LAGS)
    return features.impute(e, features.fit_medians(e, LAGS))


@query("min_max_scale_e4")
def _(spark, d):
    df, params = v.normalised(spark, d)
    cols = [*params["scaled"], *fv.TARGETS]
    return df.select("event_id", *[rnd(c, 6).alias(c) for c in cols])


# ---- quality -----------------------------------------------------------------


def _raw_requests(spark, d):
    o = v.table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("event_id"),
        (F.col("o_custkey") % 45).cast("int").alias("experience_yrs"),
        (k % 33).cast("int").alias("num_burners"),
        F.get(F.array(*map(F.lit, [*fv.BUSINESS_SIZES, "huge"])), (k % 4).cast("int")).alias(
            "business_size"
        ),
        F.floor(F.col("o_totalprice") / 80).cast("int").alias("headcount"),
        (k % 23).cast("int").alias("num_dishes"),
        ((k % 171) / F.lit(10.0)).alias("duration_hrs"),
        F.when(k % 50 != 0, F.col("o_orderdate").cast("date")).alias("event_date"),
    )


@query("validate_requests_q1")
def _(spark, d):
    checked = quality.validate_requests(_raw_requests(spark, d))
    return checked.select(
        "event_id", flag(F.col("accepted")).alias("accepted"),
        F.array_join("reasons", "; ").alias("reasons"),
    )


@query("dataset_checks_q2")
def _(spark, d):
    df, params = v.normalised(spark, d)
    cols = [c for c in df.columns if c != "event_id"]
    out = quality.dataset_checks(df, cols, [*params["scaled"], *fv.TARGETS])
    return out.withColumn("passed", flag(F.col("passed")))


@query("duplicate_rows_q2")
def _(spark, d):
    return quality.duplicate_rows(
        v.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"]
    )


@query("correlations_a18")
def _(spark, d):
    e = v.encoded(spark, d)
    return quality.all_correlations(e, features.feature_names(e), ["consumption_kg", "ran_out_of_gas"])


@query("leakage_audit_q3")
def _(spark, d):
    e = v.encoded(spark, d)
    out = quality.leakage_audit(e, features.feature_names(e), "consumption_kg")
    return out.withColumn("in_leak_free_set", flag(F.col("in_leak_free_set")))


# ---- reports -------------------------------------------------------------------

QUERIES["dataset_summary_a5"] = lambda s, d: reports.dataset_summary(v.event_table(s, d))
QUERIES["share_of_a6"] = lambda s, d: reports.share_of(v.event_table(s, d), "event_type")
QUERIES["monthly_mean_a7"] = lambda s, d: reports.monthly_mean(v.event_table(s, d))
QUERIES["type_profile_a8"] = lambda s, d: reports.type_profile(v.event_table(s, d))
QUERIES["benchmark_check_a9"] = lambda s, d: reports.benchmark_check(v.event_table(s, d))
QUERIES["stockout_rate_a10"] = lambda s, d: reports.stockout_rate(v.event_table(s, d))


@query("top_k_l2")
def _(spark, d):
    e = v.event_table(spark, d).select("event_id", "caterer_id", "consumption_kg")
    return reports.top_k(e, 10, "consumption_kg", "event_id")


@query("first_n_l3")
def _(spark, d):
    curve = regional.demand_curve_full(v.plan_table(spark, d), v.AS_OF, v.CAPACITY, keys=KEYS)
    return reports.first_n(curve.select(*KEYS, "date", "raw_demand"), 30, "date", "dealer")


# ---- metrics ---------------------------------------------------------------------

QUERIES["confusion_matrix_a14"] = lambda s, d: metrics.confusion_matrix(v.prediction_view(s, d))
QUERIES["classification_report_a15"] = lambda s, d: metrics.classification_report(
    v.prediction_view(s, d)
)
QUERIES["roc_auc_a16"] = lambda s, d: metrics.roc_auc(v.prediction_view(s, d))
QUERIES["regression_metrics_a17"] = lambda s, d: metrics.regression_metrics(
    v.prediction_view(s, d), "actual", "predicted"
)


# ---- planning ----------------------------------------------------------------------


def _flat(plans: DataFrame) -> DataFrame:
    """Action list as one text, so that result sets compare by value."""
    return plans.withColumn("action_items", F.array_join("action_items", " | "))


@query("plan_events_o11")
def _(spark, d):
    return _flat(planning.plan_events(v.events_view(spark, d)))


def _planned(*cols):
    def run(spark, d):
        return planning.plan_events(v.events_view(spark, d)).select("event_id", *cols)

    return run


QUERIES["rule_consumption_o1"] = _planned("predicted_consumption_kg")
QUERIES["cylinders_with_buffer_o3"] = _planned("cylinders_to_order")
QUERIES["wastage_and_cost_o6"] = _planned("wastage_estimate_kg", "estimated_cost_inr")
QUERIES["efficiency_o7"] = _planned("efficiency_score")
QUERIES["tier_o8"] = _planned("recommendation_tier")
QUERIES["notes_o10"] = _planned("optimization_notes")


@query("action_items_o9")
def _(spark, d):
    e = v.event_table(spark, d)
    risk = planning.stockout_risk("consumption_kg", "cylinders_ordered", "experience_yrs")
    e = e.withColumn("risk", risk)
    items = planning.action_items(
        "risk", "cylinders_ordered", "experience_yrs",
        planning.planner_wastage_rate("event_type", "experience_yrs"),
        "event_type", "is_festival_season", "headcount",
    )
    return e.select(
        "event_id", F.size(items).alias("n_items"), F.array_join(items, " | ").alias("action_items")
    )


@query("blend_o2")
def _(spark, d):
    e = v.event_table(spark, d).withColumn("rule_kg", planning.rule_consumption())
    ml = F.when(F.col("event_id") % 4 != 0, F.col("consumption_kg"))
    return e.select("event_id", planning.blend("rule_kg", ml).alias("blended_kg"))


@query("blended_plan_o11")
def _(spark, d):
    e = v.event_table(spark, d).withColumn(
        "ml_kg", F.when(F.col("event_id") % 4 != 0, F.col("consumption_kg"))
    )
    return _flat(planning.plan_events(e, ml_kg="ml_kg"))


@query("stockout_risk_o4")
def _(spark, d):
    e = v.event_table(spark, d)
    return e.select(
        "event_id",
        planning.stockout_risk("consumption_kg", "cylinders_ordered", "experience_yrs").alias("risk"),
    )


@query("order_dates_o5")
def _(spark, d):
    return v.plan_table(spark, d).select(
        "event_id", "recommended_order_date", "latest_safe_order_date"
    )


def _budgets(spark, d):
    """One batch per dealer; the budget follows the balances of its customers."""
    c = v.table(spark, d, "customer")
    n = v.table(spark, d, "nation")
    sums = c.groupBy("c_nationkey").agg((F.sum(F.floor("c_acctbal")) * 28).alias("b"))
    return n.join(sums, n.n_nationkey == sums.c_nationkey, "left").select(
        F.col("n_name").alias("dealer"),
        F.when(F.col("n_nationkey") % 5 != 0, F.col("b")).cast("double").alias("budget_inr"),
    )


@query("batch_procurement_o12")
def _(spark, d):
    listed = _budgets(spark, d).filter("dealer not in ('KENYA', 'PERU')")
    return planning.batch_procurement(v.event_table(spark, d), "dealer", listed)


@query("batch_totals_o12")
def _(spark, d):
    return planning.batch_totals(v.event_table(spark, d), "dealer", _budgets(spark, d))


@query("delivery_cap_o13")
def _(spark, d):
    return regional.delivery_cap(v.plan_table(spark, d), 50).select(
        "event_id", "running_cylinders", "day_cylinders", "within_cap", "day_over_cap"
    )


@query("batch_summary_a11")
def _(spark, d):
    return planning.batch_summary(v.plan_table(spark, d))


@query("batch_summary_by_dealer_a11")
def _(spark, d):
    return planning.batch_summary(v.plan_table(spark, d), ["dealer"])


@query("caterer_rollup_a19")
def _(spark, d):
    return regional.caterer_rollup(v.plan_table(spark, d))


# ---- regional ------------------------------------------------------------------------


@query("demand_curve_r1")
def _(spark, d):
    return regional.demand_curve(v.plan_table(spark, d), v.AS_OF, keys=KEYS).withColumn(
        "is_weekend", flag(F.col("is_weekend"))
    )


@query("rolling_mean_w4")
def _(spark, d):
    curve = regional.demand_curve_full(v.plan_table(spark, d), v.AS_OF, v.CAPACITY, keys=KEYS)
    return curve.select(*KEYS, "date", "smoothed_demand")


@query("capacity_pressure_r2")
def _(spark, d):
    curve = regional.demand_curve_full(v.plan_table(spark, d), v.AS_OF, v.CAPACITY, keys=KEYS)
    return curve.select(
        *KEYS, "date", "smoothed_demand", "capacity_pressure", flag(F.col("spike_flag")).alias("spike_flag")
    )


@query("shift_rank_w5")
def _(spark, d):
    ranked = regional.shift_rank(v.plan_table(spark, d), v.AS_OF, v.CAPACITY, keys=KEYS)
    return ranked.select(
        "event_id", "shift_rank", "day_plans", flag(F.col("is_candidate")).alias("is_candidate")
    )


@query("shift_plan_r3")
def _(spark, d):
    return regional.shift_plan(v.plan_table(spark, d), v.AS_OF, v.CAPACITY, keys=KEYS).select(
        "event_id", "original_order_date", "recommended_order_date", "shifted_days"
    )


@query("shift_plan_strict_guard_r3")
def _(spark, d):
    moved = regional.shift_plan(
        v.plan_table(spark, d), v.AS_OF, v.CAPACITY, keys=KEYS, guard="reference"
    )
    return moved.select("event_id", "recommended_order_date", "shifted_days")


@query("smoothed_curve_r4")
def _(spark, d):
    p = v.plan_table(spark, d)
    shifted = regional.shift_plan(p, v.AS_OF, v.CAPACITY, keys=KEYS)
    return regional.smoothed_curve(p, shifted, v.AS_OF, v.CAPACITY, keys=KEYS).select(
        *KEYS, "date", "raw_demand", "smoothed_orders", "peak_reduction_pct"
    )


@query("regional_summary_a12")
def _(spark, d):
    p = v.plan_table(spark, d)
    curve = regional.demand_curve_full(p, v.AS_OF, v.CAPACITY, keys=KEYS)
    return regional.regional_summary(p, curve, v.CAPACITY, keys=KEYS)


@query("before_after_a13")
def _(spark, d):
    _, change, _ = regional.regional_forecast(v.plan_table(spark, d), v.AS_OF, v.CAPACITY, keys=KEYS)
    return change


@query("regional_forecast_r5")
def _(spark, d):
    return regional.forecast_table(v.plan_table(spark, d), v.AS_OF, v.CAPACITY, keys=KEYS)


QUERIES.update(MODEL_QUERIES)
