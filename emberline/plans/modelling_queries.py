"""Queries of the modelling part, at the documented settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import fixed_values as fv
from emberline.functions.expr import rnd
from emberline.operators import features, metrics, modelling, planning, prices, quality, reports, serving
from emberline.plans import views as v
from emberline.sources.staging import new_path, stage

SETTINGS = modelling.TreeSettings()  # the documented ones
def trained(spark, d):
    """(models, predictions on held-out rows), trained once per session and folder."""

    def build():
        table, params = v.normalised(spark, d)
        models, held_out = modelling.train_models(
            table, params["ranges"], params["scaled"], SETTINGS, preparation=params
        )
        predicted = modelling.predict_all(held_out, models).select(
            "event_id", "consumption_kg", "cylinders_needed", modelling.LABEL,
            "kg_gbt", "kg_mlp", "cyl_gbt", "cyl_mlp", "stockout", "stockout_score",
        )
        return models, stage(predicted, "held-out-predictions")

    return v.once(spark, d, "models", build)


def _split(spark, d):
    e = v.event_table(spark, d)
    return modelling.add_split(e).select("event_id", "is_train")


def _train_rows(spark, d):
    """(training rows with the 40 stockout features, those features, the scaled ones among them)."""
    table, params = v.normalised(spark, d)
    _, stockout = modelling.feature_sets(table)
    rows = modelling.add_split(table).filter("is_train = 1").select("event_id", modelling.LABEL, *stockout)
    return rows, stockout, [c for c in stockout if c in params["scaled"]]


def _oversample(spark, d):
    train, stockout, noisy = _train_rows(spark, d)
    extra = modelling.oversample(train, stockout, noisy=noisy)
    return extra.select(
        "event_id", F.col("copy_no"), modelling.LABEL, *[rnd(c, 4).alias(c) if c in noisy else c for c in stockout]
    )


def _append(spark, d):
    train, stockout, noisy = _train_rows(spark, d)
    both = modelling.append_rows(train, modelling.oversample(train, stockout, noisy=noisy))
    return both.groupBy(modelling.LABEL).agg(
        F.count("*").alias("n_rows"), F.countDistinct("event_id").alias("n_events"),
        *[rnd(F.avg(c), 3).alias(f"mean_{c}") for c in noisy],
    )


def _regressors(spark, d):
    models, predicted = trained(spark, d)
    return modelling.regression_report(predicted, models).filter("model = 'gbt'")


def _classifier(spark, d):
    return modelling.classifier_report(trained(spark, d)[1])


def _compare(spark, d):
    models, predicted = trained(spark, d)
    return modelling.compare_models(modelling.regression_report(predicted, models))


def _importance(spark, d):
    models, _ = trained(spark, d)
    return modelling.importance_table(
        spark, models.fitted["gbt_consumption"], models.features, "consumption"
    )


def _merged(spark, d):
    return modelling.importances(spark, trained(spark, d)[0])


def _sorted(spark, d):
    return _merged(spark, d).orderBy(F.col("stockout").desc(), "feature")


def _association(spark, d):
    """Two importance tables that need no model: absolute correlations of all features."""
    e = v.encoded(spark, d)
    names = features.feature_names(e)
    found = quality.all_correlations(e, names, ["consumption_kg", modelling.LABEL])
    strength = F.abs(F.coalesce("correlation", F.lit(0.0)))
    kg, stk = (
        found.filter(F.col("target") == target).select("feature", strength.alias(name))
        for target, name in (("consumption_kg", "consumption"), (modelling.LABEL, "stockout"))
    )
    return modelling.merge_importance(kg, stk.filter(~F.col("feature").isin(*fv.LABEL_INPUTS)))


def _association_top(spark, d):
    return reports.top_k(_association(spark, d), 10, "stockout", "feature")


def _top(spark, d):
    return reports.top_k(_merged(spark, d).select("feature", "stockout"), 10, "stockout", "feature")


def _parts(spark, d):
    """(training rows, other rows) of the feature table; ``_event`` holds a whole row."""
    rows = modelling.add_split(v.feature_table(spark, d))
    held = v.model_inputs(rows.withColumn("_event", F.struct(*rows.columns)))
    return held.filter("is_train = 1").drop("is_train", "_event"), held.filter("is_train = 0").drop("is_train")


def serving_models(spark, d):
    """Leak-free models of the training part with all that a request needs, fitted once per session and folder."""

    def build():
        train, _ = _parts(spark, d)
        fitted = features.fit_preparation(train)
        fitted["lookups"] = serving.fit_lookups(v.menu_table(spark, d), prices.reference_series(spark))
        table = stage(modelling.add_validation(features.apply_preparation(train, fitted)), "serving-rows")
        columns, stockout = modelling.feature_sets(table, "leak_free")
        models = modelling.fit_five(
            table, columns, stockout, SETTINGS, scaled=fitted["scaled"], names=("gbt_consumption", "gbt_stockout")
        )
        ranges = {c: tuple(fitted["ranges"][c]) for c in ("consumption_kg", "cylinders_needed")}
        return modelling.Models(models, columns, stockout, ranges, fitted)

    return v.once(spark, d, "serving models", build)


def _score_new(rows, models):
    """Scores of rows without anything that follows from their outcome."""
    gone = (*fv.TARGETS, *fv.TARGET_DERIVED, modelling.LABEL, "cylinders_ordered", "wastage_rate")
    return modelling.score_requests(rows.drop(*gone), models, carry="_event")


def _score(spark, d):
    scored = _score_new(_parts(spark, d)[1], serving_models(spark, d))
    return scored.select("event_id", "ml_consumption_kg", "ml_stockout_risk_pct")


def _predict(spark, d):
    """Scoring and planning of the held-out events in one map stage."""
    scored = _score_new(_parts(spark, d)[1], serving_models(spark, d))
    events = scored.select("_event.*", "ml_consumption_kg", "ml_stockout_risk_pct")
    plans = planning.plan_events(
        events, ml_kg="ml_consumption_kg",
        keep=("event_id", "ml_consumption_kg", "ml_stockout_risk_pct"),
    )
    return plans.withColumn("action_items", F.array_join("action_items", " | "))


FLOORS = {  # of R2 on the held-out rows; of AUC for the stockout
    ("consumption_kg", "gbt"): 0.97, ("consumption_kg", "mlp"): 0.97,
    ("cylinders_needed", "gbt"): 0.95, ("cylinders_needed", "mlp"): 0.95,
    ("ran_out_of_gas", "gbt"): 0.55,
}


def _floors(spark, d):
    """Whether each model passes its floor on the held-out rows."""
    models, predicted = trained(spark, d)
    report = modelling.regression_report(predicted, models).select("target", "model", "n_rows", F.col("r2").alias("quality"))
    c = modelling.classifier_report(predicted)
    stockout = c.select(
        F.lit(modelling.LABEL).alias("target"), F.lit("gbt").alias("model"),
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_rows"), F.col("auc").alias("quality"),
    )
    floor = F.lit(None).cast("double")
    for (target, model), least in FLOORS.items():
        floor = F.when((F.col("target") == target) & (F.col("model") == model), F.lit(least)).otherwise(floor)
    rows = report.unionByName(stockout)
    return rows.select("target", "model", "n_rows", (F.col("quality") >= floor).cast("int").alias("above_floor"))


def _trees_used(spark, d):
    return modelling.trees_used(spark, trained(spark, d)[0])


def _report(spark, d):
    models, predicted = trained(spark, d)
    return modelling.training_report(
        v.normalised(spark, d)[0], models,
        modelling.regression_report(predicted, models),
        modelling.classifier_report(predicted),
    )


def _save_load(spark, d):
    """Scores of the loaded models against those of the models in memory."""
    models, _ = trained(spark, d)
    path = new_path(spark, "models")
    modelling.save_models(spark, models, path)
    loaded = modelling.load_models(spark, path, [*modelling.MODEL_NAMES, "not_there"])
    table, _ = v.normalised(spark, d)
    a = modelling.score_events(table, models)
    b = modelling.score_events(table, loaded).toDF("event_id", "kg2", "risk2")
    same = (F.col("ml_consumption_kg") == F.col("kg2")) & (
        F.col("ml_stockout_risk_pct") == F.col("risk2")
    )
    return a.join(b, "event_id").agg(
        F.count("*").alias("n_events"),
        F.count_if(same).alias("n_same"),
        F.lit(len(loaded.fitted)).alias("n_models"),
    )


def _serve(spark, d):
    """Publish the leak-free models, load the current version, and score the held-out part with both."""
    models = serving_models(spark, d)
    root = new_path(spark, "published")
    modelling.publish_models(spark, models, root)
    loaded = modelling.load_version(spark, root)
    rest = _parts(spark, d)[1]
    a = _score_new(rest, models).select(
        "event_id", F.col("ml_consumption_kg").alias("kg"), F.col("_event.consumption_kg").alias("actual"),
        F.col("ml_stockout_risk_pct").alias("risk"),
    )
    b = _score_new(rest, loaded).select(
        "event_id", F.col("ml_consumption_kg").alias("kg2"), F.col("ml_stockout_risk_pct").alias("risk2")
    )
    both = stage(a.join(b, "event_id"), "served")
    r2 = metrics.regression_metrics(both, "actual", "kg").select("r2").scalar()
    return both.agg(
        F.count("*").alias("n_events"),
        F.count_if((F.col("kg") == F.col("kg2")) & (F.col("risk") == F.col("risk2"))).alias("n_same"),
        F.count_if(F.col("kg").between(*fv.CONSUMPTION_LIMITS)).alias("n_in_range"),
    ).withColumn("r2_above_floor", (r2 >= 0.9).cast("int"))


def _requests_served(spark, d):
    """Batch documents planned with the published models: request, features, scores, blend, plan and procurement."""
    models = serving_models(spark, d)
    e = v.events_view(spark, d)
    requests = e.select(
        F.col("event_id").alias("request_id"), F.lit(0).alias("position"), "caterer_id", "experience_yrs", "num_burners",
        "business_size", "event_date", "event_type", "headcount", "num_dishes", "duration_hrs", "menu_profile",
        "is_festival_season", "lead_days",
    )
    plans = serving.plan_requests(requests, models, ("request_id", "position"))
    batches = e.select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_id") % 2 == 0, F.lit(5000.0)).alias("budget_inr"), (F.col("event_id") % 3 != 0).alias("use_lp"),
    )
    served = serving.optimise_batches(stage(plans, "served-plans"), batches)
    lp = F.col("lp_status").isNotNull()
    return served.agg(
        F.count("*").alias("n_requests"), F.sum("total_events").alias("n_plans"),
        F.count_if(lp).alias("n_with_lp"), F.count_if(lp & ~F.col("use_lp")).alias("n_unasked"),
        F.count_if(F.col("lp_cylinders") > F.col("total_cylinders")).alias("n_lp_above_plan"),
    )


MODEL_QUERIES = {
    "held_out_serving_m7": _serve,
    "requests_served_m7": _requests_served,
    "model_floors_m2": _floors,
    "trees_used_m2": _trees_used,
    "split_m1": _split,
    "oversample_m4": _oversample,
    "append_rows_u1": _append,
    "boosted_regressors_m2": _regressors,
    "boosted_classifier_m3": _classifier,
    "compare_models_m5": _compare,
    "feature_importance_m6": _importance,
    "merge_importance_j9": _merged,
    "importance_sorted_l1": _sorted,
    "importance_top_l2": _top,
    "merge_association_j9": _association,
    "association_top_l1": _association_top,
    "batch_scoring_m7": _score,
    "predict_and_plan_m7": _predict,
    "training_report_m8": _report,
    "save_load_models_s5": _save_load,
}
