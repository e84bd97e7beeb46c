import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import features, modelling
from emberline.plans import modelling_queries as mq
from emberline.plans import views
from emberline.sources import staging, tables


def test_split_is_stable_and_about_eighty_percent(spark):
    df = spark.range(20_000).withColumnRenamed("id", "event_id")
    a = {r[0] for r in modelling.add_split(df).filter("is_train = 1").select("event_id").collect()}
    b = {r[0] for r in modelling.add_split(df.repartition(13)).filter("is_train = 1").select("event_id").collect()}
    assert a == b and 0.78 < len(a) / 20_000 < 0.82


@pytest.mark.parametrize("clip", ["observed", "unit"])
def test_oversampling(spark, clip):
    df = spark.range(8000).select(
        F.col("id").alias("event_id"), (F.col("id") % 5 == 0).cast("int").alias("ran_out_of_gas"),
        (F.col("id") % 100 / 100.0).alias("x"), F.lit(0.0).alias("flag"),
    )
    extra = modelling.oversample(df, ["x", "flag"], noisy=["x"], clip=clip)
    both = modelling.append_rows(df, extra)
    pos, neg = (both.filter(f"ran_out_of_gas = {v}").count() for v in (1, 0))
    assert neg == 6400 and 0.45 < pos / neg < 0.55
    got = extra.agg(F.min("x"), F.max("x"), F.max("flag")).first()
    assert got[0] >= 0.0 and got[1] <= (0.99 if clip == "observed" else 1.0)
    assert (got[2] == 0.0) == (clip == "observed")


def test_balanced_rows_get_no_copies(spark):
    df = spark.range(100).select(F.col("id").alias("event_id"), (F.col("id") % 2).cast("int").alias("ran_out_of_gas"), F.lit(0.5).alias("x"))
    assert modelling.oversample(df, ["x"]).count() == 0


def test_models_learn_and_round_trip(spark, sf_dir):
    models, predicted = mq.trained(spark, sf_dir)
    report = {(r["target"], r["model"]): r["r2"] for r in modelling.regression_report(predicted, models).collect()}
    assert report[("consumption_kg", "gbt")] > 0.9
    winners = {r["target"]: r["winner"] for r in modelling.compare_models(modelling.regression_report(predicted, models)).collect()}
    assert set(winners.values()) <= {"gbt", "mlp"} and len(winners) == 2
    c = modelling.classifier_report(predicted).first()
    assert 0.5 < c["auc"] <= 1.0 and c["tn"] + c["fp"] + c["fn"] + c["tp"] == predicted.count()
    imp = modelling.importances(spark, models).toPandas()
    assert len(imp) == 42
    assert imp[["consumption", "cylinders", "stockout"]].sum().tolist() == pytest.approx([1, 1, 1])
    assert (imp[imp.feature.isin(["experience_yrs", "novice_peak_season"])].stockout == 0).all()

    path = staging.new_path(spark, "models")
    modelling.save_models(spark, models, path)
    only = modelling.load_models(spark, path, ["gbt_consumption", "missing"])
    assert list(only.fitted) == ["gbt_consumption"]
    table, _ = views.normalised(spark, sf_dir)
    scored = modelling.score_events(table, only)
    assert scored.filter("ml_stockout_risk_pct is not null").count() == 0
    assert scored.filter("ml_consumption_kg between 1.5 and 500").count() == table.count()


def test_leak_free_features(spark, sf_dir):
    table, _ = views.normalised(spark, sf_dir)
    regression, stockout = modelling.feature_sets(table, "leak_free")
    assert len(regression) == 40 and len(stockout) == 38
    assert not {"kg_per_guest", "kg_per_burner_hr"} & set(regression)


def test_metadata_document(spark, sf_dir):
    import json

    e = views.event_table(spark, sf_dir)
    classes = {"business_size": {"large": 0, "medium": 1, "small": 2}}
    row = tables.dataset_metadata(e, ["headcount"], ["consumption_kg"], classes).first()
    doc = json.loads(row["metadata_json"])
    assert doc["total_rows"] == row["total_rows"] == e.count()
    lo, hi = features.fit_ranges(e, ["headcount"])["headcount"]
    assert (doc["features"]["min"], doc["features"]["max"]) == ([lo], [hi])
    assert json.loads(doc["label_maps"]) == classes


def test_patience():
    assert modelling.stop_after([5, 4, 4.5, 3, 3.5, 3.2, 3.1], 3) == 4
    assert modelling.stop_after([5, 4, 4.5, 4.2, 4.1, 1], 3) == 2
    assert modelling.stop_after([3, 2, 1], 20) == 3


def test_boosting_goes_on_past_a_worse_tree(spark):
    rng = np.random.default_rng(3)
    x = rng.random(300)
    rows = [(float(a), float(np.sin(9 * a) + rng.normal(0, 0.3)), bool(i % 5 == 0)) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, y double, is_validation boolean")
    s = modelling.TreeSettings(trees=12, rate=0.5, regressor_depth=3, patience=4)
    model = modelling.fit_boosted_regressor(df, ["x"], "y", "p", s)
    whole = modelling.boosted_regressor(["x"], "y", "p", s).fit(df.filter("not is_validation"))
    errors = whole.stages[1].evaluateEachIteration(whole.stages[0].transform(df.filter("is_validation")), "squared")
    assert model.stages[1].getNumTrees == modelling.stop_after(errors, 4)
