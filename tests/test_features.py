import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline import fixed_values as fv
from emberline.operators import features, quality
from emberline.plans import views


def test_experience_bins_are_right_closed(spark):
    df = spark.createDataFrame([(y,) for y in (0, 1, 2, 3, 5, 6, 10, 11, 30, 31)], "y int")
    got = [r[0] for r in df.select(features.experience_tier("y")).collect()]
    want = pd.cut([0, 1, 2, 3, 5, 6, 10, 11, 30, 31], [0, 2, 5, 10, 30], labels=["novice", "intermediate", "experienced", "expert"])
    assert got == [None if pd.isna(x) else x for x in want]


def test_scaling_constant_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, 4.0), (3, 5.0, 1.0), (4, 5.0, 3.0), (5, 5.0, 2.0)], "a int, c double, n double")
    medians = features.fit_medians(df, ["a", "c", "n"])
    assert medians == {"a": 3.0, "c": 5.0, "n": 2.5}
    filled = features.impute(df, medians)
    got = features.scale(filled, features.fit_ranges(filled, ["a", "c", "n"])).collect()
    assert [r["c"] for r in got] == [0.0] * 5
    assert [r["a"] for r in got] == [0, 0.25, 0.5, 0.75, 1]
    assert got[0]["n"] == 0.5


def test_label_codes_are_alphabetical(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("c", "y")], "p string, q string")
    classes = features.fit_label_classes(df, ["p", "q"])
    assert classes == {"p": ["a", "b", "c"], "q": ["nan", "x", "y"]}
    got = features.label_encode(df, classes).collect()
    assert [(r["p_enc"], r["q_enc"]) for r in got] == [(1, 1), (0, 0), (2, 2)]
    with pytest.raises(ValueError):
        features.fit_label_classes(spark.range(50).select(F.col("id").cast("string").alias("p")), ["p"], max_classes=10)


def test_one_hot_sums_to_one(spark):
    df = spark.createDataFrame([(t,) for t in fv.EVENT_TYPES] + [("other",)], "event_type string")
    got = features.one_hot(df).collect()
    assert [sum(r[f"etype_{t}"] for t in fv.EVENT_TYPES) for r in got] == [1] * 8 + [0]


def test_clean_bounds(spark):
    ok = dict(headcount=10, consumption_kg=500.0, cylinders_needed=29, duration_hrs=0.5, wastage_kg=0.0, order_lead_days=30)
    rows = [ok] + [dict(ok, **{c: v}) for c, v in (
        ("headcount", 9), ("consumption_kg", 500.1), ("cylinders_needed", 30), ("duration_hrs", 16.1),
        ("wastage_kg", -0.1), ("order_lead_days", 31), ("headcount", None))]
    schema = "headcount int, consumption_kg double, cylinders_needed int, duration_hrs double, wastage_kg double, order_lead_days int"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    assert features.clean_events(df).count() == 1
    report = features.clean_report(df).first().asDict()
    assert report["rows_in"] == 8 and report["rows_kept"] == 1
    assert (report["bad_headcount"], report["bad_wastage_kg"]) == (2, 1)


def test_normalised_table(spark, sf_dir):
    df, params = views.normalised(spark, sf_dir)
    assert len(df.columns) == 54  # 53 columns and the event id
    assert len(features.feature_names(df)) == 42
    assert len(features.feature_names(df, also=fv.LABEL_INPUTS)) == 40
    cols = [c for c in df.columns if c != "event_id"]
    checks = quality.dataset_checks(df, cols, [*params["scaled"], *fv.TARGETS]).first()
    assert checks["passed"] and checks["n_nulls"] == 0


def test_checks_see_nulls_and_copies(spark):
    df = spark.createDataFrame([(1.0, 0.1), (1.0, 0.1), (1.0, 0.1), (None, 0.5)], "a double, b double")
    got = quality.dataset_checks(df, ["a", "b"], ["b"]).first()
    assert (got["n_rows"], got["n_nulls"], got["n_duplicates"], got["passed"]) == (4, 1, 2, False)


@pytest.mark.parametrize("field,good,bad", [
    ("experience_yrs", (1, 40), (0, 41, None)), ("num_burners", (1, 30), (0, 31)), ("headcount", (10, 5000), (9, 5001)),
    ("num_dishes", (1, 20), (0, 21)), ("duration_hrs", (0.5, 16.0), (0.4, 16.1)), ("business_size", ("small", "large"), ("huge", None)),
])
def test_request_bounds(spark, field, good, bad):
    import datetime as dt

    base = dict(experience_yrs=8, num_burners=8, business_size="medium", event_date=dt.date(2024, 1, 1), headcount=300, num_dishes=6, duration_hrs=5.0)
    schema = "experience_yrs int, num_burners int, business_size string, event_date date, headcount int, num_dishes int, duration_hrs double"
    df = spark.createDataFrame([tuple(dict(base, **{field: v}).values()) for v in (*good, *bad)], schema)
    accepted, rejected = quality.split_requests(df)
    assert sorted(r[field] for r in accepted.collect()) == sorted(good)
    reasons = [r["reasons"] for r in rejected.collect()]
    assert len(reasons) == len(bad) and all(len(x) == 1 and field in x[0] for x in reasons)


def test_duplicates_when_many_rows_repeat(spark):
    df = spark.range(300).select((F.col("id") % 40).alias("a"), (F.col("id") % 3).alias("b"), F.lit("x").alias("c"))
    few = sorted(map(tuple, quality.duplicate_rows(df, ["a", "b", "c"]).collect()))
    assert sum(r[-1] for r in few) == 300 and len(few) == 120


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 3.0, 2.0), (2.0, 3.0, 4.0)], "a double, c double, y double")
    got = {r["feature"]: r["correlation"] for r in quality.correlations(df, ["a", "c"], "y").collect()}
    assert got == {"a": 1.0, "c": None}


def test_correlation_over_complete_pairs(spark):
    rows = [(float(i) if i % 10 == 0 else None, float(i) if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert quality.correlations(df, ["x"], "y").first()["correlation"] == 1.0
