import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberline import fixed_values as fv
from emberline.operators import derive, planning


def one(spark, schema, values, expr):
    return spark.createDataFrame([values], schema).select(expr).first()[0]


@pytest.mark.parametrize("exp,share", [(2, 0.20), (3, 0.15), (5, 0.15), (6, 0.10), (20, 0.10)])
def test_buffer_by_experience(spark, exp, share):
    import math

    got = one(spark, "kg double, e int", (100.0, exp), planning.cylinders_with_buffer("kg", "e"))
    assert got == math.ceil(100 * (1 + share) / 17.5)


def test_at_least_one_cylinder(spark):
    assert one(spark, "kg double, e int", (0.0, 9), planning.cylinders_with_buffer("kg", "e")) == 1
    assert one(spark, "kg double", (17.5,), derive.cylinders_for("kg")) == 1
    assert one(spark, "kg double", (17.51,), derive.cylinders_for("kg")) == 2


@pytest.mark.parametrize(
    "kg,cyl,exp,risk",
    [(100.0, 6, 9, 0.0), (100.0, 4, 9, 30.0), (100.0, 4, 2, 45.0), (100.0, 4, 3, 36.0),
     (100.0, 4, 5, 36.0), (100.0, 4, 6, 30.0), (100.0, 0, 2, 99.0), (0.5, 0, 9, 50.0)],
)
def test_risk(spark, kg, cyl, exp, risk):
    got = one(spark, "kg double, c int, e int", (kg, cyl, exp), planning.stockout_risk("kg", "c", "e"))
    assert got == pytest.approx(risk)


@pytest.mark.parametrize(
    "risk,exp,days", [(0.0, 9, 3), (25.0, 9, 3), (25.1, 9, 4), (50.0, 9, 4), (50.1, 9, 6), (50.1, 2, 8), (0.0, 3, 3)]
)
def test_order_dates(spark, risk, exp, days):
    row = spark.createDataFrame([(dt.date(2024, 3, 1), 2, risk, exp, True)], "d date, l int, r double, e int, f boolean")
    got = row.select(
        planning.recommended_order_date("d", "l", "r", "e"), planning.latest_order_date("d", "l"),
        planning.recommended_order_date("d", "l", "r", "e", "f", 2),
    ).first()
    event = dt.date(2024, 3, 1)
    assert tuple(got) == (event - dt.timedelta(days), event - dt.timedelta(3), event - dt.timedelta(days + 2))


@pytest.mark.parametrize(
    "risk,eff,name",
    [(50.1, 90.0, "RED"), (0.0, 39.9, "RED"), (50.0, 90.0, "AMBER"), (25.1, 90.0, "AMBER"),
     (0.0, 64.9, "AMBER"), (25.0, 65.0, "GREEN"), (0.0, 40.0, "AMBER")],
)
def test_tier(spark, risk, eff, name):
    assert one(spark, "r double, e double", (risk, eff), planning.tier("r", "e")) == name


def test_lead_days(spark):
    df = spark.createDataFrame([("Chennai",), ("Madurai",), ("Trichy",), ("Coimbatore",), ("Elsewhere",), (None,)], "city string")
    assert [r[0] for r in df.select(planning.lead_days("city")).collect()] == [1, 2, 2, 2, 3, 3]


def plan_input(spark, **change):
    base = dict(
        event_id=1, caterer_id="CAT001", event_date=dt.date(2024, 11, 20), event_type="wedding", headcount=500,
        num_dishes=7, duration_hrs=6.0, menu_profile="mixed_standard", is_festival_season=True,
        experience_yrs=6, num_burners=8, lead_days=3,
    )
    base.update(change)
    schema = ("event_id long, caterer_id string, event_date date, event_type string, headcount int, num_dishes int, "
              "duration_hrs double, menu_profile string, is_festival_season boolean, experience_yrs int, "
              "num_burners int, lead_days int")
    return spark.createDataFrame([tuple(base.values())], schema)


def test_full_plan(spark):
    p = planning.plan_events(plan_input(spark)).first()
    # 5 x 11.5 x 1.2 x 1.12 x 0.952 x 1.2 x 1.4
    assert p["predicted_consumption_kg"] == pytest.approx(123.59, abs=0.011)
    assert p["cylinders_to_order"] == 8
    assert p["stockout_risk_pct"] == 0.0
    assert p["recommended_order_date"] == p["latest_safe_order_date"] == dt.date(2024, 11, 16)
    assert p["wastage_estimate_kg"] == pytest.approx(14.83, abs=0.011)
    assert p["estimated_cost_inr"] == 8 * 1910
    # 14.83 kg wasted and 16.41 kg over-ordered of 123.59 kg
    assert p["efficiency_score"] == pytest.approx(62.1)
    assert p["recommendation_tier"] == "AMBER"
    assert p["action_items"] == [fv.ACTION_WASTAGE % "wedding", fv.ACTION_FESTIVAL]
    assert p["optimization_notes"] == "Rule-based: 123.6kg | Final: 123.6kg"


def test_plan_defaults_for_unknown_menu_and_type(spark):
    p = planning.plan_events(plan_input(spark, menu_profile="?", event_type="?", is_festival_season=False, experience_yrs=10)).first()
    same = planning.plan_events(plan_input(spark, is_festival_season=False, experience_yrs=10)).first()
    assert p["predicted_consumption_kg"] == same["predicted_consumption_kg"]
    assert p["wastage_estimate_kg"] == pytest.approx(p["predicted_consumption_kg"] * 0.09 * 0.7, abs=0.006)
    assert p["action_items"] == [fv.ACTION_DEFAULT]


def test_novice_actions_in_order(spark):
    p = planning.plan_events(plan_input(spark, experience_yrs=2, headcount=501, event_type="birthday_party")).first()
    assert p["action_items"] == [fv.ACTION_NOVICE, fv.ACTION_WASTAGE % "birthday_party", fv.ACTION_FESTIVAL, fv.ACTION_LARGE]


def test_blending(spark):
    src = plan_input(spark).withColumn("ml", F.lit(100.0))
    p = planning.plan_events(src, ml_kg="ml").first()
    assert p["predicted_consumption_kg"] == pytest.approx(0.7 * 100 + 0.3 * 123.59, abs=0.02)
    assert p["optimization_notes"] == "Rule-based: 123.6kg | ML prediction: 100.0kg | Blended: 107.1kg"
    for v in (None, 0.0, -5.0):
        q = planning.plan_events(plan_input(spark).withColumn("ml", F.lit(v).cast("double")), ml_kg="ml").first()
        assert q["predicted_consumption_kg"] == pytest.approx(123.59, abs=0.011)


def test_batches(spark):
    ev = spark.createDataFrame(
        [(1, "a", dt.date(2024, 1, 1), 17.5), (2, "a", dt.date(2024, 1, 2), 18.0), (3, "b", dt.date(2024, 1, 1), 35.0)],
        "event_id long, batch string, event_date date, consumption_kg double",
    )
    budgets = spark.createDataFrame([("a", 3 * 1910.0), ("b", 3819.0), ("c", None)], "batch string, budget_inr double")
    t = {r["batch"]: r for r in planning.batch_totals(ev, "batch", budgets).collect()}
    assert (t["a"]["status"], t["a"]["total_cylinders"], t["a"]["total_cost_inr"], t["a"]["total_wastage_kg"]) == ("optimal", 3, 5730, 17.0)
    assert (t["b"]["status"], t["b"]["total_cylinders"]) == ("fallback", None)
    assert (t["c"]["status"], t["c"]["n_events"]) == ("no events", 0)
    rows = {r["event_id"]: r for r in planning.batch_procurement(ev, "batch", budgets).collect()}
    assert (rows[2]["cylinders_lp"], rows[2]["cylinders_rule"], rows[2]["lp_saving_pct"]) == (2, 2, 0.0)
    assert (rows[3]["cylinders_lp"], rows[3]["cylinders_rule"]) == (None, 2)
    zero = spark.createDataFrame([("a", 0.0)], "batch string, budget_inr double")
    assert planning.batch_totals(ev, "batch", zero).first()["status"] == "optimal"


def test_empty_summary(spark):
    empty = planning.plan_events(plan_input(spark).filter("event_id < 0"))
    r = planning.batch_summary(empty).first()
    assert (r["total_events"], r["total_cylinders"], r["avg_stockout_risk"], r["high_risk_events"]) == (0, None, None, 0)


def test_derived_columns_do_not_depend_on_partitioning(spark, sf_dir):
    from emberline.plans import views

    ev = views.events_view(spark, sf_dir)
    base = {tuple(r) for r in derive.derive_events(ev).select("event_id", "consumption_kg", "cylinders_ordered", "ran_out_of_gas").collect()}
    for n in (1, 7, 64):
        again = derive.derive_events(ev.repartition(n)).select("event_id", "consumption_kg", "cylinders_ordered", "ran_out_of_gas")
        assert {tuple(r) for r in again.collect()} == base


def test_shock_calendar(spark):
    df = spark.createDataFrame([(2020, 2), (2020, 3), (2020, 8), (2020, 9), (2021, 1), (2021, 6), (2021, 7)], "year int, month int")
    got = df.select(derive.shock_factor(), derive.shock_flag()).collect()
    assert [tuple(r) for r in got] == [(1.0, 0), (0.35, 1), (0.35, 1), (0.6, 1), (0.7, 1), (0.7, 1), (1.0, 0)]
