"""Set-based shifting against the same rules applied one order at a time."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from emberline.operators import regional

AS_OF = "2024-11-01"
START = dt.date(2024, 11, 1)
SCHEMA = ("event_id long, dealer string, recommended_order_date date, latest_safe_order_date date, "
          "cylinders_to_order int, stockout_risk_pct double, optimization_notes string")


def make(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = START + dt.timedelta(rng.choice([-2, 0, 1, 2, 3, 3, 3, 3, 5, 28, 29, 30]))
        risk = rng.choice([0.0, 0.0, 0.0, 14.9, 15.0, 30.0, rng.randint(0, 990) / 10])
        rows.append((i, rng.choice("aaab"), day, day + dt.timedelta(rng.randint(0, 3)), rng.randint(1, 9), risk, "n"))
    return rows


def sequential(rows, cap, guard):
    moved = {}
    for dealer in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == dealer]
        day_sum = defaultdict(int)
        for r in mine:
            day_sum[r[2]] += r[4]
        for k in range(30):
            day = START + dt.timedelta(k)
            if not day_sum[day] > cap * 0.8:
                continue
            on_day = sorted((r for r in mine if moved.get(r[0], r[2]) == day and r[0] not in moved), key=lambda r: (r[5], r[0]))
            for r in on_day[: len(on_day) // 2]:
                new = r[2] - dt.timedelta(2 if r[5] < 15 else 1)
                if (new <= r[3]) if guard == "documented" else (new >= r[3]):
                    moved[r[0]] = new
    return moved


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("guard", ["documented", "reference"])
def test_shift_equals_sequential(spark, seed, guard):
    rows = make(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(1 + seed * 6)
    got = regional.shift_plan(df, AS_OF, 60, guard=guard).collect()
    want = sequential(rows, 60, guard)
    assert {r["event_id"]: r["recommended_order_date"] for r in got if r["shifted_days"]} == want
    assert bool(want) == (guard == "documented")
    assert len(got) == len(rows)
    assert sum(r["cylinders_to_order"] for r in got) == sum(r[4] for r in rows)
    for r in got:
        assert r["recommended_order_date"] <= r["latest_safe_order_date"]
        if r["shifted_days"]:
            assert r["optimization_notes"] == f"n | Shifted {r['shifted_days']}d earlier (demand smoothing)"


def test_exactly_eighty_percent_is_no_spike(spark):
    rows = [(1, "a", START, START, 80, 0.0, ""), (2, "a", START + dt.timedelta(1), START, 81, 0.0, "")]
    curve = regional.demand_curve_full(spark.createDataFrame(rows, SCHEMA), AS_OF, 100)
    assert [r["date"] for r in curve.filter("spike_flag").collect()] == [START + dt.timedelta(1)]


def test_curve_edges(spark):
    rows = [(1, "a", START, START, 3, 0.0, ""), (2, "a", START + dt.timedelta(29), START, 6, 0.0, ""),
            (3, "a", START + dt.timedelta(30), START, 9, 0.0, ""), (4, "a", START - dt.timedelta(1), START, 9, 0.0, ""),
            (5, "b", START - dt.timedelta(9), START, 9, 0.0, "")]
    curve = regional.demand_curve_full(spark.createDataFrame(rows, SCHEMA), AS_OF, 100).orderBy("dealer", "date").collect()
    assert len(curve) == 60
    a = curve[:30]
    assert [r["raw_demand"] for r in a] == [3] + [0] * 28 + [6]
    assert (a[0]["smoothed_demand"], a[1]["smoothed_demand"], a[29]["smoothed_demand"]) == (1.5, 1.0, 3.0)
    assert [r["is_weekend"] for r in a[:4]] == [False, True, True, False]
    assert all(r["raw_demand"] == 0 for r in curve[30:])


def test_delivery_cap_order(spark):
    rows = [(1, "a", START, START, 5, 10.0, ""), (2, "a", START, START, 5, 30.0, ""), (3, "a", START, START, 5, 10.0, "")]
    got = {r["event_id"]: r for r in regional.delivery_cap(spark.createDataFrame(rows, SCHEMA), 10).collect()}
    assert {k: r["running_cylinders"] for k, r in got.items()} == {2: 5, 1: 10, 3: 15}
    assert [got[k]["within_cap"] for k in (1, 2, 3)] == [1, 1, 0]
    assert all(r["day_over_cap"] == 1 for r in got.values())


def test_wrong_guard_is_refused(spark):
    with pytest.raises(ValueError):
        regional.shift_plan(spark.createDataFrame([], SCHEMA), AS_OF, 10, guard="none")
