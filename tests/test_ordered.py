import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.operators import joins, metrics
from emberline.operators.ordered import median_table, ordered_position


@pytest.mark.parametrize("width", [1, 3, 50, 1 << 20])
def test_position_in_a_hot_group(spark, width):
    """One group holds most rows and most of its rows share a level."""
    rng = random.Random(width)
    rows = [
        (i, "hot" if i % 10 else f"g{i % 7}", 0 if rng.random() < 0.7 else rng.randint(1, 5), rng.randint(1, 9))
        for i in rng.sample(range(5000), 600)
    ]
    df = spark.createDataFrame(rows, "id long, k string, lvl int, w int").repartition(7)
    got = ordered_position(df, ["k"], F.col("lvl"), "id", F.col("w"), cell_width=width).toPandas()
    want = pd.DataFrame(rows, columns=["id", "k", "lvl", "w"]).sort_values(["k", "lvl", "id"])
    want["prefix"] = want.groupby("k").w.cumsum() - want.w
    want["group_total"] = want.groupby("k").w.transform("sum")
    cols = ["id", "k", "lvl", "w", "prefix", "group_total"]
    a = got[cols].sort_values("id").reset_index(drop=True).astype({"prefix": "int64", "group_total": "int64"})
    b = want[cols].sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


@pytest.mark.parametrize("accuracy", [4, 20, 10_000])
def test_exact_median(spark, accuracy):
    """Even with a coarse sketch the second pass finds the exact middle."""
    rng = np.random.default_rng(3)
    n = 2000
    pdf = pd.DataFrame(
        {
            "even": rng.normal(size=n),
            "ties": np.where(rng.random(n) < 0.4, 5.0, rng.integers(0, 10, n).astype(float)),
            "holes": np.where(rng.random(n) < 0.3, np.nan, rng.random(n)),
            "constant": 2.0,
        }
    )
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(5)
    got = {r["column_name"]: r["median"] for r in median_table(df, list(pdf.columns), accuracy).collect()}
    for c in pdf.columns:
        assert got[c] == pdf[c].median(), c


def test_median_of_few_and_no_values(spark):
    df = spark.createDataFrame([(1.0, None), (4.0, None)], "a double, b double")
    assert [tuple(r) for r in median_table(df, ["a", "b"]).collect()] == [("a", 2.5)]


def brute_auc(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y]
    neg = [s for y, s in zip(labels, scores) if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("places", [1, 2, 6])
def test_auc_with_ties(spark, places):
    rng = random.Random(places)
    rows = [(int(rng.random() < 0.3), 0.0) for _ in range(400)]
    rows = [(y, round(rng.random() * 0.7 + 0.3 * y, places)) for y, _ in rows]
    df = spark.createDataFrame(rows, "label int, score double").repartition(6)
    got = metrics.roc_auc(df).first()
    assert got["auc"] == pytest.approx(brute_auc(*zip(*rows)), abs=1e-6)
    assert got["n_pos"] + got["n_neg"] == 400


def test_auc_of_one_class_is_null(spark):
    assert metrics.roc_auc(spark.createDataFrame([(1, 0.5)], "label int, score double")).first()["auc"] is None


def test_report_on_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    rows = {r["row_name"]: r for r in metrics.classification_report(df).collect()}
    assert (rows["stockout"]["precision"], rows["stockout"]["recall"], rows["stockout"]["f1"]) == (0, 0, 0)
    assert rows["ok"]["f1"] == pytest.approx(0.8)
    assert rows["accuracy"]["precision"] == pytest.approx(0.6667)
    assert rows["macro avg"]["f1"] == pytest.approx(0.4)
    assert rows["weighted avg"]["f1"] == pytest.approx(0.5333)


def test_regression_metrics(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(1e6, 2.0, 500)
    p = y + rng.normal(0, 1, 500)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    got = metrics.regression_metrics(df, "y", "p", 10.0).first()
    assert got["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-5)
    assert got["mae"] == pytest.approx(abs(y - p).mean() * 10, abs=1e-5)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, p double")
    assert metrics.regression_metrics(flat, "y", "p").first()["r2"] is None
    gap = spark.createDataFrame([(float(i), float(i) + 1) for i in range(9)] + [(1e6, None), (None, 5.0)], "y double, p double")
    got = metrics.regression_metrics(gap, "y", "p").first()
    assert (got["n_rows"], got["r2"], got["mae"]) == (9, 0.85, 1.0)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("least", [20.0, 10_000.0, 0.0])
def test_dimension_join_salted_and_plain(spark, how, least):
    """A hot key stored together, and rows without a key."""
    key = F.when(F.col("id") < 170, 0).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 50)
    big = spark.range(500).select("id", key.alias("k")).repartitionByRange(5, "k")
    small = spark.range(0, 40, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = sorted(map(str, big.join(small, "k", how).collect()))
    got = joins.dimension_join(big, small, ["k"], how, salts=4, least=least)
    assert sorted(map(str, got.select(*big.join(small, "k", how).columns).collect())) == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_safe_join(spark, how):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") % 50).alias("k")).repartition(6)
    small = spark.range(0, 45).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = big.join(small, "k", how)
    got = joins.skew_safe_join(big, small, "k", hot=[7], how=how, salts=5)
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_hot_keys_are_found(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id")).alias("k"))
    assert joins.hot_keys(df, "k") == [1]
    assert joins.hot_keys(spark.range(100).toDF("k"), "k") == []
