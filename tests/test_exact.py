"""Order statistics, vocabularies, cross products and dependence, at sizes and ids of any kind."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.operators import features, ordered, quality


@pytest.mark.parametrize("spread", [1, 1 << 40, -(1 << 50)])
def test_cells_of_sparse_ids(spark, spread):
    """Ids of any spacing fill cells evenly, and positions are right."""
    rng = np.random.default_rng(5)
    n = 4000
    ids = np.cumsum(rng.integers(1, 50, n)).astype(np.int64) * spread
    ids[:3000] = ids[0] + np.arange(3000) * np.sign(spread)  # a dense stretch among sparse ones
    pdf = pd.DataFrame({"id": np.unique(ids)})
    pdf["k"] = np.where(rng.random(len(pdf)) < 0.8, "hot", "cold")
    pdf["lvl"], pdf["w"] = rng.integers(0, 3, len(pdf)), rng.integers(1, 9, len(pdf))
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(6)
    sizes = [r["count"] for r in ordered.id_bins(df, "id", 100).groupBy("_cell").count().collect()]
    assert max(sizes) <= 130 and len(sizes) > len(pdf) / 130
    got = ordered.ordered_position(df, ["k"], F.col("lvl"), "id", F.col("w"), cell_rows=100).toPandas()
    want = pdf.sort_values(["k", "lvl", "id"])
    want["prefix"] = want.groupby("k").w.cumsum() - want.w
    merged = got.merge(want, on="id", suffixes=("", "_want"))
    assert len(merged) == len(pdf) and (merged.prefix == merged.prefix_want).all()


def test_medians_narrow_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(ordered, "MIDDLE_VALUES", 20)
    rng = np.random.default_rng(8)
    n = 5001
    pdf = pd.DataFrame({
        "wide": rng.normal(size=n) * 1e9, "ties": np.where(rng.random(n) < 0.8, 3.0, rng.random(n)),
        "ends": np.where(np.arange(n) % 2 == 0, 0.0, 1.0) + np.where(rng.random(n) < 0.02, rng.random(n) / 2, 0),
        "holes": np.where(rng.random(n) < 0.6, np.nan, rng.random(n)), "nothing": np.nan,
    })
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(5)
    for accuracy in (10, 100, 10_000):
        got = {r["column_name"]: r["median"] for r in ordered.median_table(df, list(pdf.columns), accuracy).collect()}
        assert got == {c: pdf[c].median() for c in ("wide", "ties", "ends", "holes")}


def test_a_hundred_thousand_classes(spark):
    n = 100_000
    df = spark.range(n + 3000).select(
        F.col("id").alias("event_id"), F.md5((F.col("id") % n).cast("string")).alias("name"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise("é").alias("kind"),
    )
    vocabulary = features.fit_vocabulary(df, ["name", "kind"])
    values = vocabulary.toPandas()
    for c in ("name", "kind"):
        part = values[values.column_name == c].sort_values("value", key=lambda s: s.map(lambda v: v.encode()))
        assert part.code.tolist() == list(range(len(part)))
    assert (values.column_name == "name").sum() == n
    new = spark.createDataFrame([(1, None), (2, "hot"), (3, "never seen")], "event_id long, kind string")
    got = {r["event_id"]: r["kind_enc"] for r in features.encode_by_vocabulary(new, vocabulary, ["kind"]).collect()}
    assert got == {1: 1, 2: 0, 3: features.UNKNOWN_CLASS}  # hot < nan < é
    whole = features.encode_by_vocabulary(df, vocabulary, ["name", "kind"])
    assert whole.count() == n + 3000 and whole.filter("name_enc < 0 or kind_enc < 0").count() == 0


def test_vocabulary_of_nothing(spark):
    df = spark.createDataFrame([], "event_id long, kind string")
    assert features.fit_vocabulary(df, ["kind"]).count() == 0


def test_cross_products(spark):
    rng = np.random.default_rng(2)
    n = 3000
    pdf = pd.DataFrame({"a": rng.normal(1e6, 1, n), "b": rng.random(n), "c": 4.0, "y": rng.random(n), "z": rng.normal(size=n)})
    pdf["b"] += pdf.y
    pdf.loc[rng.random(n) < 0.3, "a"] = np.nan
    pdf.loc[rng.random(n) < 0.2, "y"] = np.nan
    pdf["nothing"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(7)
    got = {(r["left"], r["right"]): r for r in quality.cross_products(df, ["a", "b", "c", "nothing"], ["y", "z"]).collect()}
    for (x, y), r in got.items():
        both = pdf[[x, y]].dropna()
        assert r["n"] == len(both)
        if len(both):
            assert r["mx"] == pytest.approx(both[x].mean()) and r["yy"] == pytest.approx(both[y].var(ddof=0) * len(both))
            assert r["xy"] == pytest.approx(((both[x] - both[x].mean()) * (both[y] - both[y].mean())).sum(), abs=1e-6)
    corr = {(r["target"], r["feature"]): r["correlation"] for r in quality.all_correlations(df, ["a", "b", "c", "nothing"], ["y", "z"]).collect()}
    for (y, x), r in corr.items():
        want = None if x in ("c", "nothing") else pdf[x].corr(pdf[y])
        assert r is None if want is None else r == pytest.approx(want, abs=1e-6)
    empty = quality.all_correlations(df.limit(0), ["a"], ["y"]).collect()
    assert [tuple(r) for r in empty] == [("y", "a", None)]


def test_leaks_are_found(spark):
    """A quotient of the target is found with the column it was divided by; strong but noisy features are not."""
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({"heads": rng.integers(10, 900, n), "burners": rng.integers(1, 20, n), "dishes": rng.integers(2, 9, n)})
    pdf["kg"] = pdf.heads * pdf.dishes * 0.01 * rng.uniform(0.9, 1.1, n)
    pdf["per_head"] = (pdf.kg / pdf.heads).round(4)
    pdf["per_burner"] = (pdf.kg / pdf.burners).round(4)
    pdf["load"] = pdf.dishes * 0.01
    pdf["zero"] = 0.0
    found = quality.dependent_features(
        spark.createDataFrame(pdf), ["heads", "burners", "dishes", "load", "per_head", "per_burner", "zero"], "kg", ["heads", "burners"]
    ).collect()
    assert {r["feature"] for r in found if r["follows"]} == {"per_head", "per_burner"}
    strength = {r["feature"]: r["explained"] for r in found}
    assert 0.9 < strength["load"] < 0.9995 and 0 <= strength["zero"] < 0.99


def test_statistics_read_new_files_only(spark, tmp_path):
    from emberline.sources.statistics import column_statistics, data_files, unseen_files

    path = str(tmp_path / "t")
    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.when(F.col("id") > 4, F.col("id").cast("double")).alias("a"), F.lit(None).cast("double").alias("b"))
    df.filter("id < 60").repartition(3).write.partitionBy("k").parquet(path)
    first = data_files(spark, path)
    assert unseen_files(spark, path, ["a", "b"]) == first
    rows = lambda: sorted(map(tuple, column_statistics(spark, path, ["a", "b"]).collect()))
    assert rows() == [("a", 55, 5.0, 59.0), ("b", 0, None, None)]
    assert unseen_files(spark, path, ["a", "b"]) == []
    df.filter("id >= 60").write.mode("append").partitionBy("k").parquet(path)
    new = unseen_files(spark, path, ["a", "b"])
    assert new and not set(new) & set(first)
    assert rows() == [("a", 95, 5.0, 99.0), ("b", 0, None, None)]
    assert spark.read.parquet(path).count() == 100  # what is kept beside the table is not part of it
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
    assert rows() == [("a", 0, None, None), ("b", 0, None, None)]
