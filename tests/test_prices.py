import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline import fixed_values as fv
from emberline.operators import prices
from emberline.sources import tables


def test_reference_series(spark):
    got = {r["date"].isoformat(): r for r in prices.reference_series(spark).collect()}
    assert len(got) == 72
    first, second, third = got["2018-04-01"], got["2018-05-01"], got["2018-06-01"]
    assert first["commercial_price_inr"] == 1176.5
    assert (first["price_lag1"], first["price_lag2"], first["price_mom_change"]) == (None, None, 0.0)
    assert second["commercial_price_inr"] == 1187.25
    assert (second["price_lag1"], second["price_lag2"]) == (1176.5, None)
    assert (third["price_lag1"], third["price_lag2"]) == (1187.25, 1176.5)
    assert got["2019-05-01"]["commercial_price_inr"] == pytest.approx(1303.8333333333333, abs=1e-9)
    assert got["2019-05-01"]["price_mom_change"] == pytest.approx(-1.6666666666667425, abs=1e-9)
    assert got["2024-03-01"]["commercial_price_inr"] == 2028.0


def test_series_equals_pandas_interpolation(spark):
    anchors = pd.Series(
        [p for _, p in fv.PRICE_ANCHORS],
        index=pd.to_datetime([d for d, _ in fv.PRICE_ANCHORS], format="%d-%b-%y"),
    )
    want = anchors.reindex(pd.date_range(*fv.PRICE_GRID, freq="MS")).interpolate("linear").ffill().bfill()
    got = prices.reference_series(spark).orderBy("date").toPandas()["commercial_price_inr"]
    assert got.tolist() == pytest.approx(want.tolist(), abs=1e-9)


def test_leading_and_trailing_gaps(spark):
    rows = [("a", "2020-03-01", 10.0), ("a", "2020-05-01", 20.0), ("b", "2020-04-01", 7.0)]
    df = spark.createDataFrame(rows, "series string, d string, p double").select(
        "series", F.to_date("d").alias("date"), F.col("p").alias("commercial_price_inr")
    )
    s = prices.monthly_series(df, ("series",), "2020-01-01", "2020-07-01")
    got = {k: [r["commercial_price_inr"] for r in s.filter(F.col("series") == k).orderBy("date").collect()] for k in "ab"}
    assert got["a"] == [10, 10, 10, 15, 20, 20, 20]
    assert got["b"] == [7] * 7


def test_lookup_tells_a_missing_month_from_a_missing_lag(spark):
    ev = spark.createDataFrame([(1, 2018, 3), (2, 2018, 4), (3, 2018, 6)], "event_id int, year int, month int")
    got = {r["event_id"]: r for r in prices.price_lookup(ev, prices.reference_series(spark)).collect()}
    assert (got[1]["commercial_price_inr"], got[1]["price_lag1_inr"]) == (1500.0, 1480.0)
    assert (got[2]["commercial_price_inr"], got[2]["price_lag1_inr"]) == (1176.5, None)
    assert (got[3]["price_lag1_inr"], got[3]["price_lag2_inr"]) == (1187.25, 1176.5)


def test_csv_source_with_blanks_in_the_header(spark, tmp_path):
    header = ",".join(f" {h} " for h in fv.PRICE_SOURCE_HEADERS)
    (tmp_path / "p.csv").write_text(header + "\r\n01-Apr-18,653.5,1176.5\r\nsoon,1,2\r\n31-Dec-99,1,2\r\n")
    df = tables.read_table_csv(spark, str(tmp_path / "p.csv"), tables.PRICE_SCHEMA, fv.PRICE_SOURCE_HEADERS)
    assert df.columns == ["date_str", "domestic_price_inr", "commercial_price_inr"]
    got = sorted((r["date"].isoformat(), r["commercial_price_inr"]) for r in tables.parse_date_lenient(df, "date_str").collect())
    assert got == [("1999-12-31", 2.0), ("2018-04-01", 1176.5)]
