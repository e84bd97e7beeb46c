"""Delimited tables by header name, request documents without loss, batches, staging."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberline import fixed_values as fv
from emberline.operators import modelling, planning
from emberline.sources import staging, tables


def test_csv_by_header_name(spark, tmp_path):
    names = {n: h for h, n in fv.PRICE_SOURCE_HEADERS.items()}
    head = f'x, {names["commercial_price_inr"]} ,{names["date_str"]},"{names["domestic_price_inr"]}"'
    (tmp_path / "a.csv").write_text(head + '\n1,1800.5,01-Apr-20,900\n2,n/a,"02-Apr\n20",901\n')
    df = tables.read_table_csv(spark, str(tmp_path), tables.PRICE_SCHEMA, fv.PRICE_SOURCE_HEADERS, multi_line=True)
    rows = {r["domestic_price_inr"]: (r["date_str"], r["commercial_price_inr"]) for r in df.collect()}
    assert rows == {900.0: ("01-Apr-20", 1800.5), 901.0: ("02-Apr\n20", None)}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="no column"):
        tables.read_table_csv(spark, str(tmp_path / "b"), tables.PRICE_SCHEMA, fv.PRICE_SOURCE_HEADERS)


def test_requests_without_loss(spark):
    docs = [
        (1, '{"events": [{"headcount": 120, "event_date": "2024-11-20"}, {}]}'), (2, '{"events": [{"headcount": "many"}]}'),
        (3, "{nothing"), (4, '{"events": []}'), (5, '{"budget_inr": 5}'), (6, None), (7, '{"events": [{"headcount": 7.5}]}'),
    ]
    df = spark.createDataFrame(docs, "id int, body string")
    good = tables.ingest_requests(df, "body", ["id"]).collect()
    bad = {r["id"]: r["reason"] for r in tables.rejected_documents(df, "body", ["id"]).collect()}
    assert [(r["id"], r["headcount"]) for r in sorted(good, key=lambda r: r["position"])] == [(1, 120), (1, 300)]
    assert bad == {2: "malformed document", 3: "malformed document", 4: "no events", 5: "no events", 6: "no events", 7: "malformed document"}


def test_unlisted_batches_stay(spark):
    day = dt.date(2024, 1, 1)
    events = spark.createDataFrame([(1, "a", day, 20.0), (2, "b", day, 40.0), (3, None, day, 0.0)], "event_id int, batch string, event_date date, consumption_kg double")
    batches = spark.createDataFrame([("a", None), ("c", 10.0)], "batch string, budget_inr double")
    got = {r["event_id"]: (r["status"], r["cylinders_lp"], r["cylinders_rule"]) for r in planning.batch_procurement(events, "batch", batches).collect()}
    assert got == {1: ("optimal", 2, 2), 2: ("not listed", None, 3), 3: ("not listed", None, 1)}
    totals = {r["batch"]: (r["status"], r["total_cylinders"]) for r in planning.batch_totals(events, "batch").collect()}
    assert totals[None] == ("optimal", 1)


def test_copies_are_dealt_out(spark):
    df = spark.range(2500).select(F.col("id").alias("event_id"), (F.col("id") == 0).cast("int").alias("ran_out_of_gas"), F.lit(0.5).alias("x"))
    got = modelling.oversample(df, ["x"]).groupBy("event_id").agg(F.count("*").alias("n"), F.countDistinct("copy_no").alias("d"), F.max("copy_no").alias("m")).first()
    assert (got["event_id"], got["n"], got["d"], got["m"]) == (0, 1248, 1248, 1248)


def test_stages_live_in_the_warehouse_if_unset(spark, monkeypatch):
    assert staging.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "hdfs://x/wh"}.get(key, default)

    class Session:
        conf = Conf()

    assert staging.shared_dir(Session()) == "hdfs://x/wh/_stages"
