import json

from pyspark.sql import functions as F

from emberline.streaming import requests


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    docs = [
        {"request_id": i, "place": "Chennai" if i % 2 else None, "events": [
            {"event_date": "2024-11-20", "headcount": 100 + i, "experience_yrs": i % 12 + 1},
            {"event_date": "2024-12-01", "headcount": 9 if i % 5 == 0 else 50},
        ]}
        for i in range(20)
    ]
    docs += [{"request_id": 20, "events": []}, {"request_id": 21, "events": [{"headcount": "many", "event_date": "2024-11-20"}]}]
    for part in range(4):
        (src / f"{part}.json").write_text("\n".join(json.dumps(d) for d in docs[part::4]))
    plans, rejected = requests.plan_requests(requests.read_request_files(spark, str(src), 2))
    for df, name in ((plans, "plans"), (rejected, "rejected")):
        requests.write_stream(df, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")).awaitTermination(120)
    batch_plans, batch_rejected = requests.plan_requests(spark.read.schema(requests.DOCUMENT_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(str(src)))
    got = spark.read.parquet(str(tmp_path / "plans"))
    assert sorted(map(str, got.select(*batch_plans.columns).collect())) == sorted(map(str, batch_plans.collect()))
    assert got.count() == 36
    bad = spark.read.parquet(str(tmp_path / "rejected"))
    assert sorted(map(str, bad.select(*batch_rejected.columns).collect())) == sorted(map(str, batch_rejected.collect()))
    assert {r["reasons"][0] for r in bad.collect() if r["position"] is None} == {"no events", "malformed document"}
    assert bad.count() == 6
    assert bad.filter(F.col("reasons")[0] == "headcount out of range").count() == 4
    lead = got.filter("position = 1").groupBy("request_id").agg(F.first("latest_safe_order_date").alias("d"))
    days = {r["d"].isoformat() for r in lead.collect()}
    assert days == {"2024-11-29", "2024-11-27"}
