"""A preparation fitted once and applied to rows it has not seen."""

from emberline.operators import features as ft

SCHEMA = "event_id long, event_type string, size string, headcount double, price double, consumption_kg double"


def test_new_request_takes_the_fitted_values(spark):
    train = spark.createDataFrame(
        [(i, "wedding" if i % 2 else "birthday_party", "small" if i < 5 else "large", 10.0 * i, None if i == 3 else float(i), 2.0 * i) for i in range(11)],
        SCHEMA,
    )
    fitted = ft.fit_preparation(train, ft.fit_label_classes(train, ["event_type", "size"]))
    prepared = ft.apply_preparation(train, fitted)
    assert prepared.agg({"headcount": "min"}).first()[0] == 0.0 and prepared.agg({"headcount": "max"}).first()[0] == 1.0
    new = spark.createDataFrame([(99, "wedding", "huge", 50.0, None), (98, None, "large", None, 20.0)], "event_id long, event_type string, size string, headcount double, price double")
    rows = {r["event_id"]: r for r in ft.apply_preparation(new, fitted).collect()}
    assert rows[99]["headcount"] == 0.5 and rows[99]["size_enc"] == ft.UNKNOWN_CLASS and rows[99]["event_type_enc"] == 1
    assert rows[99]["price"] == fitted["medians"]["price"] / 10.0
    assert rows[98]["headcount"] == 0.5 and rows[98]["price"] == 2.0 and "consumption_kg" not in rows[98]
    assert ft.normalise(train, fitted["classes"])[0].columns == prepared.columns
