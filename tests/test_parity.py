"""Every query with a DuckDB statement, compared value by value."""

import pytest
from parity import compare, duck

from emberline.plans.oracle import SQL
from emberline.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_same_as_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


@pytest.mark.parametrize(
    "name",
    ["plan_events_o11", "rate_lookup_j5", "delivery_cap_o13", "shift_plan_r3", "duplicate_rows_q2",
     "batch_procurement_o12", "smoothed_curve_r4", "interpolate_linear_w1", "roc_auc_a16"],
)
def test_same_without_broadcast(spark, sf_dir, con, name):
    """Sort-merge joins give the same rows as broadcast joins."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        assert compare(QUERIES[name](spark, sf_dir), con, SQL[name]) is None
    finally:
        spark.conf.set(key, old)


def test_every_statement_has_a_query():
    assert not set(SQL) - set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
