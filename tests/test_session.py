"""Settings the queries need, whatever session they get."""

from emberline.plans import views as v
from emberline.session import METHOD_LIMIT, keep_methods_small


def test_long_methods_are_not_interpreted(spark, sf_dir):
    before = spark.conf.get(METHOD_LIMIT)
    try:
        spark.conf.unset(METHOD_LIMIT)
        rows = v.events_with_menu(spark, sf_dir).count()
        assert int(spark.conf.get(METHOD_LIMIT)) <= 8000 and rows > 0
        spark.conf.set(METHOD_LIMIT, "20000")  # the owner's choice
        keep_methods_small(spark)
        assert spark.conf.get(METHOD_LIMIT) == "20000"
    finally:
        spark.conf.set(METHOD_LIMIT, before)
