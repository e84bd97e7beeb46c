"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS
(default 8) the local cores.  Each query is planned and run once to a no-op
sink, so every column is computed; the staged tables are timed where they are
first needed, under their own names.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from emberline.plans import modelling_queries as mq  # noqa: E402
from emberline.plans import views as v  # noqa: E402
from emberline.plans.registry import QUERIES  # noqa: E402
from emberline.session import JAVA_OPTIONS, build_session  # noqa: E402

HEADLINE = [
    "plan_events_o11", "profile_join_j7", "price_lookup_j2", "gas_rate_t1", "menu_profile_t3",
    "gas_by_profile_a2", "mean_rate_by_type_a1", "interpolate_linear_w1", "derive_stockout_v6",
    "clean_report_p2", "median_e3", "min_max_scale_e4", "dataset_checks_q2", "correlations_a18",
    "dataset_summary_a5", "share_of_a6", "roc_auc_a16", "regression_metrics_a17",
    "blended_plan_o11", "batch_procurement_o12", "delivery_cap_o13", "caterer_rollup_a19",
    "demand_curve_r1", "shift_plan_r3", "smoothed_curve_r4", "regional_forecast_r5",
    "oversample_m4", "ingest_requests_s6", "write_stage_s3", "batch_scoring_m7",
    "predict_and_plan_m7",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        int(cpus),
        {
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.extraJavaOptions": JAVA_OPTIONS,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t, 3)
        print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr, flush=True)

    timed("stage_event_table", lambda: v.event_table(spark, sf_dir))
    timed("stage_feature_table", lambda: v.feature_table(spark, sf_dir))
    timed("stage_plan_table", lambda: v.plan_table(spark, sf_dir))
    timed("stage_normalised", lambda: v.normalised(spark, sf_dir))
    timed("train_five_models", lambda: mq.trained(spark, sf_dir))
    timed("train_serving_models", lambda: mq.serving_models(spark, sf_dir))
    for name in HEADLINE:
        timed(
            name,
            lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save(),
        )
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
