"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from splitclock import catalog
from splitclock.session import local_session

HEADLINES = [
    "ratio_to_class_best", "class_position", "anomaly_tags", "history_overall", "history_short_stage", "recency_weighted_baseline", "rally_momentum",
    "surface_profile", "geometry_profile", "history_reference_pace", "resample_path", "path_features", "merge_results", "build_stages", "predict_live",
    "predict_notional", "compare_predictions", "issue_worklist", "v1_feature_matrix", "training_set_trainer", "html_results_rows",
]
#: Measured too, and not part of the total, which stays comparable from round to round.
MORE = ["similar_stages", "regression_metrics", "simplify_rdp", "stream_dedup", "stream_momentum"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    # One small query warms the JVM up, as a running service would be.
    queries["class_best"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took, rows = {}, {}
    for name in [*HEADLINES, *MORE]:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    live = took["predict_live"]
    requests = queries["driver_stage_count"](spark, sf_dir).count()
    rows["predict_live_requests"] = requests
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(took[name] for name in HEADLINES), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "predictions_per_sec": round(requests / live, 1), **rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
