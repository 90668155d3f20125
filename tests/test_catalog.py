"""Named queries against their check SQL on the smallest tables. A selection by default; all with SPLITCLOCK_ALL=1."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SELECTION = ["class_best", "anomaly_tags", "merge_results", "stream_dedup", "regression_metrics", "rank_agreement", "steward_estimate", "read_results", "predict_live", "path_features", "stream_class_best", "html_results_rows", "similar_stages", "contains_match", "history_reference_pace"]
NAMES = list(entry.queries()) if os.environ.get("SPLITCLOCK_ALL") else SELECTION


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tiny, name):
    _, rows, verdict = compare(spark, connect(tiny), name, entry.queries()[name], entry.oracle_sql().get(name), tiny)
    assert verdict == ("ok" if name in entry.oracle_sql() else "rows-only") and rows > 0, verdict


#: Table scans in the final plan, where the rows of a plan are written once before.
SCANS = {"training_set_trainer": 5, "training_set_profiles": 10, "predict_notional": 5, "predict_live": 6, "regression_metrics": 6, "rank_agreement": 6, "path_features": 8, "grade_features": 8, "sparse_elevation": 8}


@pytest.mark.parametrize("name", list(SCANS))
def test_plans_do_not_recompute_their_facts(spark, tiny, name):
    plan = entry.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("FileScan parquet") <= SCANS[name]


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
