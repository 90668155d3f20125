"""Micro-batches in any order of time."""

import random

from pyspark.sql import functions as F

from splitclock.operators.history import live_momentum
from splitclock.streaming import live

SCHEMA = "result_id string, rally_id string, time_seconds double, sent_at timestamp"


def feed(spark, path, rows):
    df = spark.createDataFrame(rows, "result_id string, rally_id string, time_seconds double, sent_at string")
    df.withColumn("sent_at", F.to_timestamp("sent_at")).coalesce(1).write.mode("append").parquet(path)


def test_dedup_loses_no_late_result_and_remembers_every_id(spark, tmp_path):
    path = str(tmp_path)
    schema = spark.createDataFrame([], SCHEMA).schema
    batches = [
        [("a", "r1", 1.0, "2024-05-02 10:00:00"), ("b", "r1", 2.0, "2024-05-02 10:00:00"), ("a", "r1", 1.0, "2024-05-02 10:00:00")],
        [("late", "r2", 3.0, "2024-05-01 09:00:00"), ("a", "r1", 1.0, "2024-05-02 10:01:00")],
        [("z", "r1", 4.0, "2024-05-03 23:00:00"), ("b", "r1", 2.0, "2024-05-04 23:00:00"), ("late", "r2", 3.0, "2024-05-01 09:00:00")],
    ]
    for rows in batches:
        feed(spark, f"{path}/in", rows)
        live.stream_dedup(live.stream_results(spark, f"{path}/in", schema, "parquet"), f"{path}/out", f"{path}/state").awaitTermination()
    assert sorted(r.result_id for r in spark.read.schema(schema).parquet(f"{path}/out").collect()) == ["a", "b", "late", "z"]


def test_a_batch_without_results_is_fine(spark, tmp_path):
    path = str(tmp_path)
    schema = spark.createDataFrame([], SCHEMA).schema
    for rows in ([("x", "r1", 0.0, "2024-05-02 10:00:00")], [("x", "r1", 5.0, "2024-05-02 10:00:00")]):
        feed(spark, f"{path}/in", rows)
        live.stream_dedup(live.stream_results(spark, f"{path}/in", schema, "parquet"), f"{path}/out", f"{path}/state").awaitTermination()
    assert [r.result_id for r in spark.read.schema(schema).parquet(f"{path}/out").collect()] == ["x"]


def test_dedup_needs_no_rally(spark, tmp_path):
    """Ids without a rally, ids sent again under another rally, and an id that changes from no rally to one."""
    path = str(tmp_path)
    schema = spark.createDataFrame([], SCHEMA).schema
    batches = [
        [("a", None, 1.0, "2024-05-02 10:00:00"), ("m", "r1", 1.0, "2024-05-02 10:00:00")],
        [("a", None, 1.0, "2024-05-02 10:00:00"), ("b", None, 2.0, "2024-05-02 10:00:00"), ("m", "r2", 1.0, "2024-05-02 10:00:00")],
        [("b", "r1", 2.0, "2024-05-02 10:00:00"), ("a", "r9", 1.0, "2024-05-02 10:00:00")],
    ]
    for rows in batches:
        feed(spark, f"{path}/in", rows)
        live.stream_dedup(live.stream_results(spark, f"{path}/in", schema, "parquet"), f"{path}/out", f"{path}/state").awaitTermination()
    assert sorted(r.result_id for r in spark.read.schema(schema).parquet(f"{path}/out").collect()) == ["a", "b", "m"]


LIVE = "result_id string, rally_id string, stage_id string, stage_number int, driver_id string, car_class string, time_seconds double, revision int"


def live_rows():
    rng = random.Random(5)
    rows = []
    for rally in ("r1", "r2", None):
        for stage in range(1, 6):
            for driver in range(12):
                if rng.random() < 0.85:
                    rows.append((f"{rally}_{stage}_{driver}", rally, f"{rally}_ss{stage}", stage, f"d{driver}", ["A", "B", None][driver % 3], rng.randrange(300, 330) / 1.0, 2))
    earlier = [(*r[:5], "A", r[6] + rng.choice([-40, 25]), 1) for r in rows if rng.random() < 0.4]  # other times, and another class
    return rows, earlier


def test_momentum_after_ten_batches_in_no_order(spark, tmp_path):
    path = str(tmp_path)
    final, earlier = live_rows()
    mixed = final + earlier + final[::7]
    random.Random(6).shuffle(mixed)
    schema = spark.createDataFrame([], LIVE).schema
    baselines = spark.createDataFrame([(f"d{k}", 1.05) for k in range(11)], "driver_id string, baseline_ratio double")
    read = []
    for k in range(10):
        spark.createDataFrame(mixed[k::10], LIVE).coalesce(1).write.mode("append").parquet(f"{path}/in")
        rows = live.stream_results(spark, f"{path}/in", schema, "parquet")
        query = live.stream_momentum(rows, baselines, f"{path}/out", f"{path}/state", "revision")
        query.awaitTermination()
        read.append(query.lastProgress.numInputRows)
    out = spark.read.parquet(f"{path}/out/form")
    newest = out.groupBy("driver_id", "rally_id").agg(F.max_by(F.struct("rally_avg", "stages_analyzed", "momentum", "momentum_status", "position_trend"), "batch_id").alias("f"))
    got = {(r.driver_id, r.rally_id): (round(r.rally_avg, 9), r.stages_analyzed, round(r.momentum, 9), r.momentum_status, r.position_trend) for r in newest.select("driver_id", "rally_id", "f.*").collect()}
    # Written once and worked out anew from all final rows; classes and rallies that are missing are given a name there.
    whole = spark.createDataFrame([tuple("-" if v is None else v for v in r) for r in final], LIVE).withColumn("normalized_class", F.col("car_class"))
    want = {(r.driver_id, None if r.rally_id == "-" else r.rally_id): (round(r.rally_avg, 9), r.stages_analyzed, round(r.momentum, 9), r.momentum_status, r.position_trend) for r in live_momentum(whole, baselines).collect()}
    assert got == want and len(got) == 33
    changes = spark.read.parquet(f"{path}/out/changes").count()
    assert sum(read) == changes  # the second stream read every change once, and nothing of earlier batches


def test_an_older_revision_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    schema = spark.createDataFrame([], LIVE).schema
    baselines = spark.createDataFrame([("d1", 1.0), ("d2", 1.0)], "driver_id string, baseline_ratio double")
    batches = [[("x", None, "s1", 1, "d1", "A", 100.0, 2), ("y", None, "s1", 1, "d2", "A", 110.0, 1)], [("x", None, "s1", 1, "d1", "A", 50.0, 1)], [("y", None, "s1", 1, "d2", "A", 80.0, 2)]]
    for rows in batches:
        spark.createDataFrame(rows, LIVE).coalesce(1).write.mode("append").parquet(f"{path}/in")
        live.stream_momentum(live.stream_results(spark, f"{path}/in", schema, "parquet"), baselines, f"{path}/out", f"{path}/state", "revision").awaitTermination()
    changes = sorted((r.version, r.result_id, r.ratio_to_class_best, r.class_position) for r in spark.read.parquet(f"{path}/out/changes").collect())
    assert changes == [(0, "x", 1.0, 1), (0, "y", 1.1, 2), (1, "x", 1.25, 2), (1, "y", 1.0, 1)]


def test_log_is_merged_on_read_and_compacted(spark, tmp_path):
    root = str(tmp_path)
    schema = "prediction_id long, stage_id string, comparison_status string, predicted_time double, part int"
    batches = [
        [(1, "s2", "pending", 10.0, 0), (2, "s2", "pending", 11.0, 0), (3, "s9", "pending", 5.0, 1)],
        [(1, "s2", "matched", 10.0, 0), (3, "s9", "pending", 6.0, 1)],
        [(1, "s2", "pending", 99.0, 0), (2, "s2", "actual_missing", 11.0, 0)],
    ]
    want = [{(1, "pending", 10.0), (2, "pending", 11.0), (3, "pending", 5.0)}, {(1, "matched", 10.0), (2, "pending", 11.0), (3, "pending", 6.0)}, {(1, "matched", 10.0), (2, "actual_missing", 11.0), (3, "pending", 6.0)}]
    shown = lambda df: {(r.prediction_id, r.comparison_status, r.predicted_time) for r in df.collect()}
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.partitionBy("part").parquet(f"{root}/log/batch={n}")
        assert shown(live.newest_log(spark, root)) == want[n]
        if n == 1:
            assert live.compact_log(spark, root) == 1
    assert shown(live.compacted_log(spark, root, 1)) == want[2]
    assert spark.read.parquet(f"{root}/log-1").count() == 3
