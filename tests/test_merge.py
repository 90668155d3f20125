"""Merge goldens."""

import pytest
from pyspark.sql import functions as F

from splitclock.operators import facts, geometry, master, merge
from splitclock.schemas import LEGACY_RESULTS, STAGE_GEOMETRY
from splitclock.session import cut


def legacy(spark, rows):
    return spark.createDataFrame(rows, LEGACY_RESULTS)


def row(n, name, text, seconds, diff=0.0):
    return (f"171_ss1_{n}", "171", "Test Rally", 1, "SS1", 10.5, str(n), name, "", "Rally2", "Fabia", text, seconds, "", diff, "gravel")


@pytest.fixture(scope="module")
def merged(spark):
    old = merge.canonicalize_results(legacy(spark, [row(1, "Ada Türk", "10:00.0", 600.0), row(2, "Can Çukur", "10:10.0", 610.0)]), "seed")
    new = legacy(spark, [row(1, "Ada Türk", "10:00.0", 600.0), row(2, "Can Çukur", "10:11.0", 611.0), row(3, "Ege Yazıcı", "10:30.0", 630.0)])
    m = merge.merge_results(old, new.withColumn("seq", F.substring("result_id", -1, 1).cast("int")), "run1")
    m.merged = cut(m.merged)
    return m


def test_merge_results_golden(merged):
    log = merged.log.first()
    assert (log["incoming_rows"], log["inserted_rows"], log["skipped_rows"], log["conflict_rows"], log["incoming_duplicate_rows"]) == (3, 1, 1, 1, 0)
    assert [r["entity_key"] for r in merged.conflicts.collect()] == ["171_ss1_2"]
    rows = {r["result_id"]: r for r in merged.merged.collect()}
    assert len(rows) == 3
    third = rows["171_ss1_3"]
    assert (third["stage_id"], third["driver_id"], third["normalized_class"], third["class_position"]) == ("171_ss1", "drv_ege-yazici", "Rally2", 3)
    assert rows["171_ss1_2"]["time_seconds"] == 610.0
    assert master.build_drivers(merged.merged).count() == 3
    assert master.build_stages(merged.merged, master.build_rallies(merged.merged)).count() == 1


def test_second_merge_inserts_nothing(merged, spark):
    again = merged.merged.withColumn("seq", F.monotonically_increasing_id())
    log = merge.merge_results(merged.merged, again, "run2").log.first()
    assert (log["inserted_rows"], log["conflict_rows"], log["skipped_rows"]) == (0, 0, 3)


def test_in_batch_duplicates(spark):
    empty = merge.canonicalize_results(legacy(spark, []), "seed")
    a, b = row(1, "A B", "10:00.0", 600.0), row(1, "A B", "10:05.0", 605.0)
    batch = legacy(spark, [a, a, b]).withColumn("seq", F.monotonically_increasing_id())
    m = merge.merge_results(empty, batch, "r", recompute=False)
    log = m.log.first()
    assert (log["inserted_rows"], log["conflict_rows"], log["incoming_duplicate_rows"]) == (1, 1, 2)
    assert m.merged.first()["time_seconds"] == 600.0


def test_class_best_golden(spark):
    df = spark.createDataFrame(
        [("b", "Pilot A", "Rally2", 630.5), ("b", "Pilot B", "Rally2", 645.2), ("b", "Pilot C", "Rally2", 638.0), ("b", "Pilot D", "Rally3", 655.0), ("b", "Pilot E", "Rally3", 670.5), ("b", "Pilot F", "Rally2", 0.0)],
        "stage_id STRING, raw_driver_name STRING, normalized_class STRING, time_seconds DOUBLE",
    )
    got = {r["normalized_class"]: (r["class_best_time"], r["class_best_driver"], r["finisher_count"]) for r in facts.class_best(df).collect()}
    assert got == {"Rally2": (630.5, "Pilot A", 3), "Rally3": (655.0, "Pilot D", 2)}


GEO = "stage_id STRING, rally_id STRING, stage_number INT, stage_name STRING, surface STRING, distance_km DOUBLE, total_ascent DOUBLE, total_descent DOUBLE, max_grade DOUBLE, p95_curvature DOUBLE, hairpin_count INT, source_kml STRING, kml_file STRING, analysis_version STRING"


def geo(spark, kml, km=12.3, up=240.0, down=235.0, grade=9.5, p95=0.0123, hairpins=5):
    return spark.createDataFrame([("171_ss1", "171", 1, "SS1", "gravel", km, up, down, grade, p95, hairpins, kml, kml, "test_analyzer_v1")], GEO)


def counts(m):
    r = m.log.first()
    return tuple(r[f"{o}_rows"] for o in geometry.OUTCOMES)


def test_geometry_four_steps(spark):
    now = "2024-01-01T00:00:00"
    m1 = geometry.merge_geometry(spark.createDataFrame([], STAGE_GEOMETRY), geo(spark, "seed.kml"), "seed", now=now)
    assert counts(m1) == (1, 0, 0, 0)
    sparse = spark.createDataFrame([("171_ss1", "manual_review_v2")], "stage_id STRING, analysis_version STRING")
    m2 = geometry.merge_geometry(m1.merged, sparse, "sheet", now=now)
    assert counts(m2) == (0, 1, 0, 0)
    m3 = geometry.merge_geometry(m2.merged, geo(spark, "near_duplicate.kml", 12.31, 244.0, 239.0, 9.8, 0.01235), "near", now=now)
    assert counts(m3) == (0, 0, 1, 0)
    m4 = geometry.merge_geometry(m3.merged, geo(spark, "different.kml", 18.0, 40.0, 35.0, 2.0, 0.001, 0), "other", now=now)
    assert counts(m4) == (0, 0, 0, 1)
    r = m4.merged.first()
    assert (m4.merged.count(), r["surface"], r["source_kml"], r["distance_km"], r["analysis_version"]) == (1, "gravel", "near_duplicate.kml", 12.31, "test_analyzer_v1")
    assert m4.conflicts.count() == 1


def test_ordered_merge_equals_one_by_one(spark):
    now = "2024-01-01T00:00:00"
    steps = [geo(spark, "seed.kml"), geo(spark, "seed.kml"), geo(spark, "near_duplicate.kml", 12.31, 244.0), geo(spark, "different.kml", 18.0, 40.0, 35.0, 2.0, 0.001, 0)]
    batch = steps[0].withColumn("seq", F.lit(0))
    for i, s in enumerate(steps[1:], 1):
        batch = batch.unionByName(s.withColumn("seq", F.lit(i)))
    m = geometry.merge_geometry(spark.createDataFrame([], STAGE_GEOMETRY), batch, "all", order="seq", now=now)
    assert counts(m) == (1, 1, 1, 1)
    assert m.merged.first()["source_kml"] == "near_duplicate.kml"


def test_a_repeated_conflict_conflicts_again(spark):
    now = "2024-01-01T00:00:00"
    other = geo(spark, "different.kml", 18.0, 40.0, 35.0, 2.0, 0.001, 0)
    batch = geo(spark, "seed.kml").withColumn("seq", F.lit(0))
    for i, s in enumerate([other, other, geo(spark, "seed.kml"), geo(spark, "seed.kml"), other], 1):
        batch = batch.unionByName(s.withColumn("seq", F.lit(i)))
    m = geometry.merge_geometry(spark.createDataFrame([], STAGE_GEOMETRY), batch, "all", order="seq", now=now)
    assert counts(m) == (1, 2, 0, 3)
    assert m.conflicts.count() == 3 and m.merged.first()["source_kml"] == "seed.kml"


def test_row_without_stage_is_skipped(spark):
    bad = spark.createDataFrame([(None, None, 5.0)], "stage_id STRING, rally_id STRING, distance_km DOUBLE")
    m = geometry.merge_geometry(spark.createDataFrame([], STAGE_GEOMETRY), bad, "x")
    assert m.log.first()["skipped_rows"] == 1 and m.merged.count() == 0


RESULTS = "result_id string, rally_id string, rally_name string, stage_number int, stage_name string, driver_name string, car_class string, time_seconds double, seq int"


def results(rallies, drivers, seq=1, extra=0.0):
    return [
        (f"{r}_ss{s}_{d}", r, f"Rally {r}", s, f"SS{s}", f"Driver {d}", ["R2", "N", ""][d % 3], 500.0 + 13 * ((d * 7 + s) % 11) + extra, seq)
        for r in rallies for s in (1, 2) for d in drivers
    ]


DERIVED = ["result_id", "stage_id", "normalized_class", "driver_id", "status", "time_seconds", "ratio_to_class_best", "class_position"]


def shown(df):
    return sorted(tuple(r) for r in df.select(*DERIVED).collect())


def test_merge_of_a_small_batch_equals_the_full_one(spark, tmp_path):
    root = str(tmp_path / "table")
    old = results([f"r{k}" for k in range(12)], range(6))
    stray = ("r3_ss1_99", "r5", "Rally r5", 1, "SS1", "Driver 99", "R2", 490.0, 1)  # its id names another rally
    new = results(["r5", "r99"], [6, 7]) + [(*r[:7], r[7] + 1.0, 2) for r in results(["r7"], [1])] + results(["r8"], [2]) + [stray]
    frame = lambda rows: spark.createDataFrame(rows, RESULTS)
    base = merge.canonicalize_results(frame(old), "seed")
    merge.store_results(base, root, parts=16)
    full = merge.merge_results(base, frame(new), "run1")
    part = merge.merge_stored(spark, root, frame(new), "run1", parts=16)
    assert part.log.first() == full.log.first()
    assert shown(merge.stored_results(spark, root)) == shown(full.merged)
    assert sorted(r.entity_key for r in part.conflicts.collect()) == sorted(r.entity_key for r in full.conflicts.collect())
    # Another leader for r5's first stage reaches the stray row in the folder of r3.
    lead = [("r5_ss1_50", "r5", "Rally r5", 1, "SS1", "Driver 50", "R2", 400.0, 1)]
    merge.merge_stored(spark, root, frame(lead), "run2", parts=16)
    assert shown(merge.stored_results(spark, root)) == shown(merge.merge_results(full.merged, frame(lead), "run2").merged)
    before = shown(merge.stored_results(spark, root))
    again = merge.merge_stored(spark, root, frame(lead + new), "run3", parts=16)
    assert again.log.first()["inserted_rows"] == 0 and shown(merge.stored_results(spark, root)) == before


def test_merge_reads_and_writes_only_touched_folders(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = spark.createDataFrame(results([f"r{k}" for k in range(20)], range(5)), RESULTS)
    merge.store_results(merge.canonicalize_results(rows, "seed"), root, parts=64)
    touched = merge.stored_results(spark, root).where("rally_id = 'r4'").select("part").distinct().collect()
    assert len(touched) == 1
    mine = f"part={touched[0].part}"
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "table" / "results").rglob("*.parquet")}
    for p in files:
        if p.parent.name != mine:
            p.write_bytes(b"not to be read")
            files[p] = p.stat().st_mtime_ns
    batch = spark.createDataFrame(results(["r4"], [8]), RESULTS)
    log = merge.merge_stored(spark, root, batch, "run", parts=64).log.first()
    assert log["inserted_rows"] == 2
    left = {p: p.stat().st_mtime_ns for p in (tmp_path / "table" / "results").rglob("*.parquet")}
    others = {p: t for p, t in files.items() if p.parent.name != mine}
    assert {p: t for p, t in left.items() if p.parent.name != mine} == others
    assert not set(left) - set(others) & set(files)


def test_empty_batch_and_empty_table(spark, tmp_path):
    root = str(tmp_path / "table")
    none = spark.createDataFrame([], RESULTS)
    merge.store_results(merge.canonicalize_results(none, "seed"), root)
    assert merge.merge_stored(spark, root, none, "a").log.first()["incoming_rows"] == 0
    assert merge.merge_stored(spark, root, spark.createDataFrame(results([None, "r1"], [1]), RESULTS), "b").log.first()["inserted_rows"] == 4
    assert merge.stored_results(spark, root).count() == 4


def test_labels_and_reports_are_those_of_a_comparison_of_whole_rows(spark):
    """Rows meet by fingerprints: empty texts, blanks, NaN, negative zero and NULL count as in the comparison field by field."""
    base = results(["r1", "r2"], range(4))
    old = [(*r[:4], "" if i % 3 == 0 else r[4], *r[5:7], [float("nan"), -0.0, None, r[7]][i % 4], 1) for i, r in enumerate(base)]
    new = [(*r[:4], " " if i % 2 else r[4], *r[5:7], [float("nan"), 0.0, None, r[7] + i % 5][i % 4], 1) for i, r in enumerate(base)]
    new += [(*r[:8], 2) for r in new[:5]] + [(*r[:7], 9.0, 3) for r in new[3:8]] + results(["r3"], range(3)) + results(["r3"], [0, 1], 2, 1.0) + results(["r3"], [2], 1)
    frame = lambda rows: spark.createDataFrame(rows, RESULTS)
    known, batch = merge.canonicalize_results(frame(old), "seed"), merge.canonicalize_results(frame(new), "run", extra=("seq",))
    m = merge.merge_results(known, frame(new), "run", recompute=False)
    whole = merge.classify_incoming(known, batch, "seq")
    labels = lambda df: sorted(tuple(r) for r in df.select("result_id", "_seq", "repeated", "outcome").collect())
    assert labels(m.outcomes) == labels(whole) and len({r.outcome for r in whole.collect()}) == 4
    reports = lambda df: sorted(tuple(r) for r in df.select(*df.columns[-3:]).collect())
    expected = whole.where("outcome = 'conflict'").select("master_payload", "incoming_payload", "diff")
    assert reports(m.conflicts) == reports(expected)
    assert m.merged.count() == known.count() + whole.where("outcome = 'insert'").count()


def test_a_merge_writes_its_labels_and_not_the_rows_again(spark, monkeypatch):
    written = []
    real = merge.stored
    monkeypatch.setattr(merge, "stored", lambda df: written.append(df.columns) or real(df))
    frame = lambda rows: spark.createDataFrame(rows, RESULTS)
    merge.merge_results(merge.canonicalize_results(frame(results(["r1"], range(4))), "seed"), frame(results(["r1"], range(6))), "run", recompute=False)
    rows, labels = written
    assert "time_str" in rows and labels == ["result_id", "_seq", "repeated", "outcome", "_row"]
