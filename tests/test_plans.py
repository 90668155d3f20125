"""Goldens of the prediction loop, the steward estimate and nearest stages."""

import random

import pytest
from pyspark.sql import functions as F

from splitclock.operators import aggregates, lookups, simplify
from splitclock.plans import quality


def test_comparison_golden(spark):
    log = spark.createDataFrame([(1, "171", "171_ss1", "d", 600.0, "pending"), (2, "171", "171_ss2", "d", 600.0, "pending")], "prediction_id BIGINT, rally_id STRING, stage_id STRING, driver_id STRING, predicted_time DOUBLE, comparison_status STRING")
    actual = spark.createDataFrame([("171", "171_ss1", "d", 605.0)], "rally_id STRING, stage_id STRING, driver_id STRING, time_seconds DOUBLE")
    got = {r["prediction_id"]: r for r in lookups.compare_predictions(log, actual).collect()}
    assert got[1]["error_pct"] == pytest.approx(0.826, abs=1e-3) and got[1]["accepted"] == 1 and got[1]["comparison_status"] == "matched"
    assert got[2]["comparison_status"] == "actual_missing" and got[2]["accepted"] is None


def test_issues(spark):
    rows = [
        (1, "matched", 20.0, ["geometry_trusted"], None), (2, "actual_missing", None, ["baseline_only"], None), (3, "matched", 1.0, ["baseline_only", "elevation_missing", "red_flag_missing_elevation"], None),
        (4, "not_applicable", None, ["baseline_only", "geometry_missing", "manual_input"], None), (5, "actual_missing", None, ["geometry_trusted"], ["actual_missing"]),
    ]
    log = spark.createDataFrame(rows, "prediction_id BIGINT, comparison_status STRING, error_pct DOUBLE, data_quality_flags ARRAY<STRING>, resolved_issue_types ARRAY<STRING>")
    got = sorted((r["prediction_id"], r["issue_type"], r["priority"]) for r in quality.issue_worklist(log).collect())
    assert got == [(1, "high_error", "P1"), (2, "actual_missing", "P1"), (2, "baseline_only", "P2"), (3, "red_flag_missing_elevation", "P1")]


def test_steward_golden(spark):
    refs = spark.createDataFrame(
        [("q", 10.0, "10:00:000", "10:05:000"), ("q", 20.0, "16:40:000", "17:00:000"), ("q", 0.0, "09:00:000", "09:10:000"), ("q", 8.0, "", ""), ("q", 0.0, "", ""), ("w", 12.0, "12:00:000", "12:12:000")],
        "request_id STRING, km DOUBLE, best_time STRING, driver_time STRING",
    )
    targets = spark.createDataFrame([("q", 15.0, "13:20:000"), ("w", 14.0, "13:30:000"), ("e", 14.0, "13:30:000")], "request_id STRING, km DOUBLE, best_time STRING")
    got = {r["request_id"]: r for r in aggregates.steward_estimate(refs, targets).collect()}
    q = got["q"]
    assert (q["used_stage_count"], q["ignored_stage_count"]) == (2, 2)
    assert q["average_diff_per_km"] == pytest.approx(0.75) and q["km_based_prediction_seconds"] == pytest.approx(811.25)
    assert q["percentage_prediction_seconds"] == pytest.approx(811.3333333333334) and q["methods_gap_seconds"] == pytest.approx(0.0833333, abs=1e-6)
    assert got["w"]["single_stage_warning"] and not q["single_stage_warning"] and got["e"]["error"] == "no_reference_stage"


def rdp(points, epsilon, offset):
    """Textbook recursion, for comparison."""
    if len(points) < 3:
        return list(points)
    far, at = max((offset(p, points[0], points[-1]), -i) for i, p in enumerate(points[1:-1], 1))
    if far <= epsilon:
        return [points[0], points[-1]]
    return rdp(points[: -at + 1], epsilon, offset)[:-1] + rdp(points[-at:], epsilon, offset)


def plane_offset(p, a, b):
    import math

    m = simplify.METRES_PER_DEGREE
    s = m * math.cos(math.radians((a[0] + b[0]) / 2))
    px, py, ex, ey = (p[1] - a[1]) * s, (p[0] - a[0]) * m, (b[1] - a[1]) * s, (b[0] - a[0]) * m
    sq = ex * ex + ey * ey
    t = max(0.0, min(1.0, (px * ex + py * ey) / sq)) if sq else 0.0
    return math.hypot(px - t * ex, py - t * ey)


@pytest.mark.parametrize("piece", [20000, 30])
def test_simplify_matches_recursion(spark, piece):
    rnd = random.Random(5)
    rows, lines = [], {}
    for name, n in (("hot", 200), ("short", 2), ("line", 25)):
        lat, lon = 38.0, 28.0
        for i in range(1, n + 1):
            lat, lon = (lat + rnd.uniform(-0.0002, 0.0004), lon + rnd.uniform(-0.0003, 0.0003)) if name != "line" else (38 + i * 0.001, 28.0)
            rows.append((name, i, lat, lon, 0.0))
            lines.setdefault(name, []).append((lat, lon, i))
    df = spark.createDataFrame(rows, "route_id STRING, seq BIGINT, lat DOUBLE, lon DOUBLE, alt DOUBLE")
    got = {}
    for r in simplify.simplify_rdp(df, 5.0, piece).collect():
        got.setdefault(r["route_id"], []).append(r["seq"])
    assert {k: sorted(v) for k, v in got.items()} == {k: [p[2] for p in rdp(v, 5.0, plane_offset)] for k, v in lines.items()}


def test_fuzzy_match_equals_all_pairs(spark):
    from difflib import SequenceMatcher

    words = ["ege", "bodrum", "rally", "kocaeli", "hitit", "sonbahar"]
    rnd = random.Random(7)
    files = [f"{' '.join(rnd.sample(words, 3))}.kml" for _ in range(15)]
    events = [(str(i), " ".join(rnd.sample(words, 2))) for i in range(12)]

    def score(a, b):
        wa, wb = set(a.split()), set(b.split())
        return (SequenceMatcher(None, a, b).ratio() + len(wa & wb) / max(len(wa), len(wb))) / 2

    expected = {}
    for f in set(files):
        best = max((round(score(f[:-4], n), 9), int(i)) for i, n in events)
        expected[f] = (str(best[1]), best[0]) if best[0] >= 0.5 else (None, None)
    got = lookups.fuzzy_match_best(spark.createDataFrame([(f,) for f in set(files)], "file_name STRING"), spark.createDataFrame(events, "rally_id STRING, rally_name STRING"))
    assert {r["file_name"]: (r["rally_id"], r["confidence"] and round(r["confidence"], 9)) for r in got.collect()} == expected


def test_similar_stages_equals_all_pairs(spark):
    rnd = random.Random(9)
    rows = [(f"s{i}", rnd.choice([0.1, 0.5, 2.0]), rnd.uniform(5, 30), rnd.choice([0.0, 100.0, 4000.0])) for i in range(60)] + [("far", 50.0, 300.0, 90000.0)]
    df = spark.createDataFrame(rows, "stage_id STRING, hairpin_density DOUBLE, distance_km DOUBLE, total_ascent DOUBLE")
    got = {}
    for r in lookups.similar_stages(df, 4).collect():
        got.setdefault(r["stage_id"], []).append((round(r["similarity_score"], 9), r["similar_id"]))
    for a in rows:
        d = sorted((round(abs(a[1] - b[1]) + abs(a[2] / 10 - b[2] / 10) + abs(a[3] / 100 - b[3] / 100), 9), b[0]) for b in rows if b[0] != a[0])[:4]
        assert [x[0] for x in sorted(got[a[0]])] == pytest.approx([x[0] for x in d])


def test_resolve_driver_cascade(spark):
    drivers = spark.createDataFrame([("d1", "Ali Veli", "ali veli"), ("d2", "Can Su", "can su")], "driver_id STRING, display_name STRING, normalized_name_key STRING")
    aliases = spark.createDataFrame([("d1", "A. Veli", 0)], "driver_id STRING, alias_name STRING, is_primary INT")
    asked = spark.createDataFrame([(1, "d2", None), (2, None, "A. Veli"), (3, None, "ALİ VELİ"), (4, None, "Yeni Biri"), (5, None, None)], "q INT, driver_id STRING, driver_name STRING")
    got = {r["q"]: (r["driver_id"], r["resolved"]) for r in lookups.resolve_driver(asked, drivers, aliases).collect()}
    assert got == {1: ("d2", True), 2: ("d1", True), 3: ("d1", True), 4: ("drv_yeni-biri", False), 5: ("drv_unknown-driver", False)}


def test_reference_pace_equals_all_pairs(spark):
    """Stages with several lengths, gaps wider than a span, equal lengths, and spans whose limits are lengths."""
    rng = random.Random(11)
    lengths = [8.5, 10.0, 11.5, 12.0, 17.0, 20.0, 23.0, 23.5, 40.0]
    rows = []
    for stage in range(40):
        own = rng.sample(lengths, rng.choice([1, 1, 2, 3]))
        for driver in range(6):
            rows.append((f"s{stage}", ["A", "B", None][stage % 3], ["gravel", "asphalt"][stage % 2], rng.choice(own), rng.choice([None, 0.0, 400.0 + rng.randrange(900) / 7])))
    results = spark.createDataFrame(rows, "stage_id string, car_class string, surface string, stage_length_km double, time_seconds double")
    asked = [(c, s, km) for c in ("A", "B", "C", None) for s in ("gravel", "asphalt", None) for km in (*lengths, 14.0, 30.0, 1.0, 0.0)]
    requests = spark.createDataFrame([*asked, asked[0]], "car_class string, surface string, stage_length_km double")
    best = {}
    for stage, cls, _, _, t in rows:
        if t:
            best[stage, cls] = min(t, best.get((stage, cls), t))
    got = {(r.car_class, r.surface, r.stage_length_km): r for r in lookups.history_reference_pace(requests, results).collect()}
    assert len(got) == len(asked)
    some = 0
    for cls, surface, km in asked:
        near = [(best[s, c] / x, s) for s, c, f, x, t in rows if t is not None and c is not None and (c, f) == (cls, surface) and (s, c) in best and km * 0.85 <= x <= km * 1.15 and km > 0]
        r = got[cls, surface, km]
        assert r.stage_count == len({s for _, s in near}), (cls, surface, km)
        if near:
            some += 1
            assert r.seconds_per_km == pytest.approx(sum(p for p, _ in near) / len(near), rel=1e-9)
        else:
            assert r.seconds_per_km is None
    assert some > 30


def near_plainly(rows, k):
    real = [(i, (h, km / 10, up / 100)) for i, h, km, up in rows if None not in (h, km, up)]
    out = {}
    for i, p in real:
        order = sorted((abs(p[0] - q[0]) + abs(p[1] - q[1]) + abs(p[2] - q[2]), j) for j, q in real if j != i)
        out[i] = [(j, round(d, 9)) for d, j in order[:k]]
    return out


def test_nearest_with_outlier_cluster_and_stack(spark):
    """A far outlier, a dense cluster, a stack of equal stages, and cells of at most eight points."""
    rng = random.Random(21)
    rows = [(f"c{n}", 1.0 + rng.random() / 1e6, 12.0 + rng.random() / 1e6, 300.0) for n in range(150)]
    rows += [(f"w{n}", rng.random() * 5, rng.random() * 40, rng.random() * 900) for n in range(150)]
    rows += [(f"s{n:02d}", 2.0, 20.0, 100.0) for n in range(40)] + [("far", 1e6, 5e6, 1e7), ("none", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "stage_id string, hairpin_density double, distance_km double, total_ascent double")
    got = {}
    for r in lookups.similar_stages(df, 5, cell=8).orderBy("stage_id", "rank").collect():
        got.setdefault(r.stage_id, []).append((r.similar_id, round(r.similarity_score, 9)))
    want = near_plainly(rows, 5)
    assert set(got) == set(want)
    for i, near in want.items():
        assert [d for _, d in got[i]] == [d for _, d in near], i
        assert got[i] == near or i[0] in "cw", i
    assert lookups.similar_stages(df.limit(0), 5).count() == 0
    few = lookups.similar_stages(df.where("stage_id in ('s00', 's01', 'far')"), 5).collect()
    assert sorted((r.stage_id, r.similar_id, r.rank) for r in few) == [("far", "s00", 1), ("far", "s01", 2), ("s00", "far", 2), ("s00", "s01", 1), ("s01", "far", 2), ("s01", "s00", 1)]


def test_no_cell_is_over_its_bound():
    import numpy as np

    from splitclock.operators.nearest import Tree, _cells

    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(5000, 3)) * 1e-9, rng.random((5000, 3)), [[1e12, 0, 0]], np.repeat(rng.random((1, 3)), 900, axis=0) + rng.random((900, 1)) * 1e-12])
    points = np.unique(points, axis=0)
    tree = Tree()
    for _ in range(20):
        cells = _cells(tree.arrays(), points)
        counts = dict(zip(*np.unique(cells, return_counts=True), strict=True))
        if max(counts.values()) <= 64:
            break
        tree.split(points[::3], cells[::3], counts, 32)
    assert max(counts.values()) <= 64 and tree.cells < 2000


def test_simplification_does_not_depend_on_the_piece(spark):
    rng = random.Random(8)
    rows = [("r", n, 40.0 + n * 1e-5 + rng.choice([0.0, 4.4915559e-5, 9.1e-5]), 30.0 + n * 1.3e-5, 0.0) for n in range(90)]
    points = spark.createDataFrame(rows, "route_id string, seq long, lat double, lon double, alt double")
    kept = [sorted(r.seq for r in simplify.simplify_rdp(points, 5.0, piece).collect()) for piece in (30, 20_000)]
    assert kept[0] == kept[1] and 2 < len(kept[0]) < 90
