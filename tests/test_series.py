"""Chunked series against plain windows, with chunks small enough to be cut everywhere and one key holding most rows."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitclock.operators import facts, history, route, series


@pytest.fixture(scope="module")
def races(spark):
    rnd = random.Random(1)
    rows, n = [], 0
    for driver, rallies in (("hot", 40), ("a", 3), ("b", 7), ("c", 1)):
        for r in range(rallies):
            for s in range(1, rnd.randint(2, 6)):
                n += 1
                rows.append((f"r{n}", driver, f"{100 + r}", f"2024-{r % 12 + 1:02d}-{r // 12 + 1:02d}", s, rnd.choice(["gravel", "asphalt"]), rnd.choice([4.0, 6.5, 12.0]), 1 + rnd.random()))
    return spark.createDataFrame(rows, "result_id STRING, driver_id STRING, rally_id STRING, rally_date STRING, stage_number INT, surface STRING, stage_length_km DOUBLE, ratio_to_class_best DOUBLE").cache()


def as_dict(df, key, *cols):
    return {r[key]: tuple(None if r[c] is None else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect()}


ORDER = ["rally_date", "rally_id", "stage_number", "result_id"]


def test_position_and_halo(races):
    plain = races.withColumn("position", F.row_number().over(W.partitionBy("driver_id").orderBy(*ORDER)))
    assert as_dict(history.positioned(races), "result_id", "position") == as_dict(plain, "result_id", "position")


@pytest.mark.parametrize("size", [15, 16, 40, 4096])
def test_history_matches_plain_windows(races, size):
    w = W.partitionBy("driver_id").orderBy(*ORDER)
    r = F.col("ratio_to_class_best")
    plain = races.withColumns(
        {
            "m": F.avg(r).over(w.rowsBetween(-15, -1)), "s": F.stddev_samp(r).over(w.rowsBetween(-15, -1)), "b": F.min(r).over(w.rowsBetween(W.unboundedPreceding, -1)), "n": F.row_number().over(w) - 1,
        }
    )
    mine = history.history_overall(races, size=size)
    assert as_dict(mine, "result_id", "driver_mean_ratio_overall", "driver_std_ratio_surface", "driver_best_ratio_season", "driver_stages_completed") == as_dict(plain, "result_id", "m", "s", "b", "n")
    ws = W.partitionBy("driver_id", "surface").orderBy(*ORDER)
    assert as_dict(history.history_surface(races, size=size), "result_id", "driver_mean_ratio_surface") == as_dict(races.withColumn("m", F.avg(r).over(ws.rowsBetween(-15, -1))), "result_id", "m")


def test_short_stage_history(races):
    expected, seen = {}, {}
    for r in sorted(races.collect(), key=lambda x: (x["driver_id"], x["rally_date"], x["rally_id"], x["stage_number"], x["result_id"])):
        past = seen.setdefault(r["driver_id"], [])
        expected[r["result_id"]] = (round(sum(past[-10:]) / len(past[-10:]), 9) if len(past) >= 3 else None,)
        if r["stage_length_km"] < 7:
            past.append(r["ratio_to_class_best"])
    got = {k: (None if v[0] is None else round(v[0], 9),) for k, v in as_dict(history.history_short_stage(races, size=10), "result_id", "driver_short_stage_ratio").items()}
    assert got == expected


def test_steps_over_numbered_rows_equal_those_over_the_order(races):
    placed = history.positioned(races, name="_place")
    for step, columns in (
        (history.history_overall, ["driver_mean_ratio_overall", "driver_best_ratio_season", "driver_stages_completed", "driver_momentum"]),
        (history.history_surface, ["driver_mean_ratio_surface"]), (history.history_short_stage, ["driver_short_stage_ratio"]),
    ):
        assert as_dict(step(placed, size=16, place="_place"), "result_id", *columns) == as_dict(step(races, size=16), "result_id", *columns)
    whole = ["driver_avg_ratio_this_rally", "driver_mean_ratio_surface", "driver_short_stage_ratio", "driver_std_ratio_surface"]
    numbered = history.positioned(history.history_rally(races), name="_place")
    assert as_dict(history.history_features(numbered, place="_place"), "result_id", *whole) == as_dict(history.history_features(races), "result_id", *whole)


def test_features_ignore_later_rows(races):
    cut = races.where("rally_date < '2024-07-01'")
    a = as_dict(history.history_features(cut), "result_id", "driver_mean_ratio_overall", "driver_momentum", "driver_short_stage_ratio")
    b = as_dict(history.history_features(races), "result_id", "driver_mean_ratio_overall", "driver_momentum", "driver_short_stage_ratio")
    assert a == {k: b[k] for k in a}


def test_running_sum_and_quantiles(spark):
    rnd = random.Random(2)
    rows = [(k, i, rnd.uniform(-5, 500)) for k, n in (("hot", 300), ("x", 1), ("y", 7)) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "k STRING, i BIGINT, v DOUBLE")
    w = W.partitionBy("k").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    plain = {(r["k"], r["i"]): r["s"] for r in df.withColumn("s", F.sum("v").over(w)).collect()}
    mine = {(r["k"], r["i"]): r["s"] for r in series.running_sum(df, ["k"], "i", F.col("v"), "s", size=9).collect()}
    assert mine.keys() == plain.keys() and all(abs(mine[k] - plain[k]) < 1e-6 for k in plain)
    exact = {r["k"]: r for r in df.groupBy("k").agg(F.percentile("v", 0.95).alias("p"), F.median("v").alias("m")).collect()}
    for r in series.exact_quantiles(df, ["k"], "v", {"p": 0.95, "m": 0.5}).collect():
        assert r["p"] == pytest.approx(exact[r["k"]]["p"]) and r["m"] == pytest.approx(exact[r["k"]]["m"])


def test_class_position_with_ties(spark):
    df = spark.createDataFrame([(f"r{i}", "s", "c", float(i % 3) + 100) for i in range(9)] + [("z", "s", "c", None)], "result_id STRING, stage_id STRING, normalized_class STRING, time_seconds DOUBLE")
    got = {r["result_id"]: r["class_position"] for r in facts.class_position(df).collect()}
    assert [got[k] for k in ("r0", "r3", "r6", "r1", "r4", "r7", "r2", "r5", "r8")] == list(range(1, 10)) and "z" not in got


def test_average_rank(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 3.0, 2.0, 3.0])], "i INT, v DOUBLE")
    assert as_dict(history.average_rank(df, [], "v", "r"), "i", "r") == {0: (4.0,), 1: (1.0,), 2: (4.0,), 3: (2.0,), 4: (4.0,)}


def test_route_chunks_change_nothing(spark):
    rnd = random.Random(3)
    pts, lat, lon = [], 38.0, 28.0
    for i in range(1, 120):
        lat, lon = lat + rnd.uniform(-0.0004, 0.0008), lon + rnd.uniform(-0.0006, 0.0006)
        pts.append(("hot", i, lat, lon, 0.0 if i % 9 == 0 else 100 + rnd.uniform(0, 9)))
    pts += [("tiny", i, 38.0 + i * 0.001, 28.0, 5.0) for i in range(1, 4)]
    df = spark.createDataFrame(pts, "route_id STRING, seq BIGINT, lat DOUBLE, lon DOUBLE, alt DOUBLE").cache()
    for fn, cols in (
        (route.geometric_features, ["hairpin_count", "distance_km", "p95_curvature", "total_ascent", "max_grade"]),
        (route.path_features, ["geometry_points", "curvature_sum", "p95_curvature", "hairpin_count", "sign_changes"]),
        (route.corner_census, ["corners", "straight_km", "straight_sections", "elevation_gain_m"]),
    ):
        whole = as_dict(fn(df, size=4096), "route_id", *cols)
        small = as_dict(fn(df, size=7), "route_id", *cols)
        assert whole.keys() == small.keys()
        for k in whole:
            assert small[k] == pytest.approx(whole[k], abs=1e-6)


def test_quantiles_of_a_column_with_one_common_value(spark):
    """Nine rows in ten have one value; equal values are one row with a count, and the rest is interpolated as always."""
    import numpy as np
    from pyspark.sql import functions as F

    from splitclock.operators.series import exact_quantiles

    rng = np.random.default_rng(4)
    values = np.concatenate([np.full(9000, 2.5), rng.normal(3, 1, 1000), np.zeros(50), -rng.random(50) * 1e-9])
    df = spark.createDataFrame([(k % 2, float(v)) for k, v in enumerate(values)], "k int, v double").withColumn("v", F.col("v"))
    got = {r.k: (r.a, r.b, r.c) for r in exact_quantiles(df, ["k"], "v", {"a": 0.01, "b": 0.5, "c": 0.97}).collect()}
    for k in (0, 1):
        assert np.allclose(got[k], np.quantile(values[k::2], [0.01, 0.5, 0.97]), rtol=1e-12, atol=0)
