"""Prediction plans over whole batches of requests. One request is a driver on a stage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitclock.functions import scoring
from splitclock.functions.classes import FALLBACK_CLASS_FACTORS, class_factor
from splitclock.functions.text import slugify
from splitclock.functions.times import format_minutes
from splitclock.operators import aggregates, history
from splitclock.operators.facts import class_best
from splitclock.operators.lookups import GEOMETRY_INPUTS, history_reference_pace
from splitclock.session import stored

DEFAULT_BASELINE = 1.05
UNKNOWN_DRIVER_BASELINE = 1.1


@dataclass
class LiveHistory:
    """What `predict_live` takes from history: one row a driver each."""

    baselines: DataFrame
    surfaces: DataFrame


def live_history(results: DataFrame) -> LiveHistory:
    """Baselines and surface factors, written once, for many predictions from the same history."""
    results = stored(results)
    return LiveHistory(stored(_baselines(results)), stored(_guarded_surfaces(results)))


def _baselines(results: DataFrame) -> DataFrame:
    return history.recency_weighted_baseline(results).select("driver_id", "baseline_ratio", "data_points", "total_stages")


def _surface_map(per_surface: DataFrame, fields: Sequence[str], name: str) -> DataFrame:
    """One row a driver with a map of the driver's surfaces, so that requests meet all that is known of a driver in one join."""
    entry = F.struct("surface", F.struct(*fields))
    return per_surface.where(F.col("surface").isNotNull()).groupBy("driver_id").agg(F.map_from_entries(F.collect_list(entry)).alias(name))


def _guarded_surfaces(results: DataFrame) -> DataFrame:
    return _surface_map(aggregates.surface_adjustment_guarded(results), ["adjustment"], "_surfaces")


def driver_state(requests: DataFrame, results: DataFrame | LiveHistory) -> DataFrame:
    """Baseline of every requested driver: recency-weighted, 1.1 for a driver without history."""
    base = results.baselines if isinstance(results, LiveHistory) else _baselines(results)
    out = requests.join(base, "driver_id", "left")
    zero = F.lit(0).cast("bigint")
    return out.withColumns(
        {"baseline_ratio": F.coalesce("baseline_ratio", F.lit(UNKNOWN_DRIVER_BASELINE)), "data_points": F.coalesce("data_points", zero), "total_stages": F.coalesce("total_stages", zero)}
    )


def before_stage_form(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Mean ratio of the driver's earlier stages in the requested rally, per request.

    Results become a sum and a count a stage, and those of one (driver, rally), as many as the rally has stages, one row. Requests
    are shuffled once, to that row.
    """
    r = results.where((F.col("time_seconds") > 0) & F.col("ratio_to_class_best").isNotNull() & F.col("stage_number").isNotNull())
    totals = r.groupBy("driver_id", "rally_id", "stage_number").agg(F.sum("ratio_to_class_best").alias("s"), F.count(F.lit(1)).alias("c"))
    form = totals.groupBy("driver_id", "rally_id").agg(F.array_sort(F.collect_list(F.struct(F.col("stage_number").alias("n"), "s", "c"))).alias("_stages"))
    out = requests.join(form, ["driver_id", "rally_id"], "left")
    earlier = F.filter("_stages", lambda x: x["n"] < F.col("stage_number"))
    total = F.aggregate(earlier, F.lit(0.0), lambda a, x: a + x["s"])
    count = F.coalesce(F.aggregate(earlier, F.lit(0).cast("bigint"), lambda a, x: a + x["c"]), F.lit(0).cast("bigint"))
    return out.withColumns({"rally_avg": F.when(count > 0, total / count), "stages_analyzed": count}).drop("_stages")


def predict_baseline(requests: DataFrame, results: DataFrame, legacy_sign: bool = False) -> DataFrame:
    """Driver baseline x momentum x surface x class leader.

    ``requests``: driver_id, rally_id, stage_id, stage_number, surface, normalized_class. Positive momentum means
    better form and lowers the time; ``legacy_sign`` multiplies by 1 + momentum instead. A request that cannot be
    answered keeps its row and says why in ``error``. Results are written once; every part of the plan reads that.
    """
    return _baseline(requests, stored(results), legacy_sign)


def _baseline(requests: DataFrame, results: DataFrame, legacy_sign: bool, *known: DataFrame) -> DataFrame:
    """``known``: more tables with one row a driver, which join where the baselines do."""
    base = _baselines(results).withColumnRenamed("baseline_ratio", "driver_baseline")
    profile = _surface_map(aggregates.surface_profile(results), ["adjustment", "experience"], "_profile_of")
    # Written, because the planner then knows whether they are few enough to go to the requests.
    leader = stored(class_best(results, ("stage_id", "normalized_class"), driver="driver_id"))
    # The form first: requests are shuffled to it while they are narrow, and to the drivers with two more columns.
    q = before_stage_form(requests, results)
    for table in (base, profile, *known):
        q = q.join(table, "driver_id", "left")
    q = q.withColumn("surface", F.lower("surface"))
    own = F.col("_profile_of")[F.col("surface")]
    q = q.withColumns({"surface_adjustment": own["adjustment"], "surface_experience": own["experience"]}).drop("_profile_of")
    if "_experience_of" in q.columns:
        q = q.withColumn("_experience", F.col("_experience_of")[F.col("surface")]["experience"]).drop("_experience_of")
    q = history.momentum_columns(q, "driver_baseline")
    q = q.join(leader, ["stage_id", "normalized_class"], "left")
    factor = 1 + F.col("momentum") if legacy_sign else F.col("momentum_factor")
    q = q.withColumns(
        {"momentum_factor": factor, "surface_adjustment": F.coalesce("surface_adjustment", F.lit(1.0)), "surface_experience": F.coalesce("surface_experience", F.lit(0).cast("bigint"))}
    )
    q = q.withColumn("baseline_ratio", F.col("driver_baseline") * F.col("momentum_factor") * F.col("surface_adjustment"))
    n = F.coalesce("data_points", F.lit(0))
    level = F.when((n >= 15) & (F.col("surface_experience") >= 10), "HIGH").when(n >= 10, "MEDIUM").otherwise("LOW")
    error = F.when(F.col("driver_baseline").isNull(), "no_history").when(F.col("class_best_time").isNull(), "no_class_best")
    return q.withColumns({"predicted_time": F.col("baseline_ratio") * F.col("class_best_time"), "confidence": level, "error": error})


def predict_notional(requests: DataFrame, results: DataFrame, geometry: DataFrame, corrections: DataFrame | None = None, legacy_sign: bool = False) -> DataFrame:
    """Baseline, geometric correction, confidence. A driver without history gets 1.05; without a class leader there
    is no time and ``error`` says so.

    ``corrections``: driver_id, stage_id, geometric_correction from a trained model (see ``plans.ml``).
    """
    results = stored(results)
    profiles = aggregates.geometry_profile(results.join(geometry.select("stage_id", "hairpin_density", "total_ascent", "p95_curvature", "max_grade"), "stage_id", "left"))
    profiles = profiles.select("driver_id", scoring.confidence_weight(F.col("confidence")).alias("_profile"))
    experience = _surface_map(aggregates.surface_experience(results), ["experience"], "_experience_of")
    b = _baseline(requests, results, legacy_sign, profiles, experience)
    b = stored(b)
    failed = F.col("error").isNotNull()
    b = b.withColumns(
        {
            "baseline_ratio": F.when(failed, DEFAULT_BASELINE).otherwise(F.col("baseline_ratio")), "momentum_factor": F.when(failed, 1.0).otherwise(F.col("momentum_factor")),
            "surface_adjustment": F.when(failed, 1.0).otherwise(F.col("surface_adjustment")),
        }
    )
    g = geometry.select("stage_id", F.lit(True).alias("_has_geometry"), F.col("hairpin_density").alias("_density"))
    b = b.join(g, "stage_id", "left")
    if corrections is not None:
        b = b.join(corrections.select("driver_id", "stage_id", "geometric_correction"), ["driver_id", "stage_id"], "left")
    else:
        b = b.withColumn("geometric_correction", F.lit(None).cast("double"))
    used = F.col("geometric_correction").isNotNull() & (F.coalesce("_density", F.lit(0.0)) > 0)
    b = b.withColumns({"geometric_mode": F.when(used, "geometric").otherwise("fallback"), "geometric_correction": F.when(used, F.col("geometric_correction")).otherwise(1.0)})
    score = scoring.confidence_v2(
        F.coalesce("total_stages", F.lit(0)), F.coalesce("_experience", F.lit(0)), F.coalesce("_has_geometry", F.lit(False)), F.coalesce("_profile", F.lit(0.5)),
        F.col("stage_number") - 1, F.col("baseline_ratio"), F.col("geometric_mode"),
    )
    ratio = F.col("baseline_ratio") * F.col("geometric_correction")
    return b.withColumns(
        {
            "predicted_ratio": ratio, "predicted_time": ratio * F.col("class_best_time"), "confidence_detail": score,
            "error": F.when(F.col("class_best_time").isNull(), "no_class_best"),
        }
    ).withColumns(
        {"predicted_time_str": format_minutes(F.col("predicted_time"), 3), "confidence_score": F.col("confidence_detail.score"), "confidence_level": F.col("confidence_detail.level")}
    ).drop("_has_geometry", "_density", "_profile", "_experience", "confidence")


def predict_batch(requests: DataFrame, results: DataFrame, geometry: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """The same plan; requests without an answer drop out."""
    return predict_notional(requests, results, geometry, corrections).where(F.col("error").isNull())


def _finish(q: DataFrame, momentum_stages: Column, version: str) -> DataFrame:
    """Common tail of the live and the route plan: ratio, reference, time, speed, confidence, flags."""
    trusted = scoring.geometry_trusted(F.col("geometry_status"), F.col("elevation_status"))
    corrected = trusted & F.col("geometric_correction").isNotNull()
    q = q.withColumns(
        {
            "used_geometry": corrected.cast("int"), "geometric_mode": F.when(corrected, "geometric").otherwise("baseline_only"),
            "geometric_correction": F.when(corrected, scoring.clip(F.col("geometric_correction"), 0.9, 1.1)).otherwise(1.0),
        }
    )
    product = F.col("baseline_ratio") * F.col("momentum_factor") * F.col("surface_adj") * F.col("geometric_correction")
    when_trusted = lambda c: F.when(trusted, F.col(c)) if c in q.columns else F.lit(None).cast("double")
    reference = scoring.reference_time_live(F.col("stage_length_km"), F.col("surface"), F.col("normalized_class"), when_trusted("hairpin_density"), when_trusted("avg_abs_grade"))
    q = q.withColumns({"predicted_ratio": scoring.clip(product, 1.0, 1.8), "reference_time": reference})
    q = q.withColumn("predicted_time", F.col("reference_time") * F.col("predicted_ratio"))
    score = scoring.confidence_service(F.col("data_points"), F.col("total_stages"), momentum_stages, F.col("used_geometry") == 1, F.col("surface_adj"))
    q = q.withColumns(
        {
            "predicted_speed_kmh": F.when(F.col("predicted_time") > 0, F.col("stage_length_km") / F.col("predicted_time") * 3600).otherwise(0.0), "predicted_time_str": format_minutes(F.col("predicted_time")),
            "confidence_score": score, "data_quality_flags": scoring.quality_flags(F.col("geometry_status"), F.col("elevation_status")), "model_version": F.lit(version),
        }
    )
    return q.withColumn("confidence_level", scoring.level_of(F.col("confidence_score")))


def _with_corrections(q: DataFrame, corrections: DataFrame | None) -> DataFrame:
    if corrections is None:
        return q.withColumn("geometric_correction", F.lit(None).cast("double"))
    return q.join(corrections.select("driver_id", "stage_id", "geometric_correction"), ["driver_id", "stage_id"], "left")


def _surface_factor(q: DataFrame, results: DataFrame | LiveHistory) -> DataFrame:
    surfaces = results.surfaces if isinstance(results, LiveHistory) else _guarded_surfaces(results)
    own = F.col("_surfaces")[F.lower("surface")]["adjustment"]
    return q.join(surfaces, "driver_id", "left").withColumn("surface_adj", F.coalesce(own, F.lit(1.0))).drop("_surfaces")


def predict_live(requests: DataFrame, results: DataFrame | LiveHistory, live: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Predict the next stage of a running rally.

    ``requests``: driver_id, normalized_class, and the stage context columns (see ``lookups.stage_context``).
    ``results`` is history with ratios, or what `live_history` makes of it; ``live`` holds the running rallies' rows with ratios.
    """
    results = results if isinstance(results, LiveHistory) else stored(results)
    q = _surface_factor(driver_state(stored(requests), results), results)
    q = _with_corrections(history.momentum_columns(before_stage_form(q, stored(live))), corrections)
    return _finish(q, F.col("stages_analyzed"), "prediction_service_live_v1")


def predict_route(requests: DataFrame, results: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Predict drivers on routes outside any rally; momentum comes from the newest rally driven.

    ``requests``: driver_id, normalized_class, stage_name, surface and the route's geometry columns.
    """
    results = stored(results)
    q = stored(requests).withColumns(
        {
            "rally_id": F.lit("kml_manual"), "stage_id": F.concat(F.lit("kml_"), slugify(F.col("stage_name"), "stage")),
            "stage_length_km": F.coalesce(F.nullif("distance_km", F.lit(0.0)), F.lit(15.0)),
        }
    )
    km, up, down, grade = (F.col(c) for c in ("distance_km", "total_ascent", "total_descent", "max_grade"))
    none = F.lit(None).cast("double")
    red = scoring.missing_elevation(km, up, down, grade)
    known = scoring.elevation_status(km, up, down, grade, F.col("max_elevation") if "max_elevation" in q.columns else none, F.col("min_elevation") if "min_elevation" in q.columns else none)
    status = F.when(red, "red_flag_missing_elevation").when(known == "missing", "elevation_missing").otherwise("validated")
    q = driver_state(q.withColumns({"geometry_status": status, "elevation_status": known}), results)
    form = history.latest_rally_momentum(results, q.select("driver_id", "baseline_ratio").distinct()).select("driver_id", "momentum_factor")
    q = q.join(form, "driver_id", "left").withColumn("momentum_factor", F.coalesce("momentum_factor", F.lit(1.0)))
    q = _with_corrections(_surface_factor(q, results), corrections)
    return _finish(q, F.lit(0), "prediction_service_kml_v1")


def predict_manual(requests: DataFrame, results: DataFrame, n: int = 15) -> DataFrame:
    """Predict from a driver's last ``n`` stages for a stage described by hand.

    ``requests``: driver_id, stage_length_km, surface. Ratios are against the leader of the driver's newest class on
    each of those stages.
    """
    results = stored(results)
    last = stored(history.last_n_history(results, n))
    newest = last.groupBy("driver_id").agg(F.min_by(F.struct("car_class", "normalized_class"), "recency").alias("_c"))
    last = last.drop("car_class", "normalized_class", "class_best_time", "ratio_to_class_best").join(newest, "driver_id").select("*", "_c.*").drop("_c")
    leader = results.where(F.col("time_seconds") > 0).groupBy("rally_id", "stage_number", "normalized_class").agg(F.min("time_seconds").alias("class_best_time"))
    rated = last.join(leader, ["rally_id", "stage_number", "normalized_class"]).where("class_best_time > 0").withColumn("ratio_to_class_best", F.col("time_seconds") / F.col("class_best_time"))
    # Newest first again: stages without a leader of that class left gaps.
    rated = stored(history.last_n_history(rated.drop("recency"), n))
    form = history.form_5v5(rated)
    by_surface = rated.groupBy("driver_id", F.lower("surface").alias("_s")).agg(F.avg("ratio_to_class_best").alias("_sa"), F.count(F.lit(1)).alias("_sn"))
    overall = rated.groupBy("driver_id").agg(F.avg("ratio_to_class_best").alias("_oa"), F.min_by("car_class", "recency").alias("car_class"), F.min_by("normalized_class", "recency").alias("normalized_class"))
    q = requests.join(form, "driver_id", "left").join(overall, "driver_id", "left").withColumn("_s", F.lower("surface")).join(by_surface, ["driver_id", "_s"], "left")
    surface_n = F.coalesce("_sn", F.lit(0).cast("bigint"))
    q = q.withColumn("surface_adjustment", F.when(surface_n >= 3, F.col("_sa") / F.col("_oa")).otherwise(1.0))
    ratio = scoring.clip(F.col("recent_avg_ratio") * F.col("form_factor") * F.col("surface_adjustment"), 1.0, 1.5)
    reference = scoring.reference_time_manual(F.col("stage_length_km"), F.col("surface"), F.col("normalized_class"), F.col("car_class"))
    known = F.col("n").isNotNull()
    q = q.withColumns({"predicted_ratio": F.when(known, ratio), "reference_time": F.when(known, reference)})
    q = q.withColumns(
        {
            "predicted_time": F.col("predicted_ratio") * F.col("reference_time"), "confidence_score": F.when(known, scoring.confidence_manual(F.col("n"), surface_n)),
            "error": F.when(~known, "no_history"),
        }
    )
    return q.withColumns(
        {
            "predicted_speed_kmh": F.round(F.col("stage_length_km") / F.col("predicted_time") * 3600), "predicted_time_str": format_minutes(F.col("predicted_time"), 3),
            "confidence_level": scoring.level_of(F.col("confidence_score")),
        }
    ).drop("_s", "_sa", "_sn", "_oa", "n")


def red_flag_constraints(ratio: Column, reference: Column, km: Column, surface: Column, low: float = 1.0, high: float = 1.35) -> Column:
    """Time from a clipped ratio: not under the class leader, not over the ratio cap, not slower than 40/50 km/h."""
    time = F.greatest(scoring.clip(ratio, low, high) * reference, reference)
    slowest = km / F.when(surface == "gravel", 40.0).otherwise(50.0) * 3600
    return F.least(time, reference * high, slowest)


def red_flag_predict(requests: DataFrame, stage_results: DataFrame, results: DataFrame, ratios: DataFrame) -> DataFrame:
    """Notional times for drivers of a stopped stage.

    ``requests``: driver_id, stage_id, car_class, stage_length_km, surface. ``stage_results``: rows that did finish.
    ``ratios``: driver_id, stage_id, predicted_ratio from the model. Without finishers of the class the reference
    comes from like stages of the past.
    """
    ref = stage_results.groupBy("stage_id", "car_class").agg(F.min("time_seconds").alias("best_time"), F.count(F.lit(1)).alias("n_class_finishers"))
    q = requests.join(ref, ["stage_id", "car_class"], "left").join(ratios.select("driver_id", "stage_id", "predicted_ratio"), ["driver_id", "stage_id"])
    past = history_reference_pace(requests.select("car_class", "surface", "stage_length_km").distinct(), results).select("car_class", "surface", "stage_length_km", "reference_time")
    q = q.join(past, ["car_class", "surface", "stage_length_km"], "left")
    n = F.coalesce("n_class_finishers", F.lit(0).cast("bigint"))
    reference = F.coalesce("best_time", "reference_time")
    return q.select(
        "driver_id", "stage_id", "car_class", scoring.clip(F.col("predicted_ratio"), 1.0, 1.35).alias("predicted_ratio"), reference.alias("class_reference_time"),
        red_flag_constraints(F.col("predicted_ratio"), reference, F.col("stage_length_km"), F.col("surface")).alias("notional_time"),
        F.when(n >= 3, "high").when(n > 0, "medium").otherwise("low").alias("confidence"), n.alias("n_class_finishers"),
    )


def manual_reference_time(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Reference time of stages described by hand: like stages of the past, else typical speed by class."""
    q = history_reference_pace(requests, results)
    speed = F.when(F.col("surface") == "asphalt", 100.0).otherwise(85.0)
    typical = F.col("stage_length_km") / (speed / class_factor(F.col("car_class"), FALLBACK_CLASS_FACTORS)) * 3600
    return q.withColumn("reference_time", F.when(F.col("seconds_per_km").isNotNull(), F.col("seconds_per_km") * F.col("stage_length_km")).otherwise(typical))


def log_predictions(predictions: DataFrame, run_id: str, status: str = "pending") -> DataFrame:
    """Log rows of predictions. The id is a hash of run, stage and driver, so a repeated write gives the same id."""
    flags = F.array_sort(F.array_distinct("data_quality_flags"))
    return predictions.select(
        F.xxhash64(F.lit(run_id), "stage_id", "driver_id").alias("prediction_id"), F.lit(run_id).alias("run_id"), "rally_id", "stage_id", "driver_id", "predicted_time",
        F.col("confidence_score").cast("double").alias("confidence"), "used_geometry", flags.alias("data_quality_flags"), "model_version", F.lit(status).alias("comparison_status"),
    )


def factor_waterfall(predictions: DataFrame, key: str = "result_id") -> DataFrame:
    """Four rows per prediction: what each factor adds to the ratio, and the ratio so far."""
    b, m, s, g = (F.col(c) for c in ("baseline_ratio", "momentum_factor", "surface_adj", "geometric_correction"))
    step = lambda n, name, value, total: F.struct(F.lit(n).alias("step"), F.lit(name).alias("name"), value.alias("value"), total.alias("cumulative"))
    steps = F.array(step(1, "Baseline", b, b), step(2, "Momentum", m - 1, b * m), step(3, "Zemin", s - 1, b * m * s), step(4, "Geometri", g - 1, b * m * s * g))
    return predictions.select(key, F.inline(steps))


def explanation_json(predictions: DataFrame, key: str = "result_id") -> DataFrame:
    """One JSON report per prediction."""
    geometry = [c for c in GEOMETRY_INPUTS if c in predictions.columns]
    report = F.struct(
        F.col("driver_id"), F.col("stage_id"),
        F.struct(F.col("predicted_time").alias("time_seconds"), F.col("predicted_time_str").alias("time_formatted"), F.col("predicted_ratio").alias("ratio"), F.col("confidence_level").alias("confidence"), F.col("confidence_score")).alias("prediction"),
        F.struct(F.col("baseline_ratio").alias("baseline"), F.col("momentum_factor").alias("momentum"), F.col("surface_adj").alias("surface"), F.col("geometric_correction").alias("geometric")).alias("factors"),
        *([F.struct(*geometry).alias("geometry")] if geometry else []),
    )
    return predictions.select(key, F.to_json(report).alias("report"))
