"""Feature matrices for training and scoring. Both use the same column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitclock.functions.classes import class_ordinal
from splitclock.operators import facts, history
from splitclock.operators.aggregates import geometry_profile
from splitclock.operators.lookups import attach_profiles, results_inner_geometry, results_left_geometry
from splitclock.operators.series import group_stats
from splitclock.session import discard, removed_after, stored, stored_join

STAGE_FEATURES = [
    "distance_km", "hairpin_count", "hairpin_density", "turn_count", "turn_density", "total_ascent", "total_descent",
    "elevation_gain", "max_grade", "avg_abs_grade", "avg_curvature", "max_curvature", "p95_curvature",
    "curvature_density", "straight_percentage", "curvy_percentage",
]
PROFILE_FEATURES = ["driver_hairpin_perf", "driver_climb_perf", "driver_curvature_sens", "driver_grade_perf", "driver_profile_confidence"]
BASELINE_FEATURES = ["baseline_ratio", "momentum_factor", "surface_adjustment"]
INTERACTIONS = ["hairpin_x_driver", "climb_x_driver", "curvature_x_driver"]
CATEGORICAL = ["surface", "normalized_class"]
DRIVER_FEATURES = ["driver_stage_count", "driver_avg_ratio", "driver_surface_ratio"]

# Columns that are keys, names, targets or kept only as text.
NOT_FEATURES = [
    "result_id", "rally_id", "stage_id", "driver_id", "rally_name", "rally_date", "stage_name", "driver_name", "car_model",
    "surface", "day_or_night", "raw_time_str", "time_seconds", "status", "class_best_time", "ratio_to_class_best",
    "is_anomaly", "anomaly_reason", "created_at", "car_class",
]
NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")


def numeric_feature_select(df: DataFrame) -> list[str]:
    """Names of the numeric columns that may serve as features."""
    return [n for n, t in df.dtypes if n not in NOT_FEATURES and (t in NUMERIC or t.startswith("decimal"))]


def stage_features(df: DataFrame, power: float = 0.85, short_km: float = 7.0, penalty: float = 1.03) -> DataFrame:
    """Surface and night flags, length to a power, short-stage flag and penalty, length bins."""
    km = F.col("stage_length_km")
    night = F.col("day_or_night") == "night" if "day_or_night" in df.columns else F.lit(False)
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    short = km < short_km
    return df.withColumns(
        {
            "surface_asphalt": yes(F.col("surface") == "asphalt"), "surface_gravel": yes(F.col("surface") == "gravel"), "is_night": yes(night),
            "stage_length_corrected": F.pow(km, F.lit(power)), "is_short_stage": yes(short), "short_stage_penalty": F.when(short, penalty).otherwise(1.0),
            "length_short": yes((km > 0) & (km <= 10)), "length_medium": yes((km > 10) & (km <= 20)), "length_long": yes((km > 20) & (km <= 30)),
            "length_very_long": yes((km > 30) & (km <= 100)),
        }
    )


def class_features(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Strength order of the class and one flag per listed class."""
    c = F.col("car_class")
    flags = {f"class_{name}": F.coalesce(c == name, F.lit(False)).cast("int") for name in classes}
    return df.withColumns({"class_ordinal": class_ordinal(c)} | flags)


def competition_features(df: DataFrame) -> DataFrame:
    """Gaps per km and leading flags from the standings before the stage; 0 where a column is absent."""
    have = set(df.columns)
    col = lambda n, t: F.col(n) if n in have else F.lit(None).cast(t)
    per_km = lambda n: F.try_divide(F.col(n), F.col("stage_length_km")) if n in have else F.lit(0.0)
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    overall, in_class = col("overall_position_before", "int"), col("class_position_before", "int")
    return df.withColumns(
        {
            "gap_to_leader_per_km": per_km("gap_to_leader_seconds"), "gap_to_class_leader_per_km": per_km("gap_to_class_leader_seconds"),
            "is_leading_overall": yes(overall == 1), "is_leading_class": yes(in_class == 1), "is_top3_class": yes(in_class <= 3),
        }
    )


def rally_context(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    have = set(df.columns)
    cumulative = F.col("cumulative_stage_km") / 100 if "cumulative_stage_km" in have else F.lit(0.0)
    first = (F.col("stage_number_in_day") == 1).cast("int") if "stage_number_in_day" in have else F.lit(1)
    return history.stage_progress(df, base).withColumns({"cumulative_stage_km_normalized": cumulative, "is_first_stage_of_day": first})


V1_IMPUTED = [
    "driver_mean_ratio_surface", "driver_mean_ratio_overall", "driver_std_ratio_surface", "driver_best_ratio_season",
    "driver_last3_ratio_same_rally", "driver_avg_ratio_this_rally", "driver_short_stage_ratio", "driver_momentum",
]


def v1_feature_matrix(df: DataFrame, classes: Sequence[str], lookback: int = 15, exclude_anomalies: bool = True) -> DataFrame:
    """The full feature matrix: target, stage, class, driver history, rally context, standings, imputation.

    Anomalies leave before the target is computed, so a stuck car is nobody's class leader or history.
    """
    rows = df.where(~F.col("is_anomaly")) if exclude_anomalies and "is_anomaly" in df.columns else df

    def work() -> tuple[DataFrame, list[DataFrame]]:
        # The history walks rows of its own columns alone; what else a row holds meets it by the row's number, once.
        given = stored(rows)
        rated = stored(facts.ratio_to_class_best(given, ("rally_id", "stage_id", "car_class"), write=True).withColumn("_row", F.monotonically_increasing_id()))
        if given is not rows:
            discard(given)
        # The order is known after the first step: a row is its place.
        series = history.history_rally(rated.select("_row", *history.SERIES))
        numbered = stored(history.positioned(series, name="_place", base=rated).drop(*history.RALLY_ORDER, "stage_number", "result_id"))
        walked = history.history_features(numbered, lookback, place="_place").drop("_place", *history.SERIES)
        discard(numbered)
        # The medians read every row of the matrix: it is written once rather than joined again for each.
        matrix = stored_join(class_features(stage_features(rated), classes), walked, "_row")
        return matrix, [matrix]

    out = removed_after(df.sparkSession, work).drop("_row")
    out = competition_features(rally_context(out, out))
    out = history.impute_surface_median(out, V1_IMPUTED[:2])
    # Every numeric column that still has gaps gets its median, not only the history columns.
    numeric = numeric_feature_select(out)
    empty = out.agg(*[F.max(F.col(c).isNull()).alias(c) for c in numeric]).first()
    gaps = [c for c in numeric if empty[c]]
    return history.impute_median(out, gaps) if gaps else out


def interaction_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "hairpin_x_driver": F.col("hairpin_density") * F.col("driver_hairpin_perf"), "climb_x_driver": F.col("total_ascent") * F.col("driver_climb_perf"),
            "curvature_x_driver": F.col("p95_curvature") * F.col("driver_curvature_sens"),
        }
    )


def elevation_gain(df: DataFrame) -> Column:
    have = set(df.columns)
    own = [F.col("elevation_gain")] if "elevation_gain" in have else []
    span = [F.abs(F.col("max_elevation") - F.col("min_elevation"))] if {"max_elevation", "min_elevation"} <= have else []
    return F.coalesce(*own, *span, F.lit(0.0))


def prediction_features(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """The feature vector of the correction model. Used for training rows and for requests alike.

    ``df`` has driver_id, surface, normalized_class, the baseline features and the stage's geometry columns.
    """
    df = df.withColumn("elevation_gain", elevation_gain(df))
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in STAGE_FEATURES})
    df = interaction_features(attach_profiles(df, profiles))
    return df.withColumns({"surface": F.lower(F.coalesce("surface", F.lit("unknown"))), "normalized_class": F.coalesce("normalized_class", F.lit("Unknown"))})


def training_set_profiles(results: DataFrame, geometry: DataFrame, least_rows: int = 10) -> DataFrame:
    """Rows with geometry, driver profile, expanding baseline and the correction factor within (0.8, 1.2)."""
    results, geometry = stored(results), stored(geometry)
    joined = results_inner_geometry(facts.valid_results(results) if "status" in results.columns else results.where(F.col("time_seconds") > 0), geometry)
    kept = stored(facts.min_history_filter(joined, least_rows).withColumn("_row", F.monotonically_increasing_id()))
    # The baseline walks its own columns alone; what else a row holds meets it by the row's number.
    walked = kept.select("_row", "driver_id", "rally_id", "stage_number", "result_id", "ratio_to_class_best")
    based = stored(history.expanding_baseline(walked).select("_row", "baseline_ratio"))
    based = kept.drop("baseline_ratio").join(based, "_row").drop("_row")
    profiles = stored(geometry_profile(results_left_geometry(results, geometry)))
    based = based.withColumns({"momentum_factor": F.lit(1.0), "surface_adjustment": F.lit(1.0)})
    full = prediction_features(based, profiles).withColumn("correction_factor", F.col("ratio_to_class_best") / F.col("baseline_ratio"))
    return facts.ratio_band(full, "correction_factor", 0.8, 1.2)


def training_set_trainer(results: DataFrame, geometry: DataFrame, leak_free: bool = True) -> DataFrame:
    """Rows with geometry, ratio within (0.5, 2), driver features, the mean of the last 15 as baseline, and the
    correction factor within (0.8, 1.2).

    ``leak_free`` takes the driver means from earlier rows only; without it they span the whole career, this row
    included, as older models were trained.
    """
    return facts.ratio_band(_driver_features(results, geometry, leak_free, (0.5, 2.0)), "correction_factor", 0.8, 1.2)


def request_features(results: DataFrame, geometry: DataFrame, leak_free: bool = True) -> DataFrame:
    """The columns of `training_set_trainer` for every timed row with geometry. The bands there clean what a model learns from; a
    request has its features however far off its result was."""
    return _driver_features(results, geometry, leak_free, None)


def _driver_features(results: DataFrame, geometry: DataFrame, leak_free: bool, band: tuple[float, float] | None) -> DataFrame:
    keys = ("stage_id", "normalized_class")
    joined = results_inner_geometry(results.where(F.col("time_seconds") > 0).drop("ratio_to_class_best", "class_best_time"), geometry.where(F.col("hairpin_count").isNotNull()))
    joined = stored(joined.withColumn("_row", F.monotonically_increasing_id()))
    # Every series step walks rows of its own columns alone, written before, and totals of the same rows; what else a row holds
    # meets them at the end by the row's number.
    order = [*history.RALLY_ORDER, "stage_number", "result_id"]
    best = group_stats(joined.select("_row", "driver_id", "surface", *order, "time_seconds", *keys), keys, {"class_best_time": F.min("time_seconds")}, write=True)
    rated = best.withColumn("ratio_to_class_best", F.col("time_seconds") / F.col("class_best_time")).drop("time_seconds", *keys)
    rated = stored(facts.ratio_band(rated, "ratio_to_class_best", *band) if band else rated)
    if leak_free:
        featured = history.expanding_baseline(rated, history.RALLY_ORDER, place="driver_stage_count").withColumnRenamed("baseline_ratio", "driver_avg_ratio")
        featured = history.history_surface(stored(featured), base=rated).withColumnRenamed("driver_mean_ratio_surface", "driver_surface_ratio")
        featured = featured.withColumn("driver_surface_ratio", F.coalesce("driver_surface_ratio", "driver_avg_ratio"))
    else:
        featured = history.driver_stage_count(history.driver_means(rated))
    # The order is known now: a row is its place.
    featured = stored(featured.drop("surface", *order))
    featured = history.rolling_baseline(history.rolling_momentum(featured), base=rated, place="driver_stage_count")
    featured = featured.withColumn("correction_factor", F.col("ratio_to_class_best") / F.col("baseline_ratio"))
    return joined.join(featured.drop("driver_id"), "_row").drop("_row")


def training_readiness(results: DataFrame, geometry: DataFrame, least: int = 100) -> DataFrame:
    rows = results.where(F.col("time_seconds") > 0).join(geometry.select("stage_id"), "stage_id", "left_semi")
    out = rows.agg(F.count(F.lit(1)).alias("training_data_count"))
    return out.withColumn("can_train", F.col("training_data_count") > least)
