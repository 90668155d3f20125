"""Constants-and-steps expressions: reference times, confidence scores, quality flags, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from splitclock.functions.classes import LIVE_CLASS_FACTORS, MANUAL_CLASS_FACTORS, class_factor, literal_map


def clip(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(col, F.lit(high)))


def reference_time_live(km: Column, surface: Column, normalized_class: Column, hairpin_density: Column | None = None, avg_abs_grade: Column | None = None) -> Column:
    """Seconds of the class leader on a stage of this length, surface and difficulty."""
    speed = F.when(surface == "asphalt", 105.0).when(surface == "snow", 70.0).otherwise(85.0)
    zero = F.lit(0.0)
    density = F.coalesce(hairpin_density, zero) if hairpin_density is not None else zero
    grade = F.coalesce(avg_abs_grade, zero) if avg_abs_grade is not None else zero
    difficulty = F.least(1.0 + density * 0.02 + grade * 0.005, F.lit(1.3))
    return km / (speed / class_factor(normalized_class, LIVE_CLASS_FACTORS) / difficulty) * 3600


def reference_time_manual(km: Column, surface: Column, normalized_class: Column, car_class: Column | None = None) -> Column:
    speed = F.when(surface == "asphalt", 100.0).otherwise(85.0)
    return km / (speed / class_factor(normalized_class, MANUAL_CLASS_FACTORS, second=car_class)) * 3600


def _steps(value: Column, steps: list[tuple[float, int]], otherwise: int) -> Column:
    out = None
    for least, score in steps:
        out = F.when(value >= least, score) if out is None else out.when(value >= least, score)
    return out.otherwise(otherwise)


def confidence_v2(history: Column, surface_stages: Column, has_geometry: Column, profile: Column, rally_stages: Column, baseline: Column, mode: Column) -> Column:
    """Struct of the four part scores (40/25/20/15 at most), the penalty, the total and the level."""
    hist = _steps(history, [(20, 40), (15, 36), (10, 30), (5, 20), (2, 10)], 4)
    surf = _steps(surface_stages, [(15, 25), (10, 21), (5, 16), (2, 10)], 5)
    geo = F.when(~has_geometry | (mode == "fallback"), 6).when(profile >= 0.8, 20).when(profile >= 0.5, 15).otherwise(10)
    mom = F.when(rally_stages >= 4, 15).when(rally_stages >= 2, 10).when(rally_stages == 1, 6).otherwise(3)
    penalty = F.when(baseline > 1.20, 10).when(baseline < 0.95, 5).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), hist + surf + geo + mom - penalty))
    level = F.when(score >= 75, "HIGH").when(score >= 55, "MEDIUM").when(score >= 35, "LOW").otherwise("VERY_LOW")
    return F.struct(
        hist.alias("historical"), surf.alias("surface"), geo.alias("geometry"), mom.alias("momentum"),
        penalty.alias("penalty"), score.alias("score"), level.alias("level"),
    )


def level_of(score: Column) -> Column:
    return F.when(score >= 75, "HIGH").when(score >= 55, "MEDIUM").otherwise("LOW")


def confidence_service(rallies: Column, stages: Column, momentum_stages: Column, geometry_used: Column, surface_adj: Column) -> Column:
    z = F.lit(0)
    score = (
        30
        + F.least(F.coalesce(rallies, z) * 5, F.lit(20))
        + F.least(F.coalesce(stages, z), F.lit(15))
        + F.least(F.coalesce(momentum_stages, z) * 3, F.lit(15))
        + F.when(geometry_used, 10).otherwise(0)
        + F.when(F.abs(surface_adj - 1.0) > 1e-6, 5).otherwise(0)
    )
    return F.least(score, F.lit(100)).cast("double")


def confidence_manual(ratios: Column, surface_ratios: Column) -> Column:
    return F.least(F.lit(100), 30 + ratios * 4 + surface_ratios * 2)


def confidence_simple(mode: Column, has_features: Column, profile: Column, baseline: Column) -> Column:
    score = (
        1.0
        - F.when(mode == "fallback", 0.3).otherwise(0.0)
        - F.when(~has_features, 0.2).when(F.coalesce(profile, F.lit(0.0)) < 0.5, 0.15).otherwise(0.0)
        - F.when((baseline > 1.15) | (baseline < 0.95), 0.1).otherwise(0.0)
    )
    return F.round(clip(score, 0.1, 1.0), 6)


def simple_level(score: Column) -> Column:
    return F.when(score >= 0.8, "HIGH").when(score >= 0.6, "MEDIUM").when(score >= 0.4, "LOW").otherwise("VERY_LOW")


def confidence_numeric(level: Column) -> Column:
    return F.when(level == "HIGH", 1.0).when(level == "MEDIUM", 0.7).when(level == "LOW", 0.4).when(level == "INSUFFICIENT", 0.1).otherwise(0.5)


def confidence_weight(level: Column) -> Column:
    return F.when(level == "HIGH", 0.9).when(level == "MEDIUM", 0.6).when(level == "LOW", 0.3).when(level == "INSUFFICIENT", 0.1).otherwise(0.5)


def momentum_factor(momentum: Column) -> Column:
    return clip(1.0 - momentum, 0.90, 1.10)


# Form texts by momentum, strongest first, and the trend texts.
FORM_STATUS = [(0.03, "Mukemmel form"), (0.01, "Iyi form"), (-0.01, "Normal form"), (-0.03, "Dusuk form")]
WORST_FORM = "Kotu form"
NOT_STARTED = "Ralli henuz baslamadi"
TREND_UP, TREND_DOWN, TREND_FLAT, TREND_UNKNOWN = "yukseliyor", "dusuyor", "sabit", "yetersiz veri"


def momentum_status(momentum: Column) -> Column:
    out = F.when(momentum > FORM_STATUS[0][0], FORM_STATUS[0][1])
    for bound, text in FORM_STATUS[1:]:
        out = out.when(momentum > bound, text)
    return out.otherwise(WORST_FORM)


def _nz(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def elevation_status(km: Column, ascent: Column, descent: Column, grade: Column, high: Column, low: Column) -> Column:
    some = (_nz(ascent) != 0) | (_nz(descent) != 0) | (_nz(grade) != 0) | (_nz(high) != 0) | (_nz(low) != 0)
    return F.when(missing_elevation(km, ascent, descent, grade), "missing").when(some, "available").otherwise("missing")


def missing_elevation(km: Column, ascent: Column, descent: Column, grade: Column) -> Column:
    """A stage over 3 km without any ascent, descent or grade."""
    return (_nz(km) > 3) & (_nz(ascent) == 0) & (_nz(descent) == 0) & (_nz(grade) == 0)


def geometry_status(km: Column, ascent: Column, descent: Column, grade: Column) -> Column:
    return F.when(missing_elevation(km, ascent, descent, grade), "red_flag_missing_elevation").otherwise("validated")


def geometry_trusted(geometry_status_: Column, elevation_status_: Column) -> Column:
    return F.coalesce((geometry_status_ == "validated") & (F.coalesce(elevation_status_, F.lit("")) != "missing"), F.lit(False))


def quality_flags(geometry_status_: Column, elevation_status_: Column) -> Column:
    """Sorted flags of a prediction, from the state of its stage geometry."""
    trusted = geometry_trusted(geometry_status_, elevation_status_)
    flags = F.array(
        F.when(~trusted & geometry_status_.isNotNull(), geometry_status_),
        F.when(~trusted & geometry_status_.isNull(), "geometry_missing"),
        F.when(elevation_status_ == "missing", "elevation_missing"),
        F.when(trusted, "geometry_trusted").otherwise("baseline_only"),
    )
    return F.array_sort(F.array_distinct(F.array_compact(flags)))


def flag_union(a: Column, b: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))


# The signs shown beside a confidence level.
LEVEL_SIGNS = {"HIGH": "🟢", "MEDIUM": "🟡", "LOW": "🟠", "VERY_LOW": "🔴"}


def summary_text(driver: Column, stage: Column, time_text: Column, ratio: Column, level: Column) -> Column:
    """One line: who, where, the time, how far from the class leader, how sure."""
    pct = (ratio - 1) * 100
    speed = (
        F.when(F.abs(pct) < 0.5, "sinif lideriyle benzer")
        .when(pct > 0, F.format_string("sinif liderinden %%%.1f yavas", pct))
        .otherwise(F.format_string("sinif liderinden %%%.1f hizli", F.abs(pct)))
    )
    sign = F.coalesce(F.try_element_at(literal_map(LEVEL_SIGNS), level), F.lit(""))
    return F.concat(
        driver, F.lit(" - "), stage, F.lit(": Tahmini "), time_text, F.lit(" ("), speed, F.lit(") - Guven: "),
        level, F.lit(" "), sign,
    )
