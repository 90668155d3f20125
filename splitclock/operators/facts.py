"""Class leaders, ratios and positions of timed results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitclock.functions.text import build_stage_id, year_from_text
from splitclock.operators.series import exact_quantiles, group_stats, with_position

VALID_STATUS = ("FINISHED", "OK")


def canonical_results(df: DataFrame) -> DataFrame:
    """Resolve once what every later step would otherwise coalesce again: driver, class, name and stage keys."""
    have = set(df.columns)

    def first(*names: str) -> Column:
        present = [F.col(n) for n in names if n in have]
        return F.coalesce(*present) if present else F.lit(None)

    out = {
        "driver_id": first("driver_id", "driver_name").cast("string"),
        "normalized_class": first("normalized_class", "car_class"),
        "raw_driver_name": first("raw_driver_name", "driver_name"),
        "stage_id": F.coalesce(first("stage_id"), build_stage_id(F.col("rally_id"), F.col("stage_number"))),
    }
    return df.withColumns(out)


def valid_results(df: DataFrame) -> DataFrame:
    return df.where(
        F.col("status").isin(*VALID_STATUS) & (F.col("time_seconds") > 0) & (F.col("stage_length_km") > 0)
    )


def filter_diagnostics(df: DataFrame) -> DataFrame:
    status = F.col("status").isin(*VALID_STATUS)
    time = F.coalesce(F.col("time_seconds") > 0, F.lit(False))
    length = F.coalesce(F.col("stage_length_km") > 0, F.lit(False))
    keep = status & time & length
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(status).alias("status_rows"),
        F.count_if(time).alias("time_rows"),
        F.count_if(length).alias("length_rows"),
        F.count_if(keep).alias("kept_rows"),
        (F.count(F.lit(1)) - F.count_if(keep)).alias("removed_rows"),
    )


def season_filter(df: DataFrame, excluded: Sequence[int], name: str = "rally_name") -> DataFrame:
    """Rows whose name has no year, or one that is not among ``excluded``; the year is added as ``season``."""
    season = F.coalesce(year_from_text(F.col(name)), F.lit(""))
    return df.withColumn("season", season).where(~F.col("season").isin([str(y) for y in excluded]))


def finishers(df: DataFrame, class_col: str = "normalized_class") -> DataFrame:
    return df.where((F.col("time_seconds") > 0) & F.col(class_col).isNotNull())


def class_best(df: DataFrame, keys: Sequence[str] = ("stage_id", "normalized_class"), driver: str = "raw_driver_name") -> DataFrame:
    """Best time, its driver (smallest name on a tie) and the number of finishers per group."""
    best = F.min(F.struct(F.col("time_seconds"), F.col(driver)))
    return (
        finishers(df, keys[-1])
        .groupBy(*keys)
        .agg(best.alias("_best"), F.count(F.lit(1)).alias("finisher_count"))
        .select(
            *keys,
            F.col("_best.time_seconds").alias("class_best_time"),
            F.col(f"_best.{driver}").alias("class_best_driver"),
            "finisher_count",
        )
    )


def class_reference_times(df: DataFrame, keys: Sequence[str] = ("stage_id", "car_class")) -> DataFrame:
    """Best, count and median time per group."""
    base = df.groupBy(*keys).agg(F.min("time_seconds").alias("best_time"), F.count(F.lit(1)).alias("n_finishers"))
    return base.join(exact_quantiles(df, keys, "time_seconds", {"median_time": 0.5}), list(keys))


def results_with_class_best(df: DataFrame, keys: Sequence[str] = ("stage_id", "normalized_class"), write: bool = False) -> DataFrame:
    """Every timed row beside its class leader's time; with ``write`` the leaders are written first (``group_stats``)."""
    return group_stats(df.where(F.col("time_seconds") > 0), keys, {"class_best_time": F.min("time_seconds")}, write=write)


def ratio_to_class_best(df: DataFrame, keys: Sequence[str] = ("stage_id", "normalized_class"), write: bool = False) -> DataFrame:
    """Own time over the leader's time of the class; 1.0 for the leader."""
    return results_with_class_best(df, keys, write).withColumn(
        "ratio_to_class_best", F.col("time_seconds") / F.col("class_best_time")
    )


def class_position(df: DataFrame, keys: Sequence[str] = ("stage_id", "normalized_class")) -> DataFrame:
    """Place in class by time, then result id. Blocks are whole seconds, so a large class spreads over many tasks."""
    timed = df.where(F.col("time_seconds") > 0).withColumn("_second", F.floor("time_seconds"))
    return with_position(timed, keys, ["time_seconds", "result_id"], ["_second"], "class_position").drop("_second")


def ratio_band(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where((F.col(column) > low) & (F.col(column) < high))


def min_history_filter(df: DataFrame, least: int, key: str = "driver_id") -> DataFrame:
    keep = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key)
    return df.join(keep, key, "left_semi")


def anomaly_tags(
    df: DataFrame,
    keys: Sequence[str] = ("rally_id", "stage_id", "car_class"),
    adaptive: bool = True,
    base_ratio: float = 1.5,
    z_limit: float = 3.0,
    z_limit_short: float = 3.5,
    short_km: float = 7.0,
    min_speed_gravel: float = 30.0,
    min_speed_asphalt: float = 40.0,
    max_speed: float = 250.0,
) -> DataFrame:
    """Tag outliers: far behind the class leader, far from the class mean, or impossible speeds.

    ``adaptive`` widens the z limit on short stages. Groups of fewer than three rows get only the speed rules.
    """
    stats = {
        "_best": F.min("time_seconds"),
        "_mean": F.avg("time_seconds"),
        "_std": F.stddev_pop("time_seconds"),
        "_n": F.count(F.lit(1)),
    }
    t, km = F.col("time_seconds"), F.col("stage_length_km")
    grouped = (F.col("_n") >= 3) & (F.col("_best") > 0)
    far = F.coalesce(grouped & (t / F.col("_best") > base_ratio * (1 + km / 50)), F.lit(False))
    limit = F.when(km < short_km, z_limit_short).otherwise(z_limit) if adaptive else F.lit(z_limit)
    z = F.abs(t - F.col("_mean")) / F.when(F.col("_std") > 0, F.col("_std"))
    odd = F.coalesce(grouped & (z > limit), F.lit(False))
    speed = F.when(t > 0, km / t * 3600).otherwise(0.0)
    least = F.when(F.col("surface") == "asphalt", min_speed_asphalt).otherwise(min_speed_gravel)
    reason = (
        F.when(speed < least, "speed_too_low")
        .when(speed > max_speed, "speed_too_high")
        .when(far, "ratio_outlier")
        .when(odd, "z_score_outlier")
    )
    tagged = group_stats(df, keys, stats).withColumn("anomaly_reason", reason)
    return tagged.withColumn("is_anomaly", F.col("anomaly_reason").isNotNull()).drop(*stats)


def anomaly_report(tagged: DataFrame) -> DataFrame:
    """Rows and share per reason, over all rows."""
    counts = tagged.groupBy(F.coalesce("anomaly_reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
    total = tagged.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col("rows") / total)


def repair_time_seconds(df: DataFrame, limit: float = 1.0) -> DataFrame:
    """Recompute seconds from the time text and the length from the stage title; ``changed`` marks rows whose stored
    time is off by more than ``limit`` seconds. A row without a stored time is never marked."""
    from splitclock.functions.text import length_from_name
    from splitclock.functions.times import parse_live_time

    new = parse_live_time(F.coalesce("time_str", F.lit("")))
    off = F.coalesce(F.abs(F.nullif("time_seconds", F.lit(0.0)) - new) > limit, F.lit(False))
    return df.withColumns({"new_time": new, "changed": off, "new_length": length_from_name(F.col("stage_name"))})
