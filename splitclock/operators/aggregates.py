"""Aggregations: driver and geometry profiles, coverage, summaries, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitclock.functions.scoring import clip
from splitclock.functions.text import numeric_prefix
from splitclock.functions.times import parse_manual_time
from splitclock.operators.history import usable_ratios, value_ranks
from splitclock.operators.series import with_position
from splitclock.session import stored


def _count() -> Column:
    return F.count(F.lit(1))


def surface_profile(df: DataFrame) -> DataFrame:
    """Mean ratio and stage count per (driver, surface) with the driver's overall figures beside them, and the
    adjustment surface mean / overall mean. Overall includes rows without a surface."""
    timed = df.where((F.col("time_seconds") > 0) & F.col("ratio_to_class_best").isNotNull())
    per_surface = timed.groupBy("driver_id", F.lower("surface").alias("surface")).agg(
        F.sum("ratio_to_class_best").alias("_s"), _count().alias("experience")
    )
    overall = per_surface.groupBy("driver_id").agg((F.sum("_s") / F.sum("experience")).alias("overall_avg"), F.sum("experience").alias("overall_count"))
    out = per_surface.where(F.col("surface").isNotNull()).join(overall, "driver_id")
    target = F.col("_s") / F.col("experience")
    return out.select("driver_id", "surface", target.alias("target_avg"), "experience", "overall_avg", "overall_count", (target / F.col("overall_avg")).alias("adjustment"))


def surface_adjustment(profile: DataFrame, requests: DataFrame) -> DataFrame:
    """Adjustment of each requested (driver, surface); 1.0 where the driver never drove the surface."""
    want = requests.withColumn("surface", F.lower("surface"))
    out = want.join(profile.select("driver_id", "surface", "adjustment", "experience"), ["driver_id", "surface"], "left")
    return out.withColumns({"adjustment": F.coalesce("adjustment", F.lit(1.0)), "experience": F.coalesce("experience", F.lit(0).cast("bigint"))})


def surface_adjustment_guarded(df: DataFrame, least: int = 3) -> DataFrame:
    """The same per (driver, surface), 1.0 below ``least`` rows."""
    rated = df.where(F.col("ratio_to_class_best") > 0)
    out = surface_profile(rated.withColumn("time_seconds", F.lit(1.0)))
    return out.select("driver_id", "surface", "experience", F.when(F.col("experience") >= least, F.col("adjustment")).otherwise(1.0).alias("adjustment"))


def fallback_baseline(df: DataFrame, drivers: DataFrame, default: float = 1.1) -> DataFrame:
    """Plain mean ratio per requested driver; ``default`` for an unknown one."""
    mean = usable_ratios(df).groupBy("driver_id").agg(F.avg("ratio_to_class_best").alias("baseline_ratio"))
    return drivers.select("driver_id").distinct().join(mean, "driver_id", "left").withColumn("baseline_ratio", F.coalesce("baseline_ratio", F.lit(default)))


def driver_stats(df: DataFrame) -> DataFrame:
    timed = df.where((F.col("time_seconds") > 0) & F.col("ratio_to_class_best").isNotNull())
    return timed.groupBy("driver_id").agg(_count().alias("stage_count"), F.avg("ratio_to_class_best").alias("avg_ratio"))


def surface_experience(df: DataFrame) -> DataFrame:
    return df.where(F.col("time_seconds") > 0).groupBy("driver_id", F.lower("surface").alias("surface")).agg(_count().alias("experience"))


# Where a stage counts as high in each respect.
PROFILE_CONTRASTS = {
    "hairpin": ("hairpin_density", 0.8, "hairpin_performance"),
    "climb": ("total_ascent", 300.0, "climb_performance"),
    "curvature": ("p95_curvature", 0.005, "curvature_sensitivity"),
    "grade": ("max_grade", 8.0, "grade_performance"),
}


def geometry_profile(df: DataFrame, least_rows: int = 10, least_side: int = 5) -> DataFrame:
    """How much slower a driver is on high than on low stages, in four respects.

    ``df``: results left-joined to geometry. A metric of 0 or NULL is in neither group.
    """
    rows = df.where((F.col("time_seconds") > 0) & F.col("ratio_to_class_best").isNotNull())
    r = F.col("ratio_to_class_best")
    aggs = [_count().alias("total_stages"), F.count_if(F.col("hairpin_density") != 0).alias("stages_with_geometry")]
    for name, (metric, limit, _) in PROFILE_CONTRASTS.items():
        m = F.col(metric)
        high, low = (m != 0) & (m > limit), (m != 0) & (m <= limit)
        aggs += [
            F.count_if(high).alias(f"{name}_high"), F.count_if(low).alias(f"{name}_low"),
            F.avg(F.when(high, r)).alias(f"_{name}_high"), F.avg(F.when(low, r)).alias(f"_{name}_low"),
        ]
    g = rows.groupBy("driver_id").agg(*aggs).where(F.col("total_stages") >= least_rows)
    for name, (_, _, out) in PROFILE_CONTRASTS.items():
        enough = (F.col(f"{name}_high") >= least_side) & (F.col(f"{name}_low") >= least_side)
        g = g.withColumn(out, F.when(enough, F.try_divide(f"_{name}_high", f"_{name}_low"))).drop(f"_{name}_high", f"_{name}_low")
    weakest = F.least("hairpin_high", "hairpin_low", "climb_high", "climb_low")
    level = F.when(weakest >= 15, "HIGH").when(weakest >= 10, "MEDIUM").when(weakest >= 5, "LOW").otherwise("INSUFFICIENT")
    return g.withColumn("confidence", level)


def geometry_statistics(geometry: DataFrame) -> DataFrame:
    return geometry.agg(
        _count().alias("total_stages"), F.countDistinct("rally_id").alias("total_rallies"),
        F.avg("distance_km").alias("avg_distance_km"), F.avg("hairpin_count").alias("avg_hairpins"),
        F.avg("total_ascent").alias("avg_ascent_m"), F.min("distance_km").alias("min_distance_km"),
        F.max("distance_km").alias("max_distance_km"),
    )


def geometry_coverage(geometry: DataFrame, results: DataFrame) -> DataFrame:
    total = results.select("rally_id", "stage_number").distinct().agg(_count()).scalar()
    out = geometry.agg(_count().alias("stages_with_geometry")).withColumn("total_stages", total)
    return out.withColumn("coverage_percent", F.coalesce(F.try_divide(F.col("stages_with_geometry") * F.lit(100.0), F.col("total_stages")), F.lit(0.0)))


def dataset_overview(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows and distinct rallies, drivers, classes. ``approximate`` trades about 2 % error for one small pass."""
    distinct = (lambda c: F.approx_count_distinct(c, 0.02)) if approximate else F.countDistinct
    return df.agg(
        _count().alias("total_rows"), distinct("rally_id").alias("rallies"), distinct("driver_id").alias("drivers"), distinct("car_class").alias("classes")
    )


def class_distribution(df: DataFrame, raw: str = "car_class", normalized: str = "normalized_class") -> DataFrame:
    return df.groupBy(raw, normalized).agg(_count().alias("rows"))


def rally_summary(df: DataFrame) -> DataFrame:
    """Stages and rows per rally, newest first. Stages are counted over (rally, stage) rows, not in one big set."""
    per_stage = df.groupBy("rally_id", "stage_number").agg(_count().alias("_n"), F.max("rally_name").alias("_name"), F.max("rally_date").alias("_date"))
    out = per_stage.groupBy("rally_id").agg(
        F.coalesce(F.max("_name"), F.col("rally_id")).alias("rally_name"), F.max("_date").alias("rally_date"),
        _count().alias("stage_count"), F.sum("_n").alias("rows"),
    )
    return out.orderBy(F.col("rally_date").desc(), numeric_prefix(F.col("rally_id")).desc(), F.col("rally_id").desc())


def rally_stage_list(df: DataFrame) -> DataFrame:
    return df.groupBy("rally_id", "stage_number").agg(
        F.coalesce(F.max("stage_name"), F.concat(F.lit("SS"), F.col("stage_number"))).alias("stage_name"),
        F.max("stage_length_km").alias("stage_length_km"), F.lower(F.max("surface")).alias("surface"),
    )


def ambiguous_driver_names(df: DataFrame) -> DataFrame:
    pairs = df.select("driver_name", "driver_id").distinct()
    return pairs.groupBy("driver_name").agg(_count().alias("id_count")).where(F.col("id_count") > 1)


def pace_table(df: DataFrame, surface: str, low_km: float, high_km: float) -> DataFrame:
    rows = df.where(F.col("stage_length_km").between(low_km, high_km) & (F.col("surface") == surface) & (F.col("time_seconds") > 0))
    best = rows.groupBy("stage_id", "stage_length_km", "car_class").agg(F.min("time_seconds").alias("class_best_time"))
    return best.withColumn("time_per_km", F.col("class_best_time") / F.col("stage_length_km"))


def best_pace_reference(df: DataFrame, surface: str, low_km: float, high_km: float) -> DataFrame:
    """Fastest leader pace per class over a length band, with the number of rows behind it."""
    best = df.where(F.col("time_seconds") > 0).groupBy("stage_id", "car_class").agg(F.min("time_seconds").alias("_best"))
    rows = df.where(F.col("stage_length_km").between(low_km, high_km) & (F.col("surface") == surface) & (F.col("stage_length_km") > 0))
    counted = rows.groupBy("stage_id", "car_class", "stage_length_km").agg(_count().alias("_n"))
    joined = counted.join(best, ["stage_id", "car_class"])
    return joined.groupBy("car_class").agg(F.min(F.col("_best") / F.col("stage_length_km")).alias("best_time_per_km"), F.sum("_n").alias("sample_count"))


def majority_value(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], name: str | None = None) -> DataFrame:
    """Most frequent value per key, leaving out NULL, '' and 'unknown'; of equal counts the first seen along ``order``."""
    rows = df.where(F.col(value).isNotNull())
    if dict(df.dtypes)[value] == "string":
        rows = rows.where(~F.col(value).isin("", "unknown"))
    counted = rows.groupBy(*keys, value).agg(_count().alias("_n"), F.min(F.struct(*order)).alias("_first"))
    best = F.min_by(value, F.struct((-F.col("_n")).alias("n"), "_first"))
    return counted.groupBy(*keys).agg(best.alias(name or value))


def name_variants(df: DataFrame, standard) -> DataFrame:
    """Spellings that differ only in case: the variants, their row counts, and the standard form of the first."""
    counted = df.where(F.coalesce("driver_name", F.lit("")) != "").groupBy("driver_name").agg(_count().alias("_n"))
    g = counted.groupBy(F.upper("driver_name").alias("name_key")).agg(
        _count().alias("variants"), F.sum("_n").alias("rows"), F.min("driver_name").alias("_first"),
        F.array_sort(F.collect_set("driver_name")).alias("spellings"),
    )
    return g.where("variants > 1").select("name_key", "variants", "rows", F.array_join("spellings", "|").alias("spellings"), standard(F.col("_first")).alias("standard_name"))


def batch_summary(predictions: DataFrame) -> DataFrame:
    level = F.col("confidence_level")
    return predictions.agg(
        _count().alias("total_predictions"), F.avg("predicted_ratio").alias("avg_ratio"), F.count_if(level == "HIGH").alias("high"),
        F.count_if(level == "MEDIUM").alias("medium"), (_count() - F.count_if(level.isin("HIGH", "MEDIUM"))).alias("low"),
    )


def _counted_pairs(df: DataFrame, keys: Sequence[str], actual: Column, predicted: Column) -> DataFrame:
    """One row for each different (actual, predicted) of a group with its number of rows ``_n``, written once. Rows without one of
    the two do not count."""
    rows = df.select(*keys, actual.cast("double").alias("y"), predicted.cast("double").alias("p")).where("y IS NOT NULL AND p IS NOT NULL")
    return stored(rows.groupBy(*keys, "y", "p").agg(_count().alias("_n")))


def _rank_correlation(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _rows, spearman) from counted pairs: the ranks of either value come from its own counts, and the mean rank of n rows
    is (n + 1) / 2."""
    ranked = pairs.join(value_ranks(pairs, keys, "y", "ry"), [*keys, "y"]).join(value_ranks(pairs, keys, "p", "rp"), [*keys, "p"])
    n = F.col("_n").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum("_n").alias("_rows"), F.sum(n * F.col("ry") * F.col("rp")).alias("_yp"), F.sum(n * F.col("ry") * F.col("ry")).alias("_yy"), F.sum(n * F.col("rp") * F.col("rp")).alias("_pp")
    )
    shift = F.col("_rows") * ((F.col("_rows") + 1) / 2) * ((F.col("_rows") + 1) / 2)
    own = lambda c: F.when(F.col(c) - shift > 1e-12 * shift, F.col(c) - shift)  # noqa: E731  (constant values have no rank correlation)
    spread = F.sqrt(own("_yy") * own("_pp"))
    return sums.select(*keys, "_rows", F.try_divide(F.col("_yp") - shift, spread).alias("spearman"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """MAE, MAPE, RMSE, R2, target mean and deviation, and the rank correlation, in one row, over the rows that have both values."""
    p = F.col(predicted)
    if low is not None and high is not None:
        p = clip(p, low, high)
    pairs = _counted_pairs(df, [], F.col(actual), p)
    w, err = F.col("_n"), F.col("y") - F.col("p")
    n = F.sum(w)
    mean = lambda c: F.sum(c * w) / F.sum(F.when(c.isNotNull(), w))
    centre = pairs.agg(mean(F.col("y")).alias("_mean")).scalar()
    off = (F.col("y") - F.col("_mean")) * (F.col("y") - F.col("_mean"))
    out = pairs.withColumn("_mean", centre).agg(
        F.coalesce(n, F.lit(0).cast("bigint")).alias("n"), mean(F.abs(err)).alias("mae"), mean(F.abs(F.try_divide(err, F.col("y")))).alias("mape"), F.sqrt(mean(err * err)).alias("rmse"),
        (1 - F.try_divide(mean(err * err), mean(off))).alias("r2"), mean(F.col("y")).alias("mean_target"), F.sqrt(F.try_divide(F.sum(off * w), n - 1)).alias("std_target"),
    )
    return out.withColumn("spearman", _rank_correlation(pairs, []).select("spearman").scalar())


def metrics_by_class(df: DataFrame, actual: str, predicted: str, key: str = "car_class", least: int = 5) -> DataFrame:
    mape = F.avg(F.abs(F.try_divide(F.col(actual) - F.col(predicted), F.col(actual)))) * 100
    return df.groupBy(key).agg(_count().alias("n_samples"), mape.alias("mape")).where(F.col("n_samples") >= least)


def rank_agreement(df: DataFrame, actual: str, predicted: str, key: str = "stage_id", least: int = 3) -> DataFrame:
    """Mean rank correlation over groups of at least ``least`` rows, and the share above 0.9."""
    ranked = _rank_correlation(_counted_pairs(df, [key], F.col(actual), F.col(predicted)), [key])
    per = ranked.where(F.col("_rows") >= least).withColumnRenamed("spearman", "_r")
    return per.agg(_count().alias("groups"), F.avg("_r").alias("mean_spearman"), F.avg((F.col("_r") > 0.9).cast("double")).alias("share_above_0_9"))


def steward_estimate(references: DataFrame, targets: DataFrame, gap_warning: float = 5.0) -> DataFrame:
    """Two notional times from reference stages: by seconds lost per km and by ratio.

    ``references``: request_id, km, best_time, driver_time (texts). Wholly empty rows do not count; rows with a gap or
    an unreadable time are ignored and counted. ``targets``: request_id, km, best_time.
    """
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    best, own = parse_manual_time(F.col("best_time")), parse_manual_time(F.col("driver_time"))
    km = F.when(F.col("km") > 0, F.col("km"))
    r = references.where(km.isNotNull() | filled(F.col("best_time")) | filled(F.col("driver_time"))).select("request_id", km.alias("_km"), best.alias("_best"), own.alias("_own"))
    ok = F.col("_km").isNotNull() & F.col("_best").isNotNull() & F.col("_own").isNotNull()
    g = r.groupBy("request_id").agg(
        F.count_if(ok).alias("used_stage_count"), F.count_if(~ok).alias("ignored_stage_count"),
        F.avg(F.when(ok, (F.col("_own") - F.col("_best")) / F.col("_km"))).alias("average_diff_per_km"),
        F.avg(F.when(ok, F.col("_own") / F.col("_best"))).alias("average_ratio"),
    )
    t = targets.select("request_id", F.col("km").alias("target_km"), parse_manual_time(F.col("best_time")).alias("target_best_seconds"))
    out = t.join(g, "request_id", "left")
    by_km = F.col("target_best_seconds") + F.col("average_diff_per_km") * F.col("target_km")
    by_ratio = F.col("target_best_seconds") * F.col("average_ratio")
    gap = F.abs(by_km - by_ratio)
    error = (
        F.when(~(F.col("target_km") > 0), "target_km").when(F.col("target_best_seconds").isNull(), "target_best_time")
        .when(F.coalesce("used_stage_count", F.lit(0)) == 0, "no_reference_stage")
    )
    good = error.isNull()
    return out.select(
        "request_id", F.coalesce("used_stage_count", F.lit(0).cast("bigint")).alias("used_stage_count"),
        F.coalesce("ignored_stage_count", F.lit(0).cast("bigint")).alias("ignored_stage_count"),
        "average_diff_per_km", "average_ratio",
        F.when(good, by_km).alias("km_based_prediction_seconds"), F.when(good, by_ratio).alias("percentage_prediction_seconds"),
        F.when(good, gap).alias("methods_gap_seconds"), (good & (F.col("used_stage_count") == 1)).alias("single_stage_warning"),
        F.coalesce(good & (gap >= gap_warning), F.lit(False)).alias("gap_warning"), error.alias("error"),
    )


def ingest_stats(pages: DataFrame) -> DataFrame:
    """``pages``: rows_found (NULL for an unreadable page), is_event."""
    found = F.col("rows_found")
    return pages.agg(
        _count().alias("total_checked"), F.count_if((found > 0) & F.col("is_event")).alias("rally_found"), F.count_if(~F.col("is_event")).alias("skipped"),
        F.count_if(found.isNull()).alias("error"), F.coalesce(F.sum(found), F.lit(0)).alias("rows"),
    )


def importance_mean_abs(attributions: DataFrame) -> DataFrame:
    return attributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))


def prediction_summary(log: DataFrame) -> DataFrame:
    """Counts by status and verdict, mean error and the two rates, over the whole log."""
    s = F.col("comparison_status")
    a = F.coalesce(F.col("accepted"), F.lit(-1))
    g = log.agg(
        _count().alias("total_predictions"), F.count_if(s == "pending").alias("pending_count"), F.count_if(s == "matched").alias("matched_count"),
        F.count_if(s == "actual_missing").alias("actual_missing_count"), F.count_if(a == 1).alias("accepted_count"),
        F.count_if((a == 0) & (s == "matched")).alias("rejected_count"), F.round(F.avg("error_pct"), 3).alias("avg_error_pct"),
        F.count_if(F.col("used_geometry") == 1).alias("geometry_used_count"),
        F.count_if(F.array_contains("data_quality_flags", "baseline_only")).alias("baseline_only_count"),
    )
    pct = lambda x, y: F.round(F.try_divide(F.col(x) * F.lit(100.0), F.nullif(F.col(y), F.lit(0))), 2)
    return g.withColumns({"acceptance_rate_pct": pct("accepted_count", "matched_count"), "geometry_usage_rate_pct": pct("geometry_used_count", "total_predictions")})


def flag_breakdown(log: DataFrame) -> DataFrame:
    return log.select(F.explode("data_quality_flags").alias("flag")).groupBy("flag").agg(_count().alias("count"))


def filter_options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of several columns as (option, value) rows."""
    parts = [df.select(F.lit(c).alias("option"), F.col(c).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct() for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def order_by_numeric_id(df: DataFrame, column: str = "rally_id") -> DataFrame:
    return df.orderBy(numeric_prefix(F.col(column)).desc(), F.col(column).desc())


def temporal_split(df: DataFrame, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Label rows train / val / test by rally in date order, so no rally is in two parts.

    A single rally is split by row order instead. The rally list is a small aggregate; rows only join to it.
    """
    rallies = df.groupBy("rally_id").agg(F.min("rally_date").alias("_date"))
    n = rallies.agg(_count()).scalar()
    ranked = with_position(rallies, [], ["_date", "rally_id"], ["_date"], "_rank").withColumn("_n", n)
    label = lambda pos, total: (
        F.when(pos <= F.floor(total * train), "train").when(pos <= F.floor(total * train) + F.floor(total * validation), "val").otherwise("test")
    )
    labelled = ranked.withColumn("_by_rally", F.when(F.col("_n") > 1, label(F.col("_rank"), F.col("_n"))))
    out = df.join(labelled.select("rally_id", "_by_rally"), "rally_id")
    if rallies.limit(2).count() > 1:
        # Rows need no numbers where rallies tell the part.
        return out.where(F.col("stage_number").isNotNull()).withColumnRenamed("_by_rally", "split")
    placed = with_position(out, ["rally_id"], ["stage_number", "result_id"], ["stage_number"], "_pos")
    rows = df.agg(_count()).scalar()
    return placed.withColumn("split", F.coalesce("_by_rally", label(F.col("_pos"), rows))).drop("_by_rally", "_pos")


def random_split(df: DataFrame, key: str = "result_id", train_pct: int = 80, seed: int = 42) -> DataFrame:
    """Label rows by a hash of their key that other engines have too: the same row falls into the same part in every run
    and plan. The first 32 bits of the MD5 of key and seed, modulo 100, are below ``train_pct`` for training rows."""
    place = F.conv(F.substring(F.md5(F.concat_ws("_", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("split", F.when(place < train_pct, "train").otherwise("val"))


def stages_union_geometry(stages: DataFrame, geometry: DataFrame) -> DataFrame:
    """Stages known only from geometry are added to the list."""
    only = geometry.join(stages, "stage_id", "left_anti").select("stage_id", "rally_id", "stage_number", "surface", F.col("distance_km").alias("stage_length_km"))
    cols = ["stage_id", "rally_id", "stage_number", "surface", "stage_length_km"]
    return stages.select(*cols).unionByName(only.select(*cols))


def fallback_source(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of the first table, and of the second those whose key the first does not have."""
    return first.unionByName(second.select(*first.columns).join(first.select(key).distinct(), key, "left_anti").select(*first.columns))
