"""The feedback loop: log views, issue worklist, resolution of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitclock.functions.scoring import flag_union
from splitclock.functions.times import format_minutes
from splitclock.operators.lookups import ACCEPTED_ERROR_PCT, compare_predictions, log_with_names

# Issue type -> (priority, title). The order is the order in which issues of one row are listed.
ISSUES = {
    "red_flag_missing_elevation": ("P1", "Kirmizi Bayrak: Yukseklik Eksik"),
    "elevation_missing": ("P2", "Yukseklik Verisi Eksik"),
    "geometry_missing": ("P2", "Geometri Kaydi Eksik"),
    "actual_missing": ("P1", "Gercek Sonuc Eksik"),
    "pending_compare": ("P3", "Karsilastirma Bekliyor"),
    "high_error": ("P1", "Yuksek Tahmin Hatasi"),
    "baseline_only": ("P2", "Sadece Baseline Modu"),
}
# Where the user goes to settle an issue (page, section, label).
TARGETS = {
    "results": ("Veri Cek", "Database Yukle", "Sonuc Merge"),
    "live": ("Tahmin Yap", "Canli Tahmin", "Canli Akis"),
    "geometry": ("KML Yonetimi", "Manuel Analiz", "Geometriyi Duzenle"),
    "manual": ("Tahmin Yap", "Manuel Tahmin", "Tahmini Gozden Gecir"),
    "stage": ("KML Yonetimi", "Manuel Analiz", "Etabi Incele"),
}
GEOMETRY_ISSUES = ("geometry_missing", "elevation_missing", "red_flag_missing_elevation", "baseline_only")


def _flags() -> Column:
    return F.coalesce("data_quality_flags", F.array().cast("array<string>"))


def _target(issue: str, has_manual: Column) -> Column:
    def t(key: str) -> Column:
        page, section, label = TARGETS[key]
        return F.struct(F.lit(page).alias("page"), F.lit(section).alias("section"), F.lit(label).alias("label"))

    if issue == "actual_missing":
        return t("results")
    if issue == "pending_compare":
        return t("live")
    if issue in GEOMETRY_ISSUES:
        return t("geometry")
    return F.when(has_manual, t("manual")).otherwise(t("stage"))


def issue_worklist(log: DataFrame, high_error_pct: float = ACCEPTED_ERROR_PCT) -> DataFrame:
    """One row per open issue of the log. Whatever is in ``resolved_issue_types`` is left out.

    A geometry problem shows once, at its most serious; "baseline only" shows only when no geometry problem explains
    it; rows entered by hand are not asked for geometry.
    """
    flags = _flags()
    has = lambda f: F.array_contains(flags, f)
    status = F.coalesce("comparison_status", F.lit(""))
    by_hand = (status == "not_applicable") & has("manual_input")
    red, elev, geo = has("red_flag_missing_elevation"), has("elevation_missing"), has("geometry_missing")
    conditions = {
        "red_flag_missing_elevation": red,
        "elevation_missing": ~red & elev & ~by_hand,
        "geometry_missing": ~red & ~elev & geo & ~by_hand,
        "actual_missing": status == "actual_missing",
        "pending_compare": status == "pending",
        "high_error": F.coalesce((status == "matched") & (F.col("error_pct") > high_error_pct), F.lit(False)),
        "baseline_only": has("baseline_only") & ~by_hand & ~red & ~elev & ~geo,
    }
    resolved = F.coalesce("resolved_issue_types", F.array().cast("array<string>")) if "resolved_issue_types" in log.columns else F.array().cast("array<string>")
    entries = [
        F.when(
            cond & ~F.array_contains(resolved, issue),
            F.struct(F.lit(issue).alias("issue_type"), F.lit(ISSUES[issue][0]).alias("priority"), F.lit(ISSUES[issue][1]).alias("issue_title"), _target(issue, has("manual_input")).alias("action_target")),
        )
        for issue, cond in conditions.items()
    ]
    return log.withColumn("_issue", F.explode(F.array_compact(F.array(*entries)))).select(*log.columns, "_issue.*")


def worklist_top(issues: DataFrame, limit: int) -> DataFrame:
    return issues.orderBy("priority", F.col("prediction_id").desc(), "issue_type").limit(limit)


def issue_breakdown(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type", "issue_title", "priority").agg(F.count(F.lit(1)).alias("count"))


def open_issues(issue_types: Column, resolved: Column) -> Column:
    """Issue types of a row that are not resolved yet."""
    return F.array_except(issue_types, F.coalesce(resolved, F.array().cast("array<string>")))


def resolve_issues(log: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Add resolved issue types, notes, source and time to the named predictions.

    ``resolutions``: prediction_id (unique), issue_types, note, source, at. Types form a sorted set; distinct notes
    are joined by " | "; an empty list of types changes nothing.
    """
    r = resolutions.where(F.size("issue_types") > 0).select(
        "prediction_id", F.col("issue_types").alias("_types"), F.nullif(F.trim("note"), F.lit("")).alias("_note"), F.col("source").alias("_source"), F.col("at").alias("_at")
    )
    have = set(log.columns)
    old = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    j = log.join(r, "prediction_id", "left")
    hit = F.col("_types").isNotNull()
    notes = F.array_distinct(F.array_compact(F.array(F.nullif(F.trim(old("resolution_note", "string")), F.lit("")), F.col("_note"))))
    return j.withColumns(
        {
            "resolved_issue_types": F.when(hit, flag_union(old("resolved_issue_types", "array<string>"), F.col("_types"))).otherwise(old("resolved_issue_types", "array<string>")),
            "resolution_note": F.when(hit, F.nullif(F.array_join(notes, " | "), F.lit(""))).otherwise(old("resolution_note", "string")),
            "resolution_source": F.when(hit, F.col("_source")).otherwise(old("resolution_source", "string")),
            "resolved_at": F.when(hit, F.col("_at")).otherwise(old("resolved_at", "timestamp")),
        }
    ).drop("_types", "_note", "_source", "_at")


def actuals_recheck(log: DataFrame, actuals: DataFrame) -> DataFrame:
    """Compare again whatever missed its actual, and close the issue where one has come in since."""
    missing = F.col("comparison_status") == "actual_missing"
    again = log.withColumn("_was", missing).withColumn("comparison_status", F.when(missing, "pending").otherwise(F.col("comparison_status")))
    waiting = F.col("_was") | (F.col("comparison_status") != "pending")
    done = compare_predictions(again.where(waiting), actuals).unionByName(again.where(~waiting), allowMissingColumns=True)
    closed = F.col("_was") & (F.col("comparison_status") == "matched")
    old = F.col("resolved_issue_types") if "resolved_issue_types" in log.columns else F.lit(None).cast("array<string>")
    return done.withColumn("resolved_issue_types", F.when(closed, flag_union(old, F.array(F.lit("actual_missing")))).otherwise(old)).drop("_was")


def newest_log_rows(log: DataFrame, drivers: DataFrame, limit: int = 200) -> DataFrame:
    """The newest log rows by comparison (else prediction) time, with names and display texts."""
    top = log.orderBy(F.coalesce("compared_at", "predicted_at").desc(), F.col("prediction_id").desc()).limit(limit)
    return log_with_names(top, drivers).withColumns(
        {
            "flags_display": F.array_join(_flags(), ", "), "predicted_time_str": format_minutes(F.coalesce("predicted_time", F.lit(0.0))),
            "accepted_label": F.when(F.col("accepted").isNull(), "-").when(F.col("accepted") == 1, "yes").otherwise("no"),
            "used_geometry_label": F.when(F.col("used_geometry") == 1, "yes").otherwise("no"),
        }
    )
