"""Queries over merges and master data."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitclock import fixtures as fx
from splitclock.catalog.registry import query, rounded, with_ctes
from splitclock.catalog.scalars import NAME_KEY_SQL
from splitclock.catalog.tables import LOG, closed_log
from splitclock.operators import geometry as gm
from splitclock.operators import master as ms
from splitclock.operators import merge as mg
from splitclock.session import scratch_path, stored

CLASS_SQL = """CASE trim(car_class) WHEN 'R4' THEN 'Rally2' WHEN 'rally 2' THEN 'Rally2' WHEN 'R2' THEN 'Rally4' WHEN 'S2000' THEN 'Rally2' WHEN 'Kategori 1' THEN 'K1' WHEN 'RALLY5' THEN 'Rally5' WHEN '' THEN 'Unknown' ELSE trim(car_class) END"""
DRIVER_SQL = f"concat('drv_', regexp_replace(replace({NAME_KEY_SQL.format('driver_name')}, ' ', '-'), '[^a-z0-9-]+', '', 'g'))"
CANON = fx.RAW + f""",
canon AS MATERIALIZED (SELECT person, result_id, rally_id, rally_name, stage_number, stage_name, stage_length_km, concat(rally_id, '_ss', stage_number) AS stage_id, car_number, trim(driver_name) AS driver_name,
  {DRIVER_SQL} AS driver_id, nullif(trim(car_class), '') AS car_class, {CLASS_SQL} AS normalized_class, vehicle, time_str, time_seconds, lower(nullif(trim(surface), '')) AS surface,
  coalesce(status, CASE WHEN time_seconds <> 0 THEN 'FINISHED' ELSE 'UNKNOWN' END) AS status FROM raw)
"""
SHOWN = ["result_id", "rally_id", "stage_number", "stage_name", "stage_id", "car_number", "driver_name", "driver_id", "car_class", "normalized_class", "vehicle", "time_str", "time_seconds", "surface", "status"]


@query("canonicalize_results", with_ctes(CANON, f"SELECT {', '.join(SHOWN)} FROM canon"))
def canonicalize_results(spark, d):
    return mg.canonicalize_results(fx.raw_results(spark, d), "run1").select(*SHOWN)


def merge_pair(spark, d):
    """A master without every fifth driver; a batch of those drivers and of the next ones, some with another time,
    and some rows sent twice."""
    raw = fx.raw_results(spark, d, stored(fx.timed_results(spark, d))).withColumn("person", F.element_at(F.split("result_id", "_"), -1).cast("bigint"))
    k = F.col("person") % 5
    master = mg.canonicalize_results(raw.where(k != 0), "seed")
    later = F.when((k == 1) & (F.col("stage_number") == 3), F.col("time_seconds") + 1).otherwise(F.col("time_seconds"))
    batch = raw.where(k.isin(0, 1)).withColumn("time_seconds", later)
    once = batch.withColumn("seq", F.lit(1))
    again = batch.where("stage_number IN (2, 4)").withColumn("seq", F.lit(2))
    again = again.withColumn("time_seconds", F.when(F.col("stage_number") == 4, F.col("time_seconds") + 7).otherwise(F.col("time_seconds")))
    return master, once.unionByName(again).drop("person")


OUTCOMES = CANON + """,
batch AS (SELECT result_id, person % 5 AS k, stage_number, time_seconds, 1 AS seq FROM canon WHERE person % 5 IN (0, 1) UNION ALL SELECT result_id, person % 5, stage_number, time_seconds, 2 FROM canon WHERE person % 5 IN (0, 1) AND stage_number IN (2, 4)),
outcome AS MATERIALIZED (SELECT result_id, seq, CASE WHEN seq = 2 AND stage_number = 2 THEN 'duplicate' WHEN seq = 2 AND time_seconds IS NULL THEN 'duplicate' WHEN seq = 2 THEN 'conflict' WHEN k = 0 THEN 'insert' WHEN stage_number = 3 AND time_seconds IS NOT NULL THEN 'conflict' ELSE 'skipped' END AS outcome FROM batch)
"""


@query("merge_results", with_ctes(OUTCOMES, "SELECT * FROM outcome"))
def merge_results(spark, d):
    master, batch = merge_pair(spark, d)
    m = mg.merge_results(master, batch, "run1", recompute=False)
    return m.outcomes.select("result_id", F.col("_seq").alias("seq"), "outcome")


@query(
    "merge_results_counts",
    with_ctes(
        OUTCOMES,
        """SELECT 'run1' AS merge_run_id, 'results_merge' AS merge_scope, count(*) AS incoming_rows, count(*) FILTER (WHERE outcome = 'insert') AS inserted_rows, count(*) FILTER (WHERE outcome = 'skipped') AS skipped_rows,
           count(*) FILTER (WHERE outcome = 'conflict') AS conflict_rows, count(*) FILTER (WHERE seq = 2) AS incoming_duplicate_rows FROM outcome""",
    ),
)
def merge_results_counts(spark, d):
    master, batch = merge_pair(spark, d)
    return mg.merge_results(master, batch, "run1", recompute=False).log


@query("append_audit", with_ctes(OUTCOMES, "SELECT result_id AS entity_key, 'time_seconds' AS field FROM outcome WHERE outcome = 'conflict'"))
def append_audit(spark, d):
    master, batch = merge_pair(spark, d)
    conflicts = mg.merge_results(master, batch, "run1", recompute=False).conflicts
    return conflicts.select("entity_key", F.explode("diff").alias("x")).select("entity_key", "x.field")


@query("merge_stored", with_ctes(OUTCOMES, """SELECT outcome, count(*) AS rows, count(DISTINCT result_id) AS ids FROM outcome GROUP BY 1"""))
def merge_stored(spark, d):
    # Both parts of the batch are merged into a stored table one after the other, and the first once more.
    master, batch = merge_pair(spark, d)
    root = scratch_path(spark, "results")
    mg.store_results(master, root, 32)
    early = F.col("stage_number") <= 5
    parts = [mg.merge_stored(spark, root, batch.where(w), f"run{k}", parts=32).outcomes for k, w in enumerate((early, ~early))]
    mg.merge_stored(spark, root, batch.where(early), "run2", parts=32)
    return parts[0].unionByName(parts[1]).groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("result_id").alias("ids"))


RECOMPUTE_SQL = """SELECT result_id, normalized_class, driver_id, round(CASE WHEN time_seconds > 0 THEN time_seconds / min(time_seconds) OVER (PARTITION BY stage_id, normalized_class) END, 6) AS ratio_to_class_best,
  CASE WHEN time_seconds > 0 THEN CAST(row_number() OVER (PARTITION BY stage_id, normalized_class, time_seconds > 0 ORDER BY time_seconds, result_id) AS INTEGER) END AS class_position FROM canon"""


@query("recompute_derived", with_ctes(CANON, RECOMPUTE_SQL))
def recompute_derived(spark, d):
    out = mg.recompute_derived(mg.canonicalize_results(fx.raw_results(spark, d), "run1"))
    return rounded(out.select("result_id", "normalized_class", "driver_id", "ratio_to_class_best", "class_position"))


@query("merge_stored_table", with_ctes(CANON, RECOMPUTE_SQL))
def merge_stored_table(spark, d):
    # Four fifths of the results are stored, the others come in two batches; the table is as if all had been derived at once.
    raw = fx.raw_results(spark, d, stored(fx.timed_results(spark, d))).withColumn("seq", F.lit(1))
    root, k = scratch_path(spark, "results"), F.pmod(F.xxhash64("result_id"), F.lit(10))
    mg.store_results(mg.canonicalize_results(raw.where(k > 1), "seed"), root, 32)
    for n in (0, 1):
        mg.merge_stored(spark, root, raw.where(k == n), f"run{n}", parts=32)
    return rounded(mg.stored_results(spark, root).select("result_id", "normalized_class", "driver_id", "ratio_to_class_best", "class_position"))


@query("append_new", with_ctes(fx.TIMED, "SELECT result_id FROM timed WHERE stage_number > 5"))
def append_new(spark, d):
    t = fx.timed_results(spark, d).select("result_id", "stage_number", "time_seconds")
    fresh, _ = mg.append_new(t.where("stage_number <= 5"), t.unionByName(t), "result_id", ["time_seconds"])
    return fresh.select("result_id")


@query("append_new_counts", with_ctes(fx.TIMED, "SELECT count(*) FILTER (WHERE stage_number > 5) AS saved, 2 * count(*) - count(*) FILTER (WHERE stage_number > 5) AS skipped FROM timed"))
def append_new_counts(spark, d):
    t = fx.timed_results(spark, d).select("result_id", "stage_number", "time_seconds")
    return mg.append_new(t.where("stage_number <= 5"), t.unionByName(t), "result_id", ["time_seconds"])[1]


DRIVERS = CANON + f""",
spelling AS (SELECT driver_name AS alias_name, count(*) AS n, {NAME_KEY_SQL.format('driver_name')} AS name_key FROM canon GROUP BY 1),
driver AS MATERIALIZED (SELECT name_key, arg_min(alias_name, (-n, len(regexp_replace(alias_name, '[^\\p{{Lu}}]', '', 'g')), length(alias_name), alias_name)) AS display_name,
  count(*) > 1 AND (max(length(alias_name)) >= greatest(12, min(length(alias_name)) * 1.7) OR count(DISTINCT len(string_split(name_key, ' '))) > 1) AS review, count(*) AS variants FROM spelling GROUP BY 1)
"""


@query("build_drivers", with_ctes(DRIVERS, "SELECT concat('drv_', replace(name_key, ' ', '-')) AS driver_id, display_name, name_key AS normalized_name_key, CASE WHEN review THEN 'review' ELSE 'auto' END AS merge_review_status FROM driver"))
def build_drivers(spark, d):
    return ms.build_drivers(fx.raw_results(spark, d))


@query("build_aliases", with_ctes(DRIVERS, "SELECT concat('drv_', replace(name_key, ' ', '-')) AS driver_id, alias_name, CAST(alias_name = display_name AS INTEGER) AS is_primary, n AS count FROM spelling JOIN driver USING (name_key)"))
def build_aliases(spark, d):
    raw = fx.raw_results(spark, d)
    return ms.build_aliases(raw, ms.build_drivers(raw)).select("driver_id", "alias_name", "is_primary", "count")


@query("alias_report", with_ctes(DRIVERS, "SELECT name_key AS normalized_name_key, variants, review AS requires_manual_review, names FROM driver JOIN (SELECT name_key, string_agg(alias_name, '|' ORDER BY alias_name) AS names FROM spelling GROUP BY 1) USING (name_key) WHERE variants > 1"))
def alias_report(spark, d):
    raw = fx.raw_results(spark, d)
    out = ms.alias_report(ms.build_aliases(raw, ms.build_drivers(raw)))
    return out.select("normalized_name_key", "variants", "requires_manual_review", F.array_join(F.col("aliases.alias_name"), "|").alias("names"))


def _majority(key: str, value: str) -> str:
    return f"SELECT {key}, {value} FROM (SELECT {key}, {value}, count(*) AS n, min(result_id) AS f FROM low WHERE {value} IS NOT NULL AND CAST({value} AS VARCHAR) NOT IN ('', 'unknown') GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, f) = 1"


CATALOG = fx.RAW + f""",
low AS (SELECT result_id, rally_id, rally_name, concat(rally_id, '_ss', stage_number) AS stage_id, stage_number, stage_name, stage_length_km, CASE WHEN stage_number = 2 THEN 'mixed' ELSE lower(surface) END AS surface FROM raw),
rally AS (SELECT r.rally_id, rally_name, surface FROM (SELECT DISTINCT rally_id FROM low) r LEFT JOIN ({_majority('rally_id', 'rally_name')}) USING (rally_id) LEFT JOIN ({_majority('rally_id', 'surface')}) USING (rally_id)),
stg AS (SELECT s.*, stage_name, stage_length_km, surface FROM (SELECT DISTINCT stage_id, rally_id, stage_number FROM low) s LEFT JOIN ({_majority('stage_id', 'stage_name')}) USING (stage_id)
  LEFT JOIN ({_majority('stage_id', 'stage_length_km')}) USING (stage_id) LEFT JOIN ({_majority('stage_id', 'surface')}) USING (stage_id))
"""


def _mixed(spark, d):
    return fx.raw_results(spark, d).withColumn("surface", F.when(F.col("stage_number") == 2, "mixed").otherwise(F.col("surface")))


@query("build_rallies", with_ctes(CATALOG, "SELECT * FROM rally"))
def build_rallies(spark, d):
    return ms.build_rallies(_mixed(spark, d))


@query(
    "build_stages",
    with_ctes(
        CATALOG,
        """SELECT s.stage_id, s.rally_id, s.stage_number, s.stage_name, CASE WHEN s.surface <> r.surface THEN s.surface END AS surface, CASE WHEN s.surface <> r.surface THEN 1 ELSE 0 END AS surface_override, s.stage_length_km AS length_km,
           CASE WHEN s.stage_number <> 9 THEN 'matched' ELSE 'results_only' END AS match_status FROM stg s JOIN rally r USING (rally_id)""",
    ),
)
def build_stages(spark, d):
    raw = _mixed(spark, d)
    return ms.build_stages(raw, ms.build_rallies(raw), fx.stage_geometry(spark, d))


@query("backfill_result_keys", with_ctes(CANON, f"SELECT result_id, concat(rally_id, '_ss', stage_number) AS stage_id, {DRIVER_SQL} AS driver_id, coalesce(status, 'FINISHED') AS status, 'run1' AS source_run_id FROM raw"))
def backfill_result_keys(spark, d):
    none = F.lit(None).cast("string")
    raw = fx.raw_results(spark, d).withColumns({"stage_id": none, "raw_driver_name": none, "source_run_id": none})
    return ms.backfill_result_keys(raw, "run1").select("result_id", "stage_id", "driver_id", "status", "source_run_id")


NOW = "2024-01-01T00:00:00"


def _analysed(spark, d):
    """Geometry rows as an analyser hands them over: numbers as text, ids left out where they can be derived."""
    g = fx.stage_geometry(spark, d)
    n = F.col("stage_number")
    return g.select(
        F.when(n % 2 == 0, F.col("stage_id")).alias("stage_id"), F.when(n != 7, F.col("rally_id")).alias("rally_id"), "stage_number", F.lit(" ").alias("stage_name"), "surface",
        F.concat(F.lit(" "), F.col("distance_km").cast("string")).alias("distance_km"), "hairpin_count", "hairpin_density", "total_ascent", "total_descent", "max_grade", "p95_curvature",
        (F.col("straight_percentage") / 100).alias("straight_ratio"), F.when(n % 3 == 0, "unknown").otherwise("850.5").alias("max_altitude"), F.lit(120.0).alias("min_altitude"), "source_kml",
    )


@query(
    "canonicalize_geometry",
    with_ctes(
        fx.GEOMETRY,
        f"""SELECT CASE WHEN stage_number = 7 THEN NULL ELSE stage_id END AS stage_id, CASE WHEN stage_number <> 7 THEN stage_id END AS stage_name, lower(surface) AS surface, distance_km, round(CAST(round(straight_percentage) AS DOUBLE), 6) AS straight_percentage,
           round(100 - straight_percentage, 6) AS curvy_percentage, CASE WHEN stage_number % 3 <> 0 THEN 730.5::DOUBLE END AS elevation_gain, 'available' AS elevation_known, CASE WHEN distance_km > 3 AND total_ascent = 0 AND total_descent = 0 AND max_grade = 0 THEN 'red_flag_missing_elevation' ELSE 'validated' END AS geometry_status,
           'scan' AS analysis_version, source_kml AS kml_file FROM geometry""",
    ),
)
def canonicalize_geometry(spark, d):
    c = gm.canonicalize_geometry(_analysed(spark, d), "scan", now=NOW)
    return rounded(
        c.select("stage_id", "stage_name", "surface", "distance_km", "straight_percentage", "curvy_percentage", "elevation_gain", F.lit("available").alias("elevation_known"), "geometry_status", "analysis_version", "kml_file")
    )


def geometry_pair(spark, d):
    """Stored geometry of the stages up to number 6, and a batch: the same routes measured slightly or quite
    differently, sparse rows, and stages not seen before."""
    g = fx.stage_geometry(spark, d).select("stage_id", "rally_id", "stage_number", "stage_name", "surface", "distance_km", "hairpin_count", "hairpin_density", "total_ascent", "total_descent", "max_grade", "p95_curvature", "source_kml")
    master = gm.canonicalize_geometry(g.where("stage_number <= 6"), "seed", now=NOW)
    n = F.col("stage_number")
    other = g.withColumns(
        {
            "distance_km": F.when(n == 2, F.col("distance_km") + 0.04).when(n == 3, F.col("distance_km") + 5).when(n == 4, None).otherwise(F.col("distance_km")),
            "source_kml": F.when(n == 4, None).when(n.isin(2, 3), F.concat(F.lit("new_"), "source_kml")).otherwise(F.col("source_kml")),
        }
    )
    blank = {c: F.when(n == 4, None).otherwise(F.col(c)) for c in ("hairpin_count", "hairpin_density", "total_ascent", "total_descent", "max_grade", "p95_curvature")}
    return master, other.withColumns(blank).where("stage_number <> 1")


MERGED_SQL = """SELECT stage_id, CASE WHEN stage_number > 6 THEN 'inserted' WHEN stage_number = 2 THEN 'near_duplicate' WHEN stage_number = 3 THEN 'conflict' ELSE 'metadata_updated' END AS outcome FROM geometry WHERE stage_number <> 1"""


@query("merge_geometry", with_ctes(fx.GEOMETRY, MERGED_SQL))
def merge_geometry(spark, d):
    master, batch = geometry_pair(spark, d)
    return gm.merge_geometry(master, batch, "scan", now=NOW).outcomes


@query(
    "merge_geometry_ordered",
    with_ctes(fx.GEOMETRY, f"{MERGED_SQL} UNION ALL SELECT stage_id, CASE WHEN stage_number = 3 THEN 'conflict' ELSE 'metadata_updated' END FROM geometry WHERE stage_number <> 1"),
)
def merge_geometry_ordered(spark, d):
    master, batch = geometry_pair(spark, d)
    twice = batch.withColumn("seq", F.lit(1)).unionByName(batch.withColumn("seq", F.lit(2)).withColumn("analysis_version", F.lit("second")), allowMissingColumns=True)
    return gm.merge_geometry(master, twice, "scan", order="seq", now=NOW).outcomes


@query(
    "near_duplicate",
    with_ctes(
        fx.GEOMETRY,
        """SELECT a.stage_id, abs(a.distance_km - b.distance_km) <= greatest(0.05, 0.01 * greatest(a.distance_km, b.distance_km, 1)) AND abs(a.total_ascent - b.total_ascent) <= greatest(20, 0.05 * greatest(a.total_ascent, b.total_ascent, 1))
           AND abs(a.total_descent - b.total_descent) <= greatest(20, 0.05 * greatest(a.total_descent, b.total_descent, 1)) AND abs(a.max_grade - b.max_grade) <= greatest(1, 0.15 * greatest(a.max_grade, b.max_grade, 1))
           AND abs(a.p95_curvature - b.p95_curvature) <= greatest(0.0005, 0.2 * greatest(a.p95_curvature, b.p95_curvature, 1)) AND abs(a.hairpin_count - b.hairpin_count) <= 1 AS near
           FROM geometry a JOIN (SELECT stage_id, distance_km + 0.03 AS distance_km, total_ascent + stage_number * 4 AS total_ascent, total_descent, max_grade + (stage_number % 3) AS max_grade, p95_curvature, hairpin_count + stage_number % 2 AS hairpin_count FROM geometry) b USING (stage_id)""",
    ),
)
def near_duplicate(spark, d):
    g = fx.stage_geometry(spark, d)
    n = F.col("stage_number")
    names = list(gm.TOLERANCES) + ["hairpin_count"]
    other = g.withColumns({"distance_km": F.col("distance_km") + 0.03, "total_ascent": F.col("total_ascent") + n * 4, "max_grade": F.col("max_grade") + n % 3, "hairpin_count": F.col("hairpin_count") + n % 2})
    j = g.select("stage_id", F.struct(*names).alias("a")).join(other.select("stage_id", F.struct(*names).alias("b")), "stage_id")
    return j.select("stage_id", gm.near_duplicate().alias("near"))


@query(
    "overlay_geometry",
    with_ctes(
        fx.GEOMETRY,
        """SELECT stage_id, CASE stage_number WHEN 2 THEN distance_km + 0.04 ELSE distance_km END AS distance_km, CASE WHEN stage_number = 2 THEN concat('new_', source_kml) ELSE source_kml END AS source_kml, hairpin_count FROM geometry""",
    ),
)
def overlay_geometry(spark, d):
    master, batch = geometry_pair(spark, d)
    out = gm.merge_geometry(master, batch, "scan", now=NOW).merged
    return rounded(out.select("stage_id", "distance_km", "source_kml", "hairpin_count"))


@query(
    "enrich_geometry",
    with_ctes(
        CATALOG + ", geo AS (SELECT DISTINCT stage_id, rally_id, stage_number FROM low WHERE stage_number <> 9)",
        """SELECT g.stage_id, CASE WHEN s.surface <> r.surface THEN s.surface END AS stage_surface, 'legacy_geometry_import_v1' AS analysis_version, 0.0::DOUBLE AS elevation_gain FROM geo g JOIN stg s USING (stage_id) JOIN rally r ON r.rally_id = s.rally_id""",
    ),
)
def enrich_geometry(spark, d):
    raw = _mixed(spark, d)
    stages = ms.build_stages(raw, ms.build_rallies(raw))
    g = fx.stage_geometry(spark, d).withColumns({"surface": F.lit(None).cast("string"), "stage_number": F.lit(None).cast("int")})
    out = gm.enrich_geometry(g, stages)
    return out.select("stage_id", F.col("surface").alias("stage_surface"), "analysis_version", "elevation_gain")


@query(
    "sync_stage_catalog",
    with_ctes(
        fx.GEOMETRY,
        """SELECT s.stage_id, CASE WHEN g.stage_id IS NOT NULL THEN 'matched' ELSE 'results_only' END AS match_status, coalesce(g.distance_km, s.stage_length_km + 1) AS length_km FROM stage s LEFT JOIN geometry g USING (stage_id)""",
    ),
)
def sync_stage_catalog(spark, d):
    s = fx.stages(spark, d)
    none = F.lit(None).cast("string")
    stages = s.select("stage_id", "rally_id", "stage_number", F.col("stage_id").alias("stage_name"), none.alias("surface"), F.lit(0).alias("surface_override"), (F.col("stage_length_km") + 1).alias("length_km"), F.lit("results_only").alias("match_status"))
    rallies = s.select("rally_id", F.col("rally_id").alias("rally_name"), none.alias("surface")).distinct()
    return gm.sync_stage_catalog(fx.stage_geometry(spark, d), rallies, stages)[1].select("stage_id", "match_status", "length_km")


@query("sheet_overlay", with_ctes(fx.GEOMETRY, "SELECT stage_id, CASE WHEN stage_number = 2 THEN 'reviewed' ELSE 'seed' END AS analysis_version, distance_km FROM geometry WHERE stage_number <= 6"))
def sheet_overlay(spark, d):
    master, _ = geometry_pair(spark, d)
    sheet = master.select("stage_id", F.when(F.col("stage_number") == 2, "reviewed").alias("analysis_version"), F.lit(None).cast("double").alias("distance_km")).where("analysis_version IS NOT NULL")
    return gm.sheet_overlay(master, sheet, NOW).merged.select("stage_id", "analysis_version", "distance_km")


@query("geometry_payload", with_ctes(fx.GEOMETRY, "SELECT stage_id, distance_km, 0.0::DOUBLE AS sign_changes_per_km, straight_percentage, 100 - straight_percentage AS curvy_percentage, 'ml_optimized_v1' AS analysis_version FROM geometry"))
def geometry_payload(spark, d):
    g = fx.stage_geometry(spark, d).drop("curvy_percentage")
    return gm.geometry_payload(g, "ml_optimized_v1", NOW).select("stage_id", "distance_km", "sign_changes_per_km", "straight_percentage", "curvy_percentage", "analysis_version")


@query("resolve_issues", with_ctes(LOG, "SELECT prediction_id, ['actual_missing', 'high_error'] AS resolved_issue_types, 'checked' AS resolution_note FROM closed WHERE comparison_status = 'actual_missing'"))
def resolve_issues(spark, d):
    from splitclock.plans.quality import resolve_issues as resolve

    log = closed_log(spark, d).withColumn("resolved_issue_types", F.array(F.lit("high_error")))
    fix = log.where("comparison_status = 'actual_missing'").select(
        "prediction_id", F.array(F.lit("actual_missing")).alias("issue_types"), F.lit(" checked ").alias("note"), F.lit("merge").alias("source"), F.lit(None).cast("timestamp").alias("at")
    )
    return resolve(log, fix).where("resolution_source = 'merge'").select("prediction_id", "resolved_issue_types", "resolution_note")


ISSUES = LOG + """,
issue AS (
  SELECT prediction_id, unnest(list_filter([CASE WHEN f3 THEN 'red_flag_missing_elevation' END, CASE WHEN f5 THEN 'elevation_missing' END, CASE WHEN f7 THEN 'geometry_missing' END, CASE WHEN comparison_status = 'actual_missing' THEN 'actual_missing' END,
    CASE WHEN comparison_status = 'pending' THEN 'pending_compare' END, CASE WHEN comparison_status = 'matched' AND error_pct > 15 THEN 'high_error' END, CASE WHEN fb THEN 'baseline_only' END], lambda x: x IS NOT NULL)) AS issue_type
  FROM (SELECT *, stage_number = 3 AS f3, stage_number = 5 AS f5, stage_number = 7 AS f7, stage_number = 1 AS fb FROM closed JOIN (SELECT stage_id, any_value(stage_number) AS stage_number FROM rated GROUP BY 1) USING (stage_id))),
rank AS (SELECT *, CASE WHEN issue_type IN ('red_flag_missing_elevation', 'actual_missing', 'high_error') THEN 'P1' WHEN issue_type = 'pending_compare' THEN 'P3' ELSE 'P2' END AS priority FROM issue)
"""


@query("issue_worklist", with_ctes(ISSUES, "SELECT prediction_id, issue_type, priority FROM rank"))
def issue_worklist(spark, d):
    from splitclock.plans.quality import issue_worklist as worklist

    return worklist(closed_log(spark, d)).select("prediction_id", "issue_type", "priority")


@query("worklist_top", with_ctes(ISSUES, "SELECT prediction_id, issue_type, priority FROM rank ORDER BY priority, prediction_id DESC, issue_type LIMIT 200"))
def worklist_top(spark, d):
    from splitclock.plans.quality import issue_worklist as worklist
    from splitclock.plans.quality import worklist_top as top

    return top(worklist(closed_log(spark, d)), 200).select("prediction_id", "issue_type", "priority")


@query("issue_breakdown", with_ctes(ISSUES, "SELECT issue_type, priority, count(*) AS count FROM rank GROUP BY 1, 2"))
def issue_breakdown(spark, d):
    from splitclock.plans.quality import issue_breakdown as breakdown
    from splitclock.plans.quality import issue_worklist as worklist

    return breakdown(worklist(closed_log(spark, d))).select("issue_type", "priority", "count")


@query("newest_log_rows", with_ctes(LOG, "SELECT prediction_id, driver_name, flags_display FROM (SELECT prediction_id, coalesce(c_name, CAST(driver_id AS VARCHAR)) AS driver_name, array_to_string(data_quality_flags, ', ') AS flags_display FROM closed LEFT JOIN customer ON c_custkey = driver_id ORDER BY prediction_id DESC LIMIT 200)"))
def newest_log_rows(spark, d):
    from splitclock.plans.quality import newest_log_rows as newest

    names = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("driver_id"), F.col("c_name").alias("display_name"))
    log = closed_log(spark, d).withColumns({"compared_at": F.lit(None).cast("timestamp"), "predicted_at": F.lit(None).cast("timestamp")})
    return newest(log, names, 200).select("prediction_id", "driver_name", "flags_display")
