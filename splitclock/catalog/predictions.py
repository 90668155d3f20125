"""Queries over prediction plans, confidence and feature sets. Every result row is a request."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitclock import fixtures as fx
from splitclock.catalog.history import FORM, FORM55_SQL, HR, LAST15, OVERALL_SQL, SHORT_SQL
from splitclock.catalog.registry import query, rounded, with_ctes
from splitclock.catalog.tables import CONTEXT_SQL, DIMENSIONS, PACE, PROFILE, dimensions
from splitclock.functions import scoring
from splitclock.operators import lookups as lk
from splitclock.plans import features, predict
from splitclock.session import removed_after, stored


def classed(spark, d, timed=None):
    """Rated results whose class names are also the normalised ones; ``timed`` holds the timed results if they have been written."""
    return fx.rated_results(spark, d, timed).withColumn("normalized_class", F.col("car_class"))


def inputs(spark, d):
    """(requests, rated results, geometry), all from timed results that are written once."""
    timed = stored(fx.timed_results(spark, d))
    rated = stored(classed(spark, d, timed))
    return rated.select(*REQUEST), rated, stored(fx.stage_geometry(spark, d, timed))


@query(
    "reference_time_live",
    with_ctes(
        fx.GEOMETRY,
        """SELECT stage_id, round(s.stage_length_km / (CASE s.surface WHEN 'asphalt' THEN 105.0 WHEN 'snow' THEN 70.0 ELSE 85.0 END / CASE s.stage_number % 3 WHEN 0 THEN 1.08 WHEN 1 THEN 1.22 ELSE 1.10 END
           / least(1 + coalesce(g.hairpin_density, 0) * 0.02 + coalesce(g.avg_abs_grade, 0) * 0.005, 1.3)) * 3600, 6) AS reference_time FROM stage s LEFT JOIN geometry g USING (stage_id)""",
    ),
)
def reference_time_live(spark, d):
    n = F.col("stage_number")
    name = F.when(n % 3 == 0, "Rally2").when(n % 3 == 1, "K4").otherwise("Other")
    g = fx.stage_geometry(spark, d).select("stage_id", "hairpin_density", "avg_abs_grade")
    s = fx.stages(spark, d).join(g, "stage_id", "left")
    return rounded(s.select("stage_id", scoring.reference_time_live(F.col("stage_length_km"), F.col("surface"), name, F.col("hairpin_density"), F.col("avg_abs_grade")).alias("reference_time")))


@query(
    "reference_time_manual",
    with_ctes(fx.STAGES, "SELECT stage_id, round(stage_length_km / (CASE surface WHEN 'asphalt' THEN 100.0 ELSE 85.0 END / CASE stage_number % 3 WHEN 0 THEN 1.08 WHEN 1 THEN 1.12 ELSE 1.10 END) * 3600, 6) AS reference_time FROM stage"),
)
def reference_time_manual(spark, d):
    n = F.col("stage_number")
    name = F.when(n % 3 == 0, "R4").when(n % 3 == 1, "N4").otherwise("Other")
    return rounded(fx.stages(spark, d).select("stage_id", scoring.reference_time_manual(F.col("stage_length_km"), F.col("surface"), name).alias("reference_time")))


BASE = FORM + f""",
prof_s AS MATERIALIZED (SELECT driver_id, surface, avg(ratio_to_class_best) AS sa, count(*) AS experience FROM rated GROUP BY 1, 2),
prof_o AS MATERIALIZED (SELECT driver_id, avg(ratio_to_class_best) AS oa FROM rated GROUP BY 1),
b AS MATERIALIZED (SELECT *, CASE WHEN rally_avg IS NULL THEN 0.0 ELSE (driver_baseline - rally_avg) / driver_baseline END AS momentum FROM (
   SELECT r.*, br.baseline_ratio AS driver_baseline, br.data_points, br.total_stages, sa / oa AS surface_adjustment, experience, avg(ratio_to_class_best) OVER w AS rally_avg, count(*) OVER w AS stages_analyzed
   FROM rated r JOIN base_ratio br USING (driver_id) JOIN prof_s USING (driver_id, surface) JOIN prof_o USING (driver_id) WINDOW w AS ({HR} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
predicted AS MATERIALIZED (SELECT *, greatest(0.9::DOUBLE, least(1 - momentum, 1.1::DOUBLE)) AS momentum_factor, driver_baseline * greatest(0.9::DOUBLE, least(1 - momentum, 1.1::DOUBLE)) * surface_adjustment AS ratio FROM b)
"""


REQUEST = ["result_id", "driver_id", "rally_id", "stage_id", "stage_number", "surface", "normalized_class"]


def requests(spark, d):
    return classed(spark, d).select(*REQUEST)


@query(
    "predict_baseline",
    with_ctes(
        BASE,
        """SELECT result_id, round(ratio, 6) AS baseline_ratio, round(ratio * class_best_time, 4) AS predicted_time, CASE WHEN data_points >= 15 AND experience >= 10 THEN 'HIGH' WHEN data_points >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM predicted""",
    ),
)
def predict_baseline(spark, d):
    out = predict.predict_baseline(requests(spark, d), classed(spark, d))
    return rounded(out.select("result_id", "baseline_ratio", "predicted_time", "confidence"), predicted_time=4)


@query("predict_baseline_legacy", with_ctes(BASE, "SELECT result_id, round(driver_baseline * (1 + momentum) * surface_adjustment, 6) AS baseline_ratio FROM predicted"))
def predict_baseline_legacy(spark, d):
    return rounded(predict.predict_baseline(requests(spark, d), classed(spark, d), legacy_sign=True).select("result_id", "baseline_ratio"))


NOTIONAL = BASE + """,
geo AS (SELECT stage_id FROM (SELECT DISTINCT stage_id, stage_number FROM timed) WHERE stage_number <> 9),
scored AS (SELECT p.*, CASE WHEN total_stages >= 20 THEN 40 WHEN total_stages >= 15 THEN 36 WHEN total_stages >= 10 THEN 30 WHEN total_stages >= 5 THEN 20 WHEN total_stages >= 2 THEN 10 ELSE 4 END
   + CASE WHEN experience >= 15 THEN 25 WHEN experience >= 10 THEN 21 WHEN experience >= 5 THEN 16 WHEN experience >= 2 THEN 10 ELSE 5 END + 6
   + CASE WHEN stage_number - 1 >= 4 THEN 15 WHEN stage_number - 1 >= 2 THEN 10 WHEN stage_number - 1 = 1 THEN 6 ELSE 3 END - CASE WHEN ratio > 1.2 THEN 10 WHEN ratio < 0.95 THEN 5 ELSE 0 END AS score FROM predicted p)
"""


@query(
    "predict_notional",
    with_ctes(NOTIONAL, "SELECT result_id, round(ratio, 6) AS predicted_ratio, round(ratio * class_best_time, 4) AS predicted_time, score AS confidence_score, CASE WHEN score >= 75 THEN 'HIGH' WHEN score >= 55 THEN 'MEDIUM' WHEN score >= 35 THEN 'LOW' ELSE 'VERY_LOW' END AS confidence_level FROM scored"),
)
def predict_notional(spark, d):
    out = predict.predict_notional(*inputs(spark, d))
    return rounded(out.select("result_id", "predicted_ratio", "predicted_time", "confidence_score", "confidence_level"), predicted_time=4)


@query(
    "predict_notional_corrected",
    with_ctes(
        NOTIONAL,
        """SELECT result_id, CASE WHEN used THEN 'geometric' ELSE 'fallback' END AS geometric_mode, round(ratio * correction, 6) AS predicted_ratio, round(ratio * correction * class_best_time, 4) AS predicted_time
           FROM (SELECT *, CASE WHEN used THEN 0.97::DOUBLE + (driver_id % 7) / 100.0::DOUBLE ELSE 1.0::DOUBLE END AS correction FROM (SELECT *, stage_number % 2 = 0 AND (ev * 7 + stage_number * 13) % 17 > 0 AS used FROM scored))""",
    ),
)
def predict_notional_corrected(spark, d):
    """Corrections are given for the stages with an even number; those without hairpins fall back."""
    asked, rated, geometry = inputs(spark, d)
    given = asked.where(F.col("stage_number") % 2 == 0).select("driver_id", "stage_id", (F.lit(0.97) + F.col("driver_id") % 7 / F.lit(100.0)).alias("geometric_correction"))
    out = predict.predict_notional(asked, rated, geometry, given)
    return rounded(out.select("result_id", "geometric_mode", "predicted_ratio", "predicted_time"), predicted_time=4)


@query("predict_notional_from_model")
def predict_notional_from_model(spark, d):
    """End to end: the trained correction of every request goes into its prediction."""
    from splitclock.catalog.external import MODEL_FEATURES, correction_model
    from splitclock.plans import ml

    model, _, _ = correction_model(spark, d)
    asked, rated, geometry = inputs(spark, d)

    def work():
        rows = features.request_features(rated, geometry).withColumn("elevation_gain", F.lit(0.0))
        rows = stored(ml.model_inputs(rows, MODEL_FEATURES).select("result_id", "driver_id", "stage_id", *MODEL_FEATURES))
        return rows, [rows]

    scored = ml.apply_correction(model, removed_after(spark, work)).where("geometric_mode = 'geometric'")
    out = predict.predict_notional(asked, rated, geometry, scored.select("driver_id", "stage_id", "geometric_correction"))
    return rounded(out.select("result_id", "geometric_mode", "geometric_correction", "predicted_time"), predicted_time=4)


@query("predict_batch", with_ctes(NOTIONAL, "SELECT result_id, round(ratio * class_best_time, 4) AS predicted_time FROM scored"))
def predict_batch(spark, d):
    asked, rated, geometry = inputs(spark, d)
    asked = asked.unionByName(asked.withColumn("normalized_class", F.lit("no such class")))
    return rounded(predict.predict_batch(asked, rated, geometry).select("result_id", "predicted_time"), 4)


@query("batch_summary", with_ctes(NOTIONAL, "SELECT count(*) AS total_predictions, round(avg(ratio), 6) AS avg_ratio, count(*) FILTER (WHERE score >= 75) AS high, count(*) FILTER (WHERE score >= 55 AND score < 75) AS medium, count(*) FILTER (WHERE score < 55) AS low FROM scored"))
def batch_summary(spark, d):
    from splitclock.operators.aggregates import batch_summary as summary

    return rounded(summary(predict.predict_notional(*inputs(spark, d))))


LIVE = DIMENSIONS + f""",
rated AS MATERIALIZED (SELECT *, min(time_seconds) OVER (PARTITION BY stage_id, car_class) AS class_best_time, time_seconds / min(time_seconds) OVER (PARTITION BY stage_id, car_class) AS ratio_to_class_best FROM timed),
per_rally AS {FORM.split('per_rally AS', 1)[1].strip()},
prof_s AS (SELECT driver_id, surface, avg(ratio_to_class_best) AS sa, count(*) AS experience FROM rated GROUP BY 1, 2),
prof_o AS (SELECT driver_id, avg(ratio_to_class_best) AS oa FROM rated GROUP BY 1),
ctx AS MATERIALIZED ({CONTEXT_SQL}),
lv AS (SELECT r.result_id, r.car_class, r.driver_id, br.baseline_ratio, data_points, total_stages, c.*, g.hairpin_density, g.avg_abs_grade, avg(ratio_to_class_best) OVER w AS rally_avg, count(*) OVER w AS n
  FROM rated r JOIN base_ratio br USING (driver_id) JOIN ctx c ON c.stage_id = r.stage_id LEFT JOIN geometry g ON g.stage_id = r.stage_id WINDOW w AS (PARTITION BY r.driver_id, r.rally_id ORDER BY r.stage_number, r.result_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lw AS (SELECT lv.*, CASE WHEN rally_avg IS NULL THEN 0.0::DOUBLE ELSE (baseline_ratio - rally_avg) / baseline_ratio END AS momentum, CASE WHEN experience >= 3 THEN sa / oa ELSE 1.0::DOUBLE END AS surface_adj, coalesce(geometry_status = 'validated' AND elevation_status <> 'missing', false) AS trusted
  FROM lv LEFT JOIN prof_s ps ON ps.driver_id = lv.driver_id AND ps.surface = lower(lv.surface) LEFT JOIN prof_o po ON po.driver_id = lv.driver_id),
lx AS MATERIALIZED (SELECT *, greatest(1.0::DOUBLE, least(baseline_ratio * greatest(0.9::DOUBLE, least(1 - momentum, 1.1::DOUBLE)) * surface_adj, 1.8::DOUBLE)) AS predicted_ratio,
  stage_length_km / (CASE surface WHEN 'asphalt' THEN 105.0 WHEN 'snow' THEN 70.0 ELSE 85.0 END / 1.10 / CASE WHEN trusted THEN least(1 + coalesce(hairpin_density, 0) * 0.02 + coalesce(avg_abs_grade, 0) * 0.005, 1.3) ELSE 1.0 END) * 3600 AS reference_time,
  least(100, 30 + least(data_points * 5, 20) + least(total_stages, 15) + least(n * 3, 15) + CASE WHEN abs(surface_adj - 1) > 1e-6 THEN 5 ELSE 0 END) AS score FROM lw)
"""


def live_requests(spark, d, timed=None, rated=None):
    rallies, stages, geo = dimensions(spark, d, timed)
    asked = (classed(spark, d, timed) if rated is None else rated).select("result_id", "driver_id", "normalized_class", "stage_id", "rally_id", "stage_number")
    return lk.stage_context(asked, stages, rallies, geo)


def live_predictions(spark, d):
    timed = stored(fx.timed_results(spark, d))
    rated = stored(classed(spark, d, timed))
    return predict.predict_live(live_requests(spark, d, timed, rated), rated, rated)


LIVE_SQL = """SELECT result_id, round(predicted_ratio, 6) AS predicted_ratio, round(reference_time * predicted_ratio, 4) AS predicted_time, CAST(score AS DOUBLE) AS confidence_score, CASE WHEN score >= 75 THEN 'HIGH' WHEN score >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level,
  CASE WHEN trusted THEN ['geometry_trusted'] WHEN geometry_status IS NULL THEN ['baseline_only', 'geometry_missing'] ELSE list_sort(['baseline_only', 'elevation_missing', geometry_status]) END AS data_quality_flags FROM lx"""


@query("predict_live", with_ctes(LIVE, LIVE_SQL))
def predict_live(spark, d):
    out = live_predictions(spark, d).select("result_id", "predicted_ratio", "predicted_time", "confidence_score", "confidence_level", "data_quality_flags")
    return rounded(out, predicted_time=4)


@query("confidence_service", with_ctes(LIVE, "SELECT result_id, CAST(score AS DOUBLE) AS confidence_score FROM lx"))
def confidence_service(spark, d):
    return live_predictions(spark, d).select("result_id", "confidence_score")


@query("log_predictions", with_ctes(LIVE, "SELECT driver_id, stage_id, 'run1' AS run_id, round(reference_time * predicted_ratio, 4) AS predicted_time, 'pending' AS comparison_status FROM lx"))
def log_predictions(spark, d):
    return rounded(predict.log_predictions(live_predictions(spark, d), "run1").select("driver_id", "stage_id", "run_id", "predicted_time", "comparison_status"), 4)


@query(
    "factor_waterfall",
    with_ctes(
        LIVE,
        """SELECT result_id, s.step, s.name, round(s.value, 6) AS value, round(s.cumulative, 6) AS cumulative FROM (SELECT result_id, unnest([
           {'step': 1, 'name': 'Baseline', 'value': b, 'cumulative': b}, {'step': 2, 'name': 'Momentum', 'value': m - 1, 'cumulative': b * m}, {'step': 3, 'name': 'Zemin', 'value': surface_adj - 1, 'cumulative': b * m * surface_adj},
           {'step': 4, 'name': 'Geometri', 'value': 0.0::DOUBLE, 'cumulative': b * m * surface_adj}]) AS s FROM (SELECT *, baseline_ratio AS b, greatest(0.9::DOUBLE, least(1 - momentum, 1.1::DOUBLE)) AS m FROM lx))""",
    ),
)
def factor_waterfall(spark, d):
    return rounded(predict.factor_waterfall(live_predictions(spark, d)))


@query("explanation_json", with_ctes(LIVE, f"SELECT result_id, driver_id, predicted_ratio AS ratio, predicted_time AS time_seconds, confidence_level AS confidence FROM ({LIVE_SQL}) JOIN (SELECT result_id, driver_id FROM timed) USING (result_id)"))
def explanation_json(spark, d):
    """The reports, with fields read back from the text."""
    report = F.from_json("report", "driver_id long, prediction struct<ratio: double, time_seconds: double, confidence: string>")
    read = predict.explanation_json(live_predictions(spark, d)).select("result_id", report.alias("r"))
    return rounded(read.select("result_id", "r.driver_id", "r.prediction.ratio", "r.prediction.time_seconds", "r.prediction.confidence"), time_seconds=4)


ROUTE = FORM + """,
prof_s AS (SELECT driver_id, surface, avg(ratio_to_class_best) AS sa, count(*) AS experience FROM rated GROUP BY 1, 2),
prof_o AS (SELECT driver_id, avg(ratio_to_class_best) AS oa FROM rated GROUP BY 1),
rt AS MATERIALIZED (SELECT br.driver_id, baseline_ratio, data_points, total_stages, 5 + br.driver_id % 20 AS km, CASE WHEN br.driver_id % 4 = 0 THEN 0.0::DOUBLE ELSE 250.0::DOUBLE END AS ascent, (br.driver_id % 10) / 5.0::DOUBLE AS density, recent_rally_avg,
  CASE WHEN experience >= 3 THEN sa / oa ELSE 1.0::DOUBLE END AS surface_adj FROM base_ratio br LEFT JOIN (SELECT * FROM prof_s WHERE surface = 'gravel') USING (driver_id) LEFT JOIN prof_o USING (driver_id)),
ru AS (SELECT *, ascent <> 0 AS trusted, km > 3 AND ascent = 0 AS red, greatest(0.9::DOUBLE, least(1 - (baseline_ratio - recent_rally_avg) / baseline_ratio, 1.1::DOUBLE)) AS mf FROM rt)
"""


@query(
    "predict_route",
    with_ctes(
        ROUTE,
        """SELECT driver_id, round(greatest(1.0, least(baseline_ratio * mf * surface_adj, 1.8)), 6) AS predicted_ratio, round(km / (85.0 / 1.10 / CASE WHEN trusted THEN least(1 + density * 0.02, 1.3) ELSE 1.0 END) * 3600 * greatest(1.0, least(baseline_ratio * mf * surface_adj, 1.8)), 4) AS predicted_time,
           CASE WHEN trusted THEN ['geometry_trusted'] ELSE ['baseline_only', 'elevation_missing', 'red_flag_missing_elevation'] END AS data_quality_flags FROM ru""",
    ),
)
def predict_route(spark, d):
    rated = classed(spark, d)
    i = F.col("driver_id")
    flat = i % 4 == 0
    asked = rated.select("driver_id").distinct().select(
        "driver_id", F.lit("Other").alias("normalized_class"), F.lit("Test Etabı").alias("stage_name"), F.lit("gravel").alias("surface"), (5 + i % 20).cast("double").alias("distance_km"),
        F.when(flat, 0.0).otherwise(250.0).alias("total_ascent"), F.lit(0.0).alias("total_descent"), F.lit(0.0).alias("max_grade"), ((i % 10) / F.lit(5.0)).alias("hairpin_density"),
    )
    out = predict.predict_route(asked, rated)
    return rounded(out.select("driver_id", "predicted_ratio", "predicted_time", "data_quality_flags"), predicted_time=4)


MANUAL = LAST15 + f""",
form55 AS ({FORM55_SQL.replace('round(CASE WHEN n >= 10 THEN r5 ELSE ra END, 6)', '(CASE WHEN n >= 10 THEN r5 ELSE ra END)')}),
msurf AS (SELECT driver_id, avg(ratio_to_class_best) AS sa, count(*) AS sn FROM last15 WHERE surface = 'asphalt' GROUP BY 1),
mall AS (SELECT driver_id, avg(ratio_to_class_best) AS oa FROM last15 GROUP BY 1),
mp AS MATERIALIZED (SELECT f.driver_id, n, coalesce(sn, 0) AS sn, greatest(1.0, least(recent_avg_ratio * form_factor * CASE WHEN coalesce(sn, 0) >= 3 THEN sa / oa ELSE 1.0 END, 1.5)) AS ratio FROM form55 f JOIN mall USING (driver_id) LEFT JOIN msurf USING (driver_id))
"""


def manual_predictions(spark, d):
    rated = classed(spark, d)
    asked = rated.select("driver_id").distinct().select("driver_id", F.lit(12.5).alias("stage_length_km"), F.lit("asphalt").alias("surface"))
    return predict.predict_manual(asked, rated)


@query("predict_manual", with_ctes(MANUAL, "SELECT driver_id, round(ratio, 6) AS predicted_ratio, round(ratio * 12.5 / (100.0 / 1.10) * 3600, 4) AS predicted_time, CAST(least(100, 30 + n * 4 + sn * 2) AS BIGINT) AS confidence_score FROM mp"))
def predict_manual(spark, d):
    return rounded(manual_predictions(spark, d).select("driver_id", "predicted_ratio", "predicted_time", "confidence_score"), predicted_time=4)


@query("confidence_manual", with_ctes(MANUAL, "SELECT driver_id, CASE WHEN least(100, 30 + n * 4 + sn * 2) >= 75 THEN 'HIGH' WHEN least(100, 30 + n * 4 + sn * 2) >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level FROM mp"))
def confidence_manual(spark, d):
    return manual_predictions(spark, d).select("driver_id", "confidence_level")


@query(
    "red_flag_predict",
    with_ctes(
        fx.RATED + ", ask AS (SELECT DISTINCT car_class, surface, stage_length_km FROM timed), pace AS MATERIALIZED (" + PACE + """),
done AS (SELECT stage_id, car_class, min(time_seconds) AS best, count(*) AS n FROM timed WHERE driver_id % 3 = 0 GROUP BY 1, 2),
rf AS (SELECT t.driver_id, t.stage_id, t.surface, t.stage_length_km, greatest(1.0, least(0.9 + (t.driver_id % 60) / 100.0, 1.35)) AS ratio, coalesce(best, p.reference_time) AS ref, coalesce(n, 0) AS n FROM timed t LEFT JOIN done d ON d.stage_id = t.stage_id AND d.car_class = t.car_class
  JOIN pace p ON p.car_class = t.car_class AND p.surface = t.surface AND p.stage_length_km = t.stage_length_km WHERE t.driver_id % 3 <> 0)""",
        """SELECT driver_id, stage_id, round(ratio, 6) AS predicted_ratio, round(least(greatest(ratio * ref, ref), ref * 1.35, stage_length_km / CASE surface WHEN 'gravel' THEN 40.0 ELSE 50.0 END * 3600), 4) AS notional_time, CASE WHEN n >= 3 THEN 'high' WHEN n > 0 THEN 'medium' ELSE 'low' END AS confidence FROM rf""",
    ),
)
def red_flag_predict(spark, d):
    t = fx.timed_results(spark, d)
    stopped = t
    i = F.col("driver_id")
    waiting = stopped.where(i % 3 != 0).select("driver_id", "stage_id", "car_class", "stage_length_km", "surface")
    ratios = waiting.select("driver_id", "stage_id", (0.9 + i % 60 / F.lit(100.0)).alias("predicted_ratio"))
    out = predict.red_flag_predict(waiting, stopped.where(i % 3 == 0), t, ratios)
    return rounded(out.select("driver_id", "stage_id", "predicted_ratio", "notional_time", "confidence"), notional_time=4)


@query(
    "confidence_v2",
    with_ctes(
        fx.TIMED,
        """SELECT result_id, greatest(0, least(100, h + s + g + m - p)) AS score FROM (SELECT result_id,
           CASE WHEN a >= 20 THEN 40 WHEN a >= 15 THEN 36 WHEN a >= 10 THEN 30 WHEN a >= 5 THEN 20 WHEN a >= 2 THEN 10 ELSE 4 END AS h, CASE WHEN b >= 15 THEN 25 WHEN b >= 10 THEN 21 WHEN b >= 5 THEN 16 WHEN b >= 2 THEN 10 ELSE 5 END AS s,
           CASE WHEN stage_number % 3 = 0 THEN 6 WHEN pc >= 0.8 THEN 20 WHEN pc >= 0.5 THEN 15 ELSE 10 END AS g, CASE WHEN stage_number - 1 >= 4 THEN 15 WHEN stage_number - 1 >= 2 THEN 10 WHEN stage_number - 1 = 1 THEN 6 ELSE 3 END AS m,
           CASE WHEN br > 1.20 THEN 10 WHEN br < 0.95 THEN 5 ELSE 0 END AS p FROM (SELECT result_id, stage_number, driver_id % 25 AS a, driver_id % 19 AS b, (driver_id % 11) / 10.0::DOUBLE AS pc, 0.9::DOUBLE + (driver_id % 41) / 100.0::DOUBLE AS br FROM timed))""",
    ),
)
def confidence_v2(spark, d):
    i, n = F.col("driver_id"), F.col("stage_number")
    c = scoring.confidence_v2(i % 25, i % 19, F.lit(True), i % 11 / F.lit(10.0), n - 1, F.lit(0.9) + i % 41 / F.lit(100.0), F.when(n % 3 == 0, "fallback").otherwise("geometric"))
    return fx.timed_results(spark, d).select("result_id", c["score"].alias("score"))


@query(
    "confidence_simple",
    with_ctes(
        fx.TIMED,
        """SELECT result_id, round(greatest(0.1, least(1.0, 1.0 - CASE WHEN stage_number % 3 = 0 THEN 0.3 ELSE 0.0 END - CASE WHEN stage_number % 4 = 0 THEN 0.2 WHEN (driver_id % 11) / 10.0 < 0.5 THEN 0.15 ELSE 0.0 END - CASE WHEN driver_id % 5 = 0 THEN 0.1 ELSE 0.0 END)), 6)::DOUBLE AS score FROM timed""",
    ),
)
def confidence_simple(spark, d):
    i, n = F.col("driver_id"), F.col("stage_number")
    c = scoring.confidence_simple(F.when(n % 3 == 0, "fallback").otherwise("geometric"), n % 4 != 0, i % 11 / F.lit(10.0), F.when(i % 5 == 0, 1.3).otherwise(1.05))
    return fx.timed_results(spark, d).select("result_id", c.alias("score"))


# ---- feature sets ----------------------------------------------------------------------------------------------

TRAIN_GEO = fx.GEOMETRY + """,
tg AS MATERIALIZED (SELECT t.*, g.hairpin_density, g.total_ascent, g.p95_curvature, g.max_grade FROM timed t JOIN geometry g USING (stage_id)),
tr AS MATERIALIZED (SELECT *, time_seconds / min(time_seconds) OVER (PARTITION BY stage_id, car_class) AS ratio FROM tg),
tf AS MATERIALIZED (SELECT * FROM tr WHERE ratio > 0.5 AND ratio < 2.0),
tm AS (SELECT *, coalesce(avg(ratio) OVER (w ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), (SELECT avg(ratio) FROM tf)) AS baseline_ratio, row_number() OVER w AS driver_stage_count,
  coalesce(avg(ratio) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / avg(ratio) OVER (w ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING), 1.0) AS momentum_factor, avg(ratio) OVER (PARTITION BY driver_id) AS driver_avg_ratio
  FROM tf WINDOW w AS (PARTITION BY driver_id ORDER BY rally_date, rally_id, stage_number, result_id))
"""


@query(
    "training_set_trainer",
    with_ctes(TRAIN_GEO, "SELECT result_id, round(baseline_ratio, 6) AS baseline_ratio, driver_stage_count, round(momentum_factor, 6) AS momentum_factor, round(driver_avg_ratio, 6) AS driver_avg_ratio, round(ratio / baseline_ratio, 6) AS correction_factor FROM tm WHERE ratio / baseline_ratio > 0.8 AND ratio / baseline_ratio < 1.2"),
)
def training_set_trainer(spark, d):
    timed = stored(fx.timed_results(spark, d))
    out = features.training_set_trainer(classed(spark, d, timed), stored(fx.stage_geometry(spark, d, timed)), leak_free=False)
    return rounded(out.select("result_id", "baseline_ratio", "driver_stage_count", "momentum_factor", "driver_avg_ratio", "correction_factor"))


@query(
    "training_set_profiles",
    with_ctes(
        PROFILE
        + """,
pj AS MATERIALIZED (SELECT r.*, g.hairpin_density, g.total_ascent, g.p95_curvature FROM rated r JOIN (SELECT stage_id, hairpin_density, total_ascent, p95_curvature FROM geometry) g USING (stage_id) QUALIFY count(*) OVER (PARTITION BY driver_id) >= 10),
pb AS (SELECT *, coalesce(avg(ratio_to_class_best) OVER (PARTITION BY driver_id ORDER BY rally_id, stage_number, result_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), avg(ratio_to_class_best) OVER (PARTITION BY driver_id)) AS baseline_ratio FROM pj)""",
        """SELECT result_id, round(baseline_ratio, 6) AS baseline_ratio, round(ratio_to_class_best / baseline_ratio, 6) AS correction_factor, round(hairpin_density * coalesce(nullif(hairpin_performance, 0), 1.0), 6) AS hairpin_x_driver,
           round(total_ascent * coalesce(nullif(climb_performance, 0), 1.0), 4) AS climb_x_driver FROM pb LEFT JOIN (SELECT driver_id, hairpin_performance, climb_performance FROM prof) USING (driver_id) WHERE ratio_to_class_best / baseline_ratio > 0.8 AND ratio_to_class_best / baseline_ratio < 1.2""",
    ),
)
def training_set_profiles(spark, d):
    _, rated, geometry = inputs(spark, d)
    out = features.training_set_profiles(rated, geometry)
    return rounded(out.select("result_id", "baseline_ratio", "correction_factor", "hairpin_x_driver", "climb_x_driver"), climb_x_driver=4)


@query(
    "prediction_features",
    with_ctes(
        PROFILE,
        """SELECT result_id, coalesce(g.distance_km, 0.0) AS distance_km, coalesce(g.avg_curvature, 0.0) AS avg_curvature, 0.0::DOUBLE AS elevation_gain, round(coalesce(nullif(p.hairpin_performance, 0), 1.0), 6) AS driver_hairpin_perf,
           round(coalesce(g.hairpin_density, 0.0) * coalesce(nullif(p.hairpin_performance, 0), 1.0), 6) AS hairpin_x_driver FROM rated r LEFT JOIN geometry g ON g.stage_id = r.stage_id LEFT JOIN prof p ON p.driver_id = r.driver_id""",
    ),
)
def prediction_features(spark, d):
    from splitclock.operators.aggregates import geometry_profile

    rated, geo = classed(spark, d), fx.stage_geometry(spark, d)
    asked = lk.results_left_geometry(rated.drop("ratio_to_class_best"), geo).withColumns({"baseline_ratio": F.lit(1.05), "momentum_factor": F.lit(1.0), "surface_adjustment": F.lit(1.0)})
    out = features.prediction_features(asked, geometry_profile(lk.results_left_geometry(rated, geo)))
    return rounded(out.select("result_id", "distance_km", "avg_curvature", "elevation_gain", "driver_hairpin_perf", "hairpin_x_driver"))


EXACT_SQL = OVERALL_SQL.replace("round(", "(").replace(", 6) AS", ") AS")
V1 = fx.RATED + f""",
v_o AS MATERIALIZED (SELECT result_id, surface, car_class, stage_length_km, {EXACT_SQL} FROM rated),
v_s AS MATERIALIZED (SELECT result_id, {SHORT_SQL.split("SELECT result_id, ", 1)[1].replace("round(list_avg(prev[-10:]), 6)", "list_avg(prev[-10:])")})
"""


@query(
    "v1_feature_matrix",
    with_ctes(
        V1,
        """SELECT result_id, round(mean_overall, 6) AS driver_mean_ratio_overall, driver_stages_completed, is_rookie, round(coalesce(driver_momentum, median(driver_momentum) OVER ()), 6) AS driver_momentum,
           round(coalesce(short, median(short) OVER ()), 6) AS driver_short_stage_ratio, round(pow(stage_length_km, 0.85), 6) AS stage_length_corrected, CAST(car_class = 'BUILDING' AS INTEGER) AS class_BUILDING
           FROM (SELECT *, CASE WHEN is_rookie THEN coalesce(driver_mean_ratio_overall, median(driver_mean_ratio_overall) OVER (PARTITION BY surface)) ELSE driver_mean_ratio_overall END AS mean_overall,
                 coalesce(driver_short_stage_ratio, driver_mean_ratio_overall) AS short FROM v_o JOIN v_s USING (result_id))""",
    ),
)
def v1_feature_matrix(spark, d):
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    out = features.v1_feature_matrix(fx.timed_results(spark, d), names)
    return rounded(out.select("result_id", "driver_mean_ratio_overall", "driver_stages_completed", "is_rookie", "driver_momentum", "driver_short_stage_ratio", "stage_length_corrected", "class_BUILDING"))


@query("training_readiness", with_ctes(fx.GEOMETRY, "SELECT count(*) AS training_data_count, count(*) > 100 AS can_train FROM timed WHERE stage_id IN (SELECT stage_id FROM geometry)"))
def training_readiness(spark, d):
    return features.training_readiness(fx.timed_results(spark, d), fx.stage_geometry(spark, d))
