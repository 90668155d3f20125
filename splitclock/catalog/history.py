"""Queries over class leaders, anomalies and driver history."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitclock import fixtures as fx
from splitclock.catalog.registry import query, rounded, with_ctes
from splitclock.operators import facts, history
from splitclock.session import stored

KEYS = ("stage_id", "car_class")
H = "PARTITION BY driver_id ORDER BY rally_date, rally_id, stage_number, result_id"
HR = "PARTITION BY driver_id, rally_id ORDER BY stage_number, result_id"


@query(
    "class_best",
    with_ctes(
        fx.TIMED,
        """SELECT stage_id, car_class, min(time_seconds) AS class_best_time, arg_min(driver_id, (time_seconds, driver_id)) AS class_best_driver,
           count(*) AS finisher_count FROM timed GROUP BY 1, 2""",
    ),
)
def class_best(spark, d):
    return facts.class_best(fx.timed_results(spark, d), KEYS, driver="driver_id")


@query(
    "class_reference_times",
    with_ctes(
        fx.TIMED,
        "SELECT stage_id, car_class, round(min(time_seconds), 6) AS best_time, count(*) AS n_finishers, round(median(time_seconds), 6) AS median_time FROM timed GROUP BY 1, 2",
    ),
)
def class_reference_times(spark, d):
    return rounded(facts.class_reference_times(fx.timed_results(spark, d)))


@query("results_with_class_best", with_ctes(fx.RATED, "SELECT result_id, stage_id, car_class, time_seconds, class_best_time FROM rated"))
def results_with_class_best(spark, d):
    return facts.results_with_class_best(fx.timed_results(spark, d), KEYS).select("result_id", *KEYS, "time_seconds", "class_best_time")


@query("ratio_to_class_best", with_ctes(fx.RATED, "SELECT result_id, round(ratio_to_class_best, 9) AS ratio_to_class_best FROM rated"))
def ratio_to_class_best(spark, d):
    return rounded(fx.rated_results(spark, d).select("result_id", "ratio_to_class_best"), 9)


@query(
    "class_position",
    with_ctes(fx.TIMED, "SELECT result_id, row_number() OVER (PARTITION BY stage_id, car_class ORDER BY time_seconds, result_id) AS class_position FROM timed"),
)
def class_position(spark, d):
    return facts.class_position(fx.timed_results(spark, d), KEYS).select("result_id", "class_position")


def _anomaly_sql(limit: str) -> str:
    return f"""SELECT result_id, reason AS anomaly_reason, reason IS NOT NULL AS is_anomaly FROM (
      SELECT result_id, CASE
        WHEN speed < CASE surface WHEN 'asphalt' THEN 40 ELSE 30 END THEN 'speed_too_low'
        WHEN speed > 250 THEN 'speed_too_high'
        WHEN n >= 3 AND time_seconds / best > 1.5 * (1 + stage_length_km / 50) THEN 'ratio_outlier'
        WHEN n >= 3 AND std > 0 AND abs(time_seconds - mean) / std > {limit} THEN 'z_score_outlier' END AS reason
      FROM (SELECT *, stage_length_km / time_seconds * 3600 AS speed, min(time_seconds) OVER w AS best, avg(time_seconds) OVER w AS mean,
                   stddev_pop(time_seconds) OVER w AS std, count(*) OVER w AS n
            FROM timed WINDOW w AS (PARTITION BY rally_id, stage_id, car_class)))"""


@query("anomaly_tags", with_ctes(fx.TIMED, _anomaly_sql("CASE WHEN stage_length_km < 7 THEN 3.5 ELSE 3.0 END")))
def anomaly_tags(spark, d):
    return facts.anomaly_tags(fx.timed_results(spark, d)).select("result_id", "anomaly_reason", "is_anomaly")


@query("anomaly_tags_fixed", with_ctes(fx.TIMED, _anomaly_sql("3.0")))
def anomaly_tags_fixed(spark, d):
    return facts.anomaly_tags(fx.timed_results(spark, d), adaptive=False).select("result_id", "anomaly_reason", "is_anomaly")


@query(
    "anomaly_report",
    with_ctes(
        fx.TIMED,
        f"""SELECT coalesce(anomaly_reason, 'none') AS reason, count(*) AS rows, round(count(*) / CAST((SELECT count(*) FROM timed) AS DOUBLE), 9) AS share
            FROM ({_anomaly_sql("CASE WHEN stage_length_km < 7 THEN 3.5 ELSE 3.0 END")}) GROUP BY 1""",
    ),
)
def anomaly_report(spark, d):
    return rounded(facts.anomaly_report(facts.anomaly_tags(fx.timed_results(spark, d))), 9)


OVERALL = ["driver_stages_completed", "is_rookie", "driver_best_ratio_season", "driver_mean_ratio_overall", "driver_std_ratio_surface", "driver_momentum"]
OVERALL_SQL = f"""row_number() OVER ({H}) - 1 AS driver_stages_completed, row_number() OVER ({H}) = 1 AS is_rookie,
  round(min(ratio_to_class_best) OVER ({H} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS driver_best_ratio_season,
  round(avg(ratio_to_class_best) OVER ({H} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), 6) AS driver_mean_ratio_overall,
  round(stddev_samp(ratio_to_class_best) OVER ({H} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), 6) AS driver_std_ratio_surface,
  round(CASE WHEN row_number() OVER ({H}) > 10 THEN avg(ratio_to_class_best) OVER ({H} ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING)
         - avg(ratio_to_class_best) OVER ({H} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) WHEN row_number() OVER ({H}) > 1 THEN 0.0 END, 6) AS driver_momentum"""


@query("history_overall", with_ctes(fx.RATED, f"SELECT result_id, {OVERALL_SQL} FROM rated"))
def history_overall(spark, d):
    return rounded(history.history_overall(fx.rated_results(spark, d)).select("result_id", *OVERALL))


@query("is_rookie", with_ctes(fx.RATED, f"SELECT driver_id, result_id FROM rated QUALIFY row_number() OVER ({H}) = 1"))
def is_rookie(spark, d):
    return history.history_overall(fx.rated_results(spark, d)).where("is_rookie").select("driver_id", "result_id")


@query("history_momentum", with_ctes(fx.RATED, f"SELECT result_id, driver_momentum FROM (SELECT result_id, {OVERALL_SQL} FROM rated)"))
def history_momentum(spark, d):
    return rounded(history.history_overall(fx.rated_results(spark, d)).select("result_id", "driver_momentum"))


@query(
    "history_surface",
    with_ctes(
        fx.RATED,
        """SELECT result_id, round(avg(ratio_to_class_best) OVER (PARTITION BY driver_id, surface ORDER BY rally_date, rally_id, stage_number, result_id
           ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), 6) AS driver_mean_ratio_surface FROM rated""",
    ),
)
def history_surface(spark, d):
    return rounded(history.history_surface(fx.rated_results(spark, d)).select("result_id", "driver_mean_ratio_surface"))


@query(
    "history_rally",
    with_ctes(
        fx.RATED,
        f"""SELECT result_id, round(avg(ratio_to_class_best) OVER ({HR} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS driver_avg_ratio_this_rally,
            round(avg(ratio_to_class_best) OVER ({HR} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS driver_last3_ratio_same_rally FROM rated""",
    ),
)
def history_rally(spark, d):
    return rounded(history.history_rally(fx.rated_results(spark, d)).select("result_id", "driver_avg_ratio_this_rally", "driver_last3_ratio_same_rally"))


SHORT_SQL = f"""SELECT result_id, CASE WHEN len(prev) >= 3 THEN round(list_avg(prev[-10:]), 6) END AS driver_short_stage_ratio FROM (
   SELECT result_id, list(ratio_to_class_best) FILTER (WHERE stage_length_km < 7) OVER ({H} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM rated)"""


@query("history_short_stage", with_ctes(fx.RATED, SHORT_SQL))
def history_short_stage(spark, d):
    return rounded(history.history_short_stage(fx.rated_results(spark, d)).select("result_id", "driver_short_stage_ratio"))


@query(
    "expanding_baseline",
    with_ctes(
        fx.RATED,
        """SELECT result_id, round(coalesce(avg(ratio_to_class_best) OVER (PARTITION BY driver_id ORDER BY rally_id, stage_number, result_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), avg(ratio_to_class_best) OVER (PARTITION BY driver_id)), 6) AS baseline_ratio FROM rated""",
    ),
)
def expanding_baseline(spark, d):
    return rounded(history.expanding_baseline(fx.rated_results(spark, d)).select("result_id", "baseline_ratio"))


@query(
    "rolling_baseline_15",
    with_ctes(
        fx.RATED,
        f"""SELECT result_id, round(coalesce(avg(ratio_to_class_best) OVER ({H} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING),
            (SELECT avg(ratio_to_class_best) FROM rated)), 6) AS baseline_ratio FROM rated""",
    ),
)
def rolling_baseline_15(spark, d):
    return rounded(history.rolling_baseline(fx.rated_results(spark, d)).select("result_id", "baseline_ratio"))


@query(
    "rolling_momentum_3_6",
    with_ctes(
        fx.RATED,
        f"""SELECT result_id, round(coalesce(avg(ratio_to_class_best) OVER ({H} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
            / avg(ratio_to_class_best) OVER ({H} ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING), 1.0), 6) AS momentum_factor FROM rated""",
    ),
)
def rolling_momentum_3_6(spark, d):
    return rounded(history.rolling_momentum(fx.rated_results(spark, d)).select("result_id", "momentum_factor"))


@query("driver_stage_count", with_ctes(fx.TIMED, f"SELECT result_id, row_number() OVER ({H}) AS driver_stage_count FROM timed"))
def driver_stage_count(spark, d):
    return history.driver_stage_count(fx.timed_results(spark, d)).select("result_id", "driver_stage_count")


@query(
    "driver_means",
    with_ctes(
        fx.RATED,
        """SELECT result_id, round(avg(ratio_to_class_best) OVER (PARTITION BY driver_id), 6) AS driver_avg_ratio,
           round(avg(ratio_to_class_best) OVER (PARTITION BY driver_id, surface), 6) AS driver_surface_ratio FROM rated""",
    ),
)
def driver_means(spark, d):
    return rounded(history.driver_means(fx.rated_results(spark, d)).select("result_id", "driver_avg_ratio", "driver_surface_ratio"))


@query(
    "stage_progress",
    with_ctes(
        fx.TIMED,
        """SELECT result_id, round((stage_number - min(stage_number) OVER w) / CAST(max(stage_number) OVER w - min(stage_number) OVER w + 1e-6 AS DOUBLE), 6) AS stage_progress
           FROM timed WINDOW w AS (PARTITION BY rally_id)""",
    ),
)
def stage_progress(spark, d):
    return rounded(history.stage_progress(fx.timed_results(spark, d)).select("result_id", "stage_progress"))


FORM = fx.RATED + """,
per_rally AS (SELECT driver_id, rally_id, avg(ratio_to_class_best) AS avg_ratio, count(*) AS stage_count FROM rated GROUP BY 1, 2),
form AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY driver_id ORDER BY CAST(rally_id AS BIGINT) DESC, rally_id DESC) AS recency FROM per_rally) WHERE recency <= 5),
base_ratio AS MATERIALIZED (
  SELECT driver_id, sum(w * avg_ratio) / sum(w) AS baseline_ratio, count(*) AS data_points, CAST(sum(stage_count) AS BIGINT) AS total_stages,
         max(CASE WHEN recency = 1 THEN avg_ratio END) AS recent_rally_avg, avg(avg_ratio) AS all_avg
  FROM (SELECT *, CASE recency WHEN 1 THEN 0.4::DOUBLE WHEN 2 THEN 0.3::DOUBLE WHEN 3 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS w FROM form) GROUP BY 1)
"""


@query("driver_rally_form", with_ctes(FORM, "SELECT driver_id, rally_id, round(avg_ratio, 6) AS avg_ratio, stage_count, recency FROM form"))
def driver_rally_form(spark, d):
    return rounded(history.driver_rally_form(fx.rated_results(spark, d)))


@query(
    "recency_weighted_baseline",
    with_ctes(FORM, "SELECT driver_id, round(baseline_ratio, 6) AS baseline_ratio, data_points, total_stages, round(recent_rally_avg, 6) AS recent_rally_avg, round(all_avg, 6) AS all_avg FROM base_ratio"),
)
def recency_weighted_baseline(spark, d):
    return rounded(history.recency_weighted_baseline(fx.rated_results(spark, d)))


MOMENTUM_COLUMNS_SQL = """round(momentum, 6) AS momentum, round(greatest(0.9, least(1 - momentum, 1.1)), 6) AS momentum_factor,
  CASE WHEN rally_avg IS NULL THEN 'Ralli henuz baslamadi' WHEN momentum > 0.03 THEN 'Mukemmel form' WHEN momentum > 0.01 THEN 'Iyi form'
       WHEN momentum > -0.01 THEN 'Normal form' WHEN momentum > -0.03 THEN 'Dusuk form' ELSE 'Kotu form' END AS momentum_status"""


@query(
    "rally_momentum",
    with_ctes(
        FORM,
        f"""SELECT result_id, stages_analyzed, round(rally_avg, 6) AS rally_avg, {MOMENTUM_COLUMNS_SQL} FROM (
            SELECT *, CASE WHEN rally_avg IS NULL THEN 0.0 ELSE (baseline_ratio - rally_avg) / baseline_ratio END AS momentum FROM (
              SELECT result_id, baseline_ratio, count(*) OVER w AS stages_analyzed, avg(ratio_to_class_best) OVER w AS rally_avg
              FROM rated JOIN base_ratio USING (driver_id)
              WINDOW w AS ({HR} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))""",
    ),
)
def rally_momentum(spark, d):
    rated = fx.rated_results(spark, d)
    based = rated.join(history.recency_weighted_baseline(rated).select("driver_id", "baseline_ratio"), "driver_id")
    return rounded(history.rally_momentum(based).select("result_id", "stages_analyzed", "rally_avg", "momentum", "momentum_factor", "momentum_status"))


TREND_SQL = """trend AS (SELECT driver_id, rally_id, CASE WHEN n < 2 THEN 'yetersiz veri' WHEN last_p < first_p THEN 'yukseliyor' WHEN last_p > first_p THEN 'dusuyor' ELSE 'sabit' END AS position_trend
  FROM (SELECT driver_id, rally_id, count(*) AS n, arg_min(class_position, age) AS last_p, arg_max(class_position, age) AS first_p
        FROM (SELECT *, row_number() OVER (PARTITION BY driver_id, rally_id ORDER BY stage_number DESC, result_id DESC) AS age FROM placed) WHERE age <= 3 GROUP BY 1, 2))"""
PLACED_SQL = "placed AS (SELECT *, row_number() OVER (PARTITION BY stage_id, car_class ORDER BY time_seconds, result_id) AS class_position FROM rated)"


@query("position_trend", with_ctes(f"{fx.RATED}, {PLACED_SQL}, {TREND_SQL}", "SELECT * FROM trend"))
def position_trend(spark, d):
    return history.position_trend(facts.class_position(fx.timed_results(spark, d), KEYS))


@query(
    "live_momentum",
    with_ctes(
        f"{FORM}, {PLACED_SQL}, {TREND_SQL}",
        f"""SELECT driver_id, rally_id, round(rally_avg, 6) AS rally_avg, stages_analyzed, position_trend, {MOMENTUM_COLUMNS_SQL} FROM (
            SELECT *, (baseline_ratio - rally_avg) / baseline_ratio AS momentum FROM (
              SELECT driver_id, rally_id, avg(ratio_to_class_best) AS rally_avg, count(*) AS stages_analyzed FROM placed GROUP BY 1, 2)
            JOIN trend USING (driver_id, rally_id) JOIN base_ratio USING (driver_id))""",
    ),
)
def live_momentum(spark, d):
    base = history.recency_weighted_baseline(fx.rated_results(spark, d))
    live = fx.timed_results(spark, d).withColumnRenamed("car_class", "normalized_class")
    out = history.live_momentum(live, base)
    return rounded(out.select("driver_id", "rally_id", "rally_avg", "stages_analyzed", "position_trend", "momentum", "momentum_factor", "momentum_status"))


LAST15 = fx.RATED + """,
last15 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY driver_id ORDER BY CAST(rally_id AS BIGINT) DESC, stage_number DESC, result_id DESC) AS recency FROM rated) WHERE recency <= 15)
"""


@query("last_n_history", with_ctes(LAST15, "SELECT driver_id, result_id, recency FROM last15"))
def last_n_history(spark, d):
    return history.last_n_history(fx.timed_results(spark, d)).select("driver_id", "result_id", "recency")


FORM55_SQL = """SELECT driver_id, n, round(CASE WHEN n >= 10 THEN r5 ELSE ra END, 6) AS recent_avg_ratio, round(CASE WHEN n >= 10 THEN o5 ELSE ra END, 6) AS historical_avg_ratio,
  round(delta, 6) AS momentum_delta, CASE WHEN n < 10 THEN 'Yetersiz veri' WHEN delta > 2 THEN 'Hizlaniyor' WHEN delta < -2 THEN 'Yavasliyor' ELSE 'Stabil' END AS momentum,
  CASE WHEN n >= 10 AND delta > 2 THEN 0.99::DOUBLE WHEN n >= 10 AND delta < -2 THEN 1.01::DOUBLE ELSE 1.0::DOUBLE END AS form_factor
  FROM (SELECT *, CASE WHEN n >= 10 THEN (o5 - r5) * 100 ELSE 0.0::DOUBLE END AS delta FROM (
    SELECT driver_id, count(*) AS n, avg(ratio_to_class_best) AS ra, avg(ratio_to_class_best) FILTER (WHERE recency <= 5) AS r5,
           avg(ratio_to_class_best) FILTER (WHERE recency BETWEEN 6 AND 10) AS o5 FROM last15 GROUP BY 1))"""


@query("form_5v5", with_ctes(LAST15, FORM55_SQL))
def form_5v5(spark, d):
    return rounded(history.form_5v5(history.last_n_history(fx.rated_results(spark, d))))


@query(
    "carry_last_state",
    with_ctes(f"{fx.RATED}, {PLACED_SQL}", f"SELECT result_id, lag(car_class) OVER ({HR}) AS prev_car_class, lag(class_position) OVER ({HR}) AS prev_class_position FROM placed"),
)
def carry_last_state(spark, d):
    placed = facts.class_position(fx.timed_results(spark, d), KEYS)
    return history.carry_last_state(placed, ["car_class", "class_position"]).select("result_id", "prev_car_class", "prev_class_position")


@query("first_per_key", with_ctes(fx.TIMED, "SELECT driver_id, result_id, time_seconds FROM timed QUALIFY row_number() OVER (PARTITION BY driver_id ORDER BY time_seconds, result_id) = 1"))
def first_per_key(spark, d):
    t = fx.timed_results(spark, d).select("driver_id", "result_id", "time_seconds")
    return history.first_per_key(t, ["driver_id"], ["time_seconds", "result_id"])


@query(
    "average_rank",
    with_ctes(fx.TIMED, "SELECT result_id, rank() OVER (PARTITION BY stage_id ORDER BY time_seconds) + (count(*) OVER (PARTITION BY stage_id, time_seconds) - 1) / 2.0::DOUBLE AS time_rank FROM timed"),
)
def average_rank(spark, d):
    return history.average_rank(fx.timed_results(spark, d), ["stage_id"], "time_seconds", "time_rank").select("result_id", "time_rank")


def walked(spark, d, *columns):
    """The named history columns of every result. Their medians and the rows they go into read one written table."""
    rated = stored(fx.rated_results(spark, d, stored(fx.timed_results(spark, d))))
    return stored(history.history_overall(rated).select("result_id", *columns))


@query(
    "impute_surface_median",
    with_ctes(
        fx.RATED,
        f"""SELECT result_id, round(CASE WHEN is_rookie THEN coalesce(m, median(m) OVER (PARTITION BY surface)) ELSE m END, 6) AS driver_mean_ratio_overall
            FROM (SELECT result_id, surface, row_number() OVER ({H}) = 1 AS is_rookie, avg(ratio_to_class_best) OVER ({H} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS m FROM rated)""",
    ),
)
def impute_surface_median(spark, d):
    h = walked(spark, d, "surface", "is_rookie", "driver_mean_ratio_overall")
    return rounded(history.impute_surface_median(h, ["driver_mean_ratio_overall"]).select("result_id", "driver_mean_ratio_overall"))


@query(
    "impute_median",
    with_ctes(
        fx.RATED,
        f"""SELECT result_id, round(coalesce(s, (SELECT median(s) FROM h)), 6) AS driver_std_ratio_surface FROM h""",
    ).replace("SELECT result_id, round(coalesce(s", f", h AS MATERIALIZED (SELECT result_id, stddev_samp(ratio_to_class_best) OVER ({H} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS s FROM rated)\nSELECT result_id, round(coalesce(s"),
)
def impute_median(spark, d):
    h = walked(spark, d, "driver_std_ratio_surface")
    return rounded(history.impute_median(h, ["driver_std_ratio_surface"]).select("result_id", "driver_std_ratio_surface"))


@query(
    "asof_previous_stage",
    with_ctes(
        fx.STAGES,
        """SELECT stage_id, max(CASE WHEN result_count > 0 AND stage_number % 3 <> 0 THEN stage_number END) OVER (PARTITION BY rally_id ORDER BY stage_number
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_stage FROM stage""",
    ),
)
def asof_previous_stage(spark, d):
    s = fx.stages(spark, d).withColumn("result_count", F.when(F.col("stage_number") % 3 == 0, 0).otherwise(F.col("result_count")))
    return history.asof_previous_stage(s).select("stage_id", "previous_stage")
