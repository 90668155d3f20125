"""Inputs derived from the general test tables, each as a DataFrame and as the same SQL for the oracle.

The tables hold orders and events, not stage times, so a fixed rule turns them into timed results, route points,
stage geometry and so on. Every input grows with the tables it is read from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitclock.operators.series import with_position


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (event month, stage, customer): the fastest of the customer's line items there."""
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    ev = F.year("l_shipdate") * 100 + F.month("l_shipdate")
    stage = (F.col("l_suppkey") % 10 + 1).cast("int")
    pace = 36 + (F.round(F.col("l_extendedprice") * 100).cast("bigint") % 3700) / F.lit(100.0) + F.when(F.col("l_quantity") == 50, 70).otherwise(0)
    # A line is its order, month, stage and pace before it is shuffled.
    lines = li.select("l_orderkey", ev.alias("ev"), stage.alias("stage_number"), pace.alias("pace"))
    # Orders meet their customers first: they are fewer than lines, which are then shuffled once for both.
    asked = o.select("o_orderkey", "o_custkey").join(c.select("c_custkey", "c_mktsegment"), o.o_custkey == c.c_custkey)
    joined = lines.join(asked, lines.l_orderkey == asked.o_orderkey)
    base = joined.select(
        "ev",
        "stage_number",
        F.col("o_custkey").alias("driver_id"),
        F.col("c_mktsegment"),
        (5 + (F.col("stage_number") * 7 + F.col("ev") % 13) % 25).alias("km"),
        "pace",
    )
    # A customer has one segment, so it may join the keys; that keeps the aggregation a hash aggregation.
    grouped = base.groupBy("ev", "stage_number", "driver_id", "km", F.col("c_mktsegment").alias("car_class")).agg(
        F.min(F.col("pace") * F.col("km")).alias("time_seconds")
    )
    stage_id = F.concat(F.col("ev"), F.lit("_ss"), F.col("stage_number"))
    return grouped.select(
        "ev",
        F.col("ev").cast("string").alias("rally_id"),
        F.make_date(F.floor(F.col("ev") / 100).cast("int"), F.col("ev") % 100, F.lit(1)).alias("rally_date"),
        "stage_number",
        stage_id.alias("stage_id"),
        F.concat(stage_id, F.lit("_"), F.col("driver_id")).alias("result_id"),
        "driver_id",
        "car_class",
        F.when(F.col("ev") % 3 == 0, "gravel").when(F.col("ev") % 3 == 1, "asphalt").otherwise("snow").alias("surface"),
        F.col("km").cast("double").alias("stage_length_km"),
        "time_seconds",
    )


TIMED = """
base AS (
  SELECT year(l_shipdate)*100 + month(l_shipdate) AS ev, CAST(l_suppkey % 10 + 1 AS INTEGER) AS stage_number,
         o_custkey, c_mktsegment,
         5 + ((l_suppkey % 10 + 1)*7 + (year(l_shipdate)*100 + month(l_shipdate)) % 13) % 25 AS km,
         36 + (CAST(round(l_extendedprice*100) AS BIGINT) % 3700)/100.0 + CASE WHEN l_quantity = 50 THEN 70 ELSE 0 END AS pace
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
timed AS MATERIALIZED (
  SELECT ev, CAST(ev AS VARCHAR) AS rally_id, make_date(CAST(ev // 100 AS INTEGER), CAST(ev % 100 AS INTEGER), 1) AS rally_date,
         stage_number, concat(ev, '_ss', stage_number) AS stage_id,
         concat(ev, '_ss', stage_number, '_', o_custkey) AS result_id,
         o_custkey AS driver_id, min(c_mktsegment) AS car_class,
         CASE ev % 3 WHEN 0 THEN 'gravel' WHEN 1 THEN 'asphalt' ELSE 'snow' END AS surface,
         CAST(km AS DOUBLE) AS stage_length_km, min(CAST(pace AS DOUBLE) * km) AS time_seconds
  FROM base GROUP BY ev, stage_number, o_custkey, km)
"""


def rated_results(spark: SparkSession, sf_dir: str, timed: DataFrame | None = None) -> DataFrame:
    """Timed results with their class leader's time and ratio; ``timed`` holds them if they have been written."""
    from splitclock.operators.facts import ratio_to_class_best

    return ratio_to_class_best(timed_results(spark, sf_dir) if timed is None else timed, ("stage_id", "car_class"), write=timed is not None)


RATED = TIMED + """,
rated AS MATERIALIZED (
  SELECT *, min(time_seconds) OVER (PARTITION BY stage_id, car_class) AS class_best_time,
         time_seconds / min(time_seconds) OVER (PARTITION BY stage_id, car_class) AS ratio_to_class_best
  FROM timed)
"""

FIRST_NAMES = ["Alp", "Berkin", "Çağan", "Defne", "Emre", "Fügen", "Görkem", "Hülya", "Kayra", "Lâle", "Mert", "Özge"]
LAST_NAMES = ["Akçay", "Bozkurt", "Çetin", "Demirel", "Erözü", "Günay", "Kuşçu", "Şenel"]
RAW_CLASSES = ["R4", "rally 2", " Rally3 ", "R2", "S2000", "Kategori 1", "RALLY5", "Prototype", "N", ""]
PLACES = ["Bodrum", "Marmaris", "Kocaeli", "Ege", "Troia", "Hitit", "Yeşil Bursa", "Anadolu"]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql_pick(values: list[str], index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({index} AS INTEGER) + 1]"


def raw_results(spark: SparkSession, sf_dir: str, timed: DataFrame | None = None) -> DataFrame:
    """Results as a feed delivers them: spellings that differ by event, raw class names, missing values."""
    t = timed_results(spark, sf_dir) if timed is None else timed
    ev, d, s = F.col("ev"), F.col("driver_id"), F.col("stage_number")
    plain = F.concat(_pick(FIRST_NAMES, d % 12), F.lit(" "), _pick(LAST_NAMES, F.floor(d / 12) % 8), F.lit(" "), d)
    name = F.when(ev % 4 == 1, F.lower(plain)).when(ev % 4 == 2, F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")))).when(ev % 4 == 3, F.replace(plain, F.lit("ü"), F.lit("u"))).otherwise(plain)
    no_time = (d % 17 == 0) & (s == 5)
    return t.select(
        "ev",
        "result_id",
        "rally_id",
        F.concat(_pick(PLACES, ev % 8), F.lit(" Rallisi "), F.floor(ev / 100)).alias("rally_name"),
        "rally_date",
        "stage_number",
        F.concat(F.lit("ÖE"), s, F.lit(" - "), _pick(PLACES, (ev + s) % 8), F.lit(" - "), F.format_string("%d,5km", F.col("stage_length_km").cast("int"))).alias("stage_name"),
        "stage_length_km",
        (d % 500).cast("string").alias("car_number"),
        name.alias("driver_name"),
        F.lit(None).cast("string").alias("co_driver_name"),
        _pick(RAW_CLASSES, d % 10).alias("car_class"),
        F.concat(F.lit("Model "), d % 7).alias("vehicle"),
        F.when(no_time, "DNF").otherwise(
            F.format_string("%d:%02d.%02d", F.floor(F.col("time_seconds") / 60), F.floor(F.col("time_seconds")) % 60, F.round(F.col("time_seconds") * 100).cast("bigint") % 100)
        ).alias("time_str"),
        F.when(~no_time, F.col("time_seconds")).alias("time_seconds"),
        F.lit(None).cast("string").alias("diff_str"),
        F.lit(None).cast("double").alias("diff_seconds"),
        F.when(s == 7, "").when(ev % 2 == 0, F.upper("surface")).otherwise(F.col("surface")).alias("surface"),
        F.when(no_time, "DNF").when(d % 3 == 0, "OK").when(d % 3 == 1, "FINISHED").alias("status"),
    )


_PLAIN = f"concat({_sql_pick(FIRST_NAMES, 'driver_id % 12')}, ' ', {_sql_pick(LAST_NAMES, '(driver_id // 12) % 8')}, ' ', driver_id)"
RAW = TIMED + f""",
raw AS MATERIALIZED (
  SELECT ev, driver_id AS person, result_id, rally_id, concat({_sql_pick(PLACES, 'ev % 8')}, ' Rallisi ', ev // 100) AS rally_name,
         rally_date, stage_number,
         concat('ÖE', stage_number, ' - ', {_sql_pick(PLACES, '(ev + stage_number) % 8')}, ' - ', CAST(stage_length_km AS INTEGER), ',5km') AS stage_name,
         stage_length_km, CAST(driver_id % 500 AS VARCHAR) AS car_number,
         CASE ev % 4 WHEN 1 THEN lower({_PLAIN}) WHEN 2 THEN concat(' ', replace({_PLAIN}, ' ', '  '))
              WHEN 3 THEN replace({_PLAIN}, 'ü', 'u') ELSE {_PLAIN} END AS driver_name,
         {_sql_pick(RAW_CLASSES, 'driver_id % 10')} AS car_class, concat('Model ', driver_id % 7) AS vehicle,
         CASE WHEN driver_id % 17 = 0 AND stage_number = 5 THEN 'DNF'
              ELSE printf('%d:%02d.%02d', CAST(floor(time_seconds / 60) AS BIGINT), CAST(floor(time_seconds) AS BIGINT) % 60, CAST(round(time_seconds * 100) AS BIGINT) % 100) END AS time_str,
         CASE WHEN driver_id % 17 = 0 AND stage_number = 5 THEN NULL ELSE time_seconds END AS time_seconds,
         CASE WHEN stage_number = 7 THEN '' WHEN ev % 2 = 0 THEN upper(surface) ELSE surface END AS surface,
         CASE WHEN driver_id % 17 = 0 AND stage_number = 5 THEN 'DNF' WHEN driver_id % 3 = 0 THEN 'OK' WHEN driver_id % 3 = 1 THEN 'FINISHED' END AS status
  FROM timed)
"""


def stages(spark: SparkSession, sf_dir: str, timed: DataFrame | None = None) -> DataFrame:
    """One row per stage with its number of results."""
    return (
        (timed_results(spark, sf_dir) if timed is None else timed)
        .groupBy("ev", "rally_id", "stage_number", "stage_id", "surface", "stage_length_km")
        .agg(F.count(F.lit(1)).alias("result_count"))
    )


STAGES = TIMED + """,
stage AS MATERIALIZED (
  SELECT ev, rally_id, stage_number, stage_id, surface, stage_length_km, count(*) AS result_count
  FROM timed GROUP BY ALL)
"""


def stage_geometry(spark: SparkSession, sf_dir: str, timed: DataFrame | None = None) -> DataFrame:
    """A geometry record for each stage with a number other than 9, by fixed arithmetic on its keys."""
    s = stages(spark, sf_dir, timed).where("stage_number <> 9")
    ev, n = F.col("ev"), F.col("stage_number")
    flat = (n == 8) & (ev % 2 == 0)
    ascent = F.when(flat, 0.0).otherwise((ev * 3 + n * 29) % 600 * F.lit(1.0))
    density = (ev * 7 + n * 13) % 17 / F.lit(10.0)
    return s.select(
        "ev", "stage_id", "rally_id", "stage_number", F.concat(F.lit("SS"), n).alias("stage_name"),
        F.when(n % 4 == 0, F.upper("surface")).when(n % 4 == 1, F.lit(None)).otherwise(F.col("surface")).alias("surface"),
        F.col("stage_length_km").alias("distance_km"),
        ((ev + n) % 12).cast("int").alias("hairpin_count"),
        density.alias("hairpin_density"),
        ((ev * 2 + n) % 40).cast("int").alias("turn_count"),
        ((ev + n * 3) % 30 / F.lit(10.0)).alias("turn_density"),
        ascent.alias("total_ascent"),
        F.when(flat, 0.0).otherwise((ev * 5 + n * 11) % 500 * F.lit(1.0)).alias("total_descent"),
        F.when(flat, 0.0).otherwise((ev + n * 7) % 15 * F.lit(1.0)).alias("max_grade"),
        ((ev + n) % 8 / F.lit(2.0)).alias("avg_abs_grade"),
        ((ev + n * 5) % 100 / F.lit(10000.0)).alias("p95_curvature"),
        ((ev * 3 + n) % 50 / F.lit(10000.0)).alias("avg_curvature"),
        ((ev + n * 2) % 90 / F.lit(1000.0)).alias("max_curvature"),
        ((ev + n) % 20 / F.lit(4.0)).alias("curvature_density"),
        ((ev * 11 + n) % 100 * F.lit(1.0)).alias("straight_percentage"),
        (100 - (ev * 11 + n) % 100 * F.lit(1.0)).alias("curvy_percentage"),
        F.concat(F.lit("s"), "stage_id", F.lit(".kml")).alias("source_kml"),
    )


GEOMETRY = STAGES + """,
geometry AS MATERIALIZED (
  SELECT ev, stage_id, rally_id, stage_number, concat('SS', stage_number) AS stage_name,
         CASE stage_number % 4 WHEN 0 THEN upper(surface) WHEN 1 THEN NULL ELSE surface END AS surface,
         stage_length_km AS distance_km, CAST((ev + stage_number) % 12 AS INTEGER) AS hairpin_count,
         CAST((ev * 7 + stage_number * 13) % 17 AS DOUBLE) / 10.0 AS hairpin_density,
         CAST((ev * 2 + stage_number) % 40 AS INTEGER) AS turn_count,
         CAST((ev + stage_number * 3) % 30 AS DOUBLE) / 10.0 AS turn_density,
         CASE WHEN stage_number = 8 AND ev % 2 = 0 THEN 0.0 ELSE CAST((ev * 3 + stage_number * 29) % 600 AS DOUBLE) END AS total_ascent,
         CASE WHEN stage_number = 8 AND ev % 2 = 0 THEN 0.0 ELSE CAST((ev * 5 + stage_number * 11) % 500 AS DOUBLE) END AS total_descent,
         CASE WHEN stage_number = 8 AND ev % 2 = 0 THEN 0.0 ELSE CAST((ev + stage_number * 7) % 15 AS DOUBLE) END AS max_grade,
         CAST((ev + stage_number) % 8 AS DOUBLE) / 2.0 AS avg_abs_grade,
         CAST((ev + stage_number * 5) % 100 AS DOUBLE) / 10000.0 AS p95_curvature,
         CAST((ev * 3 + stage_number) % 50 AS DOUBLE) / 10000.0 AS avg_curvature,
         CAST((ev + stage_number * 2) % 90 AS DOUBLE) / 1000.0 AS max_curvature,
         CAST((ev + stage_number) % 20 AS DOUBLE) / 4.0 AS curvature_density,
         CAST((ev * 11 + stage_number) % 100 AS DOUBLE) AS straight_percentage,
         100 - CAST((ev * 11 + stage_number) % 100 AS DOUBLE) AS curvy_percentage,
         concat('s', stage_id, '.kml') AS source_kml
  FROM stage WHERE stage_number <> 9)
"""


def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One route per user: the user's events in time order become a winding line; some altitudes are unknown (0)."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", F.to_date("ts").alias("day"))
    p = with_position(e, ["user_id"], ["ts", "event_id"], ["day"], "seq")
    s = F.col("seq")
    wiggle = (F.floor("value").cast("bigint") % 9 - 4) * F.lit(0.00012)
    return p.select(
        F.col("user_id").alias("route_id"),
        "seq",
        (38.0 + s * F.lit(0.0006) + wiggle).alias("lat"),
        (28.0 + (s % 7) * F.lit(0.0005) + s * F.lit(0.0002) - wiggle).alias("lon"),
        F.when(s % 10 == 0, 0.0).otherwise(200.0 + (s * s) % 37 * F.lit(1.0) + F.floor("value") % 5).alias("alt"),
    )


POINTS = """
pt AS MATERIALIZED (
  SELECT user_id AS route_id, seq, 38.0::DOUBLE + seq * 0.0006::DOUBLE + w AS lat,
         28.0::DOUBLE + (seq % 7) * 0.0005::DOUBLE + seq * 0.0002::DOUBLE - w AS lon,
         CASE WHEN seq % 10 = 0 THEN 0.0::DOUBLE ELSE 200.0::DOUBLE + CAST((seq * seq) % 37 AS DOUBLE) + v % 5 END AS alt
  FROM (SELECT *, (v % 9 - 4) * 0.00012::DOUBLE AS w
        FROM (SELECT user_id, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)))
"""
