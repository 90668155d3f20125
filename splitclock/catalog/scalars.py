"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitclock import fixtures as fx
from splitclock.catalog.registry import query, rounded, with_ctes
from splitclock.functions import classes, scoring, text, times
from splitclock.plans import features

TEXTS = fx.TIMED + """,
parts AS (SELECT *, cs // 6000 AS m, cs // 100 % 60 AS s, cs % 100 AS f, cs // 360000 AS h, cs // 6000 % 60 AS mm FROM (SELECT *, CAST(round(time_seconds * 100) AS BIGINT) AS cs FROM timed)),
texts AS MATERIALIZED (SELECT *, CASE driver_id % 8 WHEN 0 THEN printf('%d:%02d.%02d', m, s, f) WHEN 1 THEN printf('%d:%02d:%02d.%02d', h, mm, s, f) WHEN 2 THEN printf('%d:%02d', m, s)
  WHEN 3 THEN printf('%02d:%02d:%d', m, s, f // 10) WHEN 4 THEN 'DNF' WHEN 5 THEN '' WHEN 6 THEN printf('%d:%02d:%02d', h, mm, s) ELSE 'invalid' END AS txt FROM parts)
"""


def time_texts(spark, d):
    """Result times written in each of the known layouts, chosen by driver."""
    t = fx.timed_results(spark, d).withColumn("cs", F.round(F.col("time_seconds") * 100).cast("bigint"))
    cs = F.col("cs")
    m, s, f, h, mm = F.floor(cs / 6000), F.floor(cs / 100) % 60, cs % 100, F.floor(cs / 360000), F.floor(cs / 6000) % 60
    k = F.col("driver_id") % 8
    layout = (
        F.when(k == 0, F.format_string("%d:%02d.%02d", m, s, f)).when(k == 1, F.format_string("%d:%02d:%02d.%02d", h, mm, s, f))
        .when(k == 2, F.format_string("%d:%02d", m, s)).when(k == 3, F.format_string("%02d:%02d:%d", m, s, F.floor(f / 10)))
        .when(k == 4, "DNF").when(k == 5, "").when(k == 6, F.format_string("%d:%02d:%02d", h, mm, s)).otherwise("invalid")
    )
    return t.withColumn("txt", layout)


def _time(case: str) -> str:
    return with_ctes(TEXTS, f"SELECT result_id, txt, round(CAST(CASE driver_id % 8 {case} END AS DOUBLE), 6) AS seconds FROM texts")


def _parsed(spark, d, parser):
    return rounded(time_texts(spark, d).select("result_id", "txt", parser(F.col("txt")).alias("seconds")))


@query("parse_stage_time", _time("WHEN 0 THEN m * 60 + s + f / 100.0 WHEN 1 THEN cs / 100.0 WHEN 2 THEN m * 60 + s WHEN 3 THEN m * 60 + s + (f // 10) / 10.0 WHEN 6 THEN h * 3600 + mm * 60 + s"))
def parse_stage_time(spark, d):
    return _parsed(spark, d, times.parse_stage_time)


@query(
    "parse_live_time",
    _time(
        """WHEN 0 THEN m * 60 + s + f / 100.0 WHEN 1 THEN CASE WHEN s < 10 THEN h * 60 + mm + (s + f / 100.0) / 10 ELSE cs / 100.0 END WHEN 2 THEN m * 60 + s WHEN 3 THEN m * 60 + s + (f // 10) / 10.0
           WHEN 6 THEN CASE WHEN s < 10 THEN h * 60 + mm + s / 10.0 ELSE h * 3600 + mm * 60 + s END ELSE 0"""
    ),
)
def parse_live_time(spark, d):
    return _parsed(spark, d, times.parse_live_time)


@query(
    "parse_manual_time",
    _time("WHEN 0 THEN CASE WHEN s + f / 100.0 > 0 THEN m * 60 + s + f / 100.0 END WHEN 2 THEN CASE WHEN s > 0 THEN m * 60 + s END WHEN 3 THEN m * 60 + s + (f // 10) / 10.0 WHEN 6 THEN h * 3600 + mm * 60 + s"),
)
def parse_manual_time(spark, d):
    return _parsed(spark, d, times.parse_manual_time)


@query("parse_collector_time", _time("WHEN 0 THEN m * 60 + s + f / 10.0 WHEN 1 THEN h * 3600 + mm * 60 + s + f / 10.0 WHEN 2 THEN m * 60 + s WHEN 3 THEN m * 60 + s + (f // 10) / 10.0 WHEN 6 THEN nullif(h * 60 + mm + s / 10.0, 0)"))
def parse_collector_time(spark, d):
    return _parsed(spark, d, times.parse_collector_time)


@query(
    "format_time",
    with_ctes(
        TEXTS,
        """SELECT result_id, CASE WHEN h > 0 THEN printf('%d:%02d:%02d.%02d', h, mm, s, f) ELSE printf('%d:%02d.%02d', m, s, f) END AS long, printf('%d:%02d.%02d', m, s, f) AS minutes, printf('%d:%02d.%02d0', m, s, f) AS millis,
           printf('%02d:%02d:%02d0', m, s, f) AS manual, printf('%02d:%02d,%d', m, s, least(9, CAST(round_even((x - floor(x)) * 10, 0) AS BIGINT))) AS collector FROM (SELECT *, cs / 100.0::DOUBLE AS x FROM texts)""",
    ),
)
def format_time(spark, d):
    t = time_texts(spark, d)
    exact = F.col("cs") / F.lit(100.0)
    return t.select(
        "result_id", times.format_time(exact).alias("long"), times.format_minutes(exact).alias("minutes"), times.format_minutes(exact, 3).alias("millis"), times.format_manual(exact).alias("manual"),
        times.format_collector(exact).alias("collector"),
    )


@query(
    "repair_time_seconds",
    with_ctes(
        fx.RAW,
        """SELECT result_id, round(coalesce(good, 0.0::DOUBLE), 6) AS new_time, CASE WHEN abs(time_seconds - coalesce(good, 0)) > 1 THEN true ELSE false END AS changed, CAST(stage_length_km AS INTEGER) + 0.5::DOUBLE AS new_length
           FROM (SELECT result_id, stage_length_km, CASE WHEN stage_number = 4 THEN time_seconds * 60 ELSE time_seconds END AS time_seconds,
                 CASE WHEN time_str <> 'DNF' THEN CAST(split_part(time_str, ':', 1) AS DOUBLE) * 60 + CAST(split_part(time_str, ':', 2) AS DOUBLE) END AS good FROM raw)""",
    ),
)
def repair_time_seconds(spark, d):
    from splitclock.operators.facts import repair_time_seconds as repair

    raw = fx.raw_results(spark, d)
    broken = raw.withColumn("time_seconds", F.when(F.col("stage_number") == 4, F.col("time_seconds") * 60).otherwise(F.col("time_seconds")))
    return rounded(repair(broken).select("result_id", "new_time", "changed", "new_length"))


@query("length_from_name", with_ctes(fx.RAW, "SELECT result_id, CAST(stage_length_km AS INTEGER) + 0.5::DOUBLE AS km FROM raw"))
def length_from_name(spark, d):
    return fx.raw_results(spark, d).select("result_id", text.length_from_name(F.col("stage_name")).alias("km"))


@query(
    "stage_number_from_text",
    with_ctes(fx.RAW, "SELECT result_id, stage_number AS from_title, stage_number AS from_id, stage_number AS from_file, stage_number AS from_header FROM raw"),
)
def stage_number_from_text(spark, d):
    r = fx.raw_results(spark, d)
    n = F.col("stage_number")
    k = F.col("ev") % 7
    forms = [F.concat(F.lit("SSS 0"), n), F.concat(F.lit("SS"), n, F.lit(" x")), F.concat(F.lit("öe"), n), F.concat(F.lit("Ö. E. "), n), F.concat(F.lit("Etap 0"), n), F.concat(F.lit("Stage "), n), F.concat(n, F.lit(". etap"))]
    title = F.element_at(F.array(*forms), (k + 1).cast("int"))
    return r.select(
        "result_id", text.stage_number_from_text(title).alias("from_title"), text.stage_number_from_id(F.concat("rally_id", F.lit("_ss0"), n)).alias("from_id"),
        text.stage_number_from_file(F.concat("rally_id", F.lit("_stage-"), n, F.lit(".kml"))).alias("from_file"), text.stage_number_from_header(F.col("stage_name")).alias("from_header"),
    )


@query(
    "day_number",
    """SELECT page_id, CAST(page_id % 3 + 1 AS INTEGER) AS day, '20' || CAST(10 + page_id % 15 AS VARCHAR) AS year, CAST(page_id AS INTEGER) AS event_id, CASE WHEN page_id % 2 = 0 THEN CAST(page_id % 12 AS INTEGER) END AS stage,
       CASE WHEN page_id % 4 = 1 THEN CAST(page_id % 3 + 1 AS INTEGER) ELSE 1 END AS list_day FROM pages""",
)
def day_number(spark, d):
    p = fx.table(spark, d, "pages")
    i = F.col("page_id")
    name = F.concat(F.when(i % 2 == 0, F.concat(i % 3 + 1, F.lit(". Gün "))).otherwise(F.concat(F.lit("Day-"), i % 3 + 1, F.lit(" "))), F.lit("20"), 10 + i % 15)
    url = F.concat(F.lit("https://results.example/yaris/"), i, F.when(i % 4 == 1, F.concat(F.lit("/gun"), i % 3 + 1)).otherwise(""), F.lit("/list/?x=1"), F.when(i % 2 == 0, F.concat(F.lit("&etp="), i % 12)).otherwise(""))
    return p.select(
        "page_id", text.day_number(name).alias("day"), text.year_from_text(name).alias("year"), text.event_id_from_url(url).alias("event_id"), text.stage_from_url(url).alias("stage"), text.day_from_url(url).alias("list_day")
    )


NAME_KEY_SQL = r"trim(regexp_replace(regexp_replace(lower(strip_accents(replace(replace({0}, 'ı', 'i'), 'İ', 'i'))), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("normalize_name_key", f"SELECT doc_id, {NAME_KEY_SQL.format('text')} AS name_key FROM documents")
def normalize_name_key(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", text.normalize_name_key(F.col("text")).alias("name_key"))


@query("normalize_name_key_unicode", f"SELECT doc_id, {NAME_KEY_SQL.format('text')} AS name_key FROM documents")
def normalize_name_key_unicode(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", text.normalize_name_key_unicode(F.col("text")).alias("name_key"))


@query(
    "slugify",
    with_ctes(
        fx.RAW,
        f"""SELECT result_id, s AS slug, concat('drv_', s) AS driver_id, concat(rally_id, '_ss', stage_number) AS stage_id FROM (SELECT *, regexp_replace(replace({NAME_KEY_SQL.format('driver_name')}, ' ', '-'), '[^a-z0-9-]+', '', 'g') AS s FROM raw)""",
    ),
)
def slugify(spark, d):
    n = F.col("driver_name")
    return fx.raw_results(spark, d).select("result_id", text.slugify(n).alias("slug"), text.build_driver_id(n).alias("driver_id"), text.build_stage_id(F.col("rally_id"), F.col("stage_number")).alias("stage_id"))


@query("ascii_upper_name", with_ctes(fx.RAW, "SELECT result_id, translate(upper(trim(driver_name)), 'İĞÜŞÖÇ', 'IGUSOC') AS name FROM raw"))
def ascii_upper_name(spark, d):
    return fx.raw_results(spark, d).select("result_id", text.ascii_upper_name(F.col("driver_name")).alias("name"))


@query(
    "turkish_title",
    with_ctes(
        fx.RAW,
        """SELECT result_id, array_to_string(list_transform(list_filter(string_split(driver_name, ' '), lambda w: w <> ''),
           lambda w: concat(upper(translate(left(w, 1), 'iı', 'İI')), lower(translate(substr(w, 2), 'Iİ', 'ıi')))), ' ') AS name FROM raw""",
    ),
)
def turkish_title(spark, d):
    return fx.raw_results(spark, d).select("result_id", text.turkish_title(F.col("driver_name")).alias("name"))


@query(
    "normalize_class",
    with_ctes(
        fx.RAW,
        """SELECT DISTINCT car_class AS raw_class, CASE car_class WHEN 'R4' THEN 'Rally2' WHEN 'rally 2' THEN 'Rally2' WHEN ' Rally3 ' THEN 'Rally3' WHEN 'R2' THEN 'Rally4' WHEN 'S2000' THEN 'Rally2' WHEN 'Kategori 1' THEN 'K1'
           WHEN 'RALLY5' THEN 'Rally5' WHEN '' THEN 'Unknown' ELSE car_class END AS class FROM raw""",
    ),
)
def normalize_class(spark, d):
    return fx.raw_results(spark, d).select(F.col("car_class").alias("raw_class"), classes.normalize_class(F.col("car_class")).alias("class")).distinct()


@query("surface_from_name", with_ctes(fx.RAW, "SELECT DISTINCT rally_name, CASE WHEN rally_name LIKE '%Bodrum%' OR rally_name LIKE '%Marmaris%' OR rally_name LIKE '%Bursa%' OR rally_name LIKE '%Ege%' THEN 'asphalt' ELSE 'gravel' END AS surface FROM raw"))
def surface_from_name(spark, d):
    return fx.raw_results(spark, d).select("rally_name", classes.surface_from_name(F.col("rally_name")).alias("surface")).distinct()


@query("normalize_event_name", with_ctes(fx.RAW, "SELECT DISTINCT rally_name, concat(replace(lower(split_part(rally_name, ' Rallisi', 1)), 'gun', ''), ' rally') AS name FROM raw"))
def normalize_event_name(spark, d):
    return fx.raw_results(spark, d).select("rally_name", text.normalize_event_name(F.concat("rally_name", F.lit("_1. Gün.kml"))).alias("name")).distinct()


@query("similarity")
def similarity(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return rounded(p.join(nxt, "p_partkey").select("p_partkey", text.similarity(F.col("a"), F.col("b")).alias("similarity")))


@query(
    "stage_features",
    with_ctes(
        fx.TIMED,
        """SELECT result_id, CAST(surface = 'asphalt' AS INTEGER) AS surface_asphalt, CAST(surface = 'gravel' AS INTEGER) AS surface_gravel, CAST(stage_number % 4 = 0 AS INTEGER) AS is_night,
           round(pow(stage_length_km, 0.85), 6) AS stage_length_corrected, CAST(stage_length_km < 7 AS INTEGER) AS is_short_stage, CASE WHEN stage_length_km < 7 THEN 1.03::DOUBLE ELSE 1.0::DOUBLE END AS short_stage_penalty,
           CAST(stage_length_km > 0 AND stage_length_km <= 10 AS INTEGER) AS length_short, CAST(stage_length_km > 10 AND stage_length_km <= 20 AS INTEGER) AS length_medium,
           CAST(stage_length_km > 20 AND stage_length_km <= 30 AS INTEGER) AS length_long, CAST(stage_length_km > 30 AND stage_length_km <= 100 AS INTEGER) AS length_very_long FROM timed""",
    ),
)
def stage_features(spark, d):
    t = fx.timed_results(spark, d).select("result_id", "surface", "stage_length_km", F.when(F.col("stage_number") % 4 == 0, "night").otherwise("day").alias("day_or_night"))
    return rounded(features.stage_features(t).drop("surface", "stage_length_km", "day_or_night"))


@query(
    "class_features",
    with_ctes(fx.RAW, "SELECT result_id, CASE car_class WHEN 'R2' THEN 1 ELSE 0 END AS class_ordinal, CAST(car_class = 'R2' AS INTEGER) AS class_R2, CAST(car_class = 'N' AS INTEGER) AS class_N FROM raw"),
)
def class_features(spark, d):
    return features.class_features(fx.raw_results(spark, d).select("result_id", "car_class"), ["R2", "N"]).drop("car_class")


@query(
    "competition_features",
    with_ctes(
        fx.TIMED,
        """SELECT result_id, round((driver_id % 90) / stage_length_km, 6) AS gap_to_leader_per_km, 0.0::DOUBLE AS gap_to_class_leader_per_km, CAST(driver_id % 20 = 1 AS INTEGER) AS is_leading_overall,
           CAST(driver_id % 6 = 1 AS INTEGER) AS is_leading_class, CAST(driver_id % 6 <= 3 AS INTEGER) AS is_top3_class FROM timed""",
    ),
)
def competition_features(spark, d):
    i = F.col("driver_id")
    t = fx.timed_results(spark, d).select("result_id", "stage_length_km", (i % 90).cast("double").alias("gap_to_leader_seconds"), (i % 20).alias("overall_position_before"), (i % 6).alias("class_position_before"))
    out = features.competition_features(t)
    return rounded(out.select("result_id", "gap_to_leader_per_km", "gap_to_class_leader_per_km", "is_leading_overall", "is_leading_class", "is_top3_class"))


@query("interaction_features", with_ctes(fx.GEOMETRY, "SELECT stage_id, round(hairpin_density * 1.1, 6) AS hairpin_x_driver, round(total_ascent * 0.9, 6) AS climb_x_driver, round(p95_curvature * 1.2, 6) AS curvature_x_driver FROM geometry"))
def interaction_features(spark, d):
    g = fx.stage_geometry(spark, d).withColumns({"driver_hairpin_perf": F.lit(1.1), "driver_climb_perf": F.lit(0.9), "driver_curvature_sens": F.lit(1.2)})
    return rounded(features.interaction_features(g).select("stage_id", "hairpin_x_driver", "climb_x_driver", "curvature_x_driver"))


@query(
    "missing_if",
    """SELECT p_partkey, CASE WHEN p_size NOT IN (0, 1) THEN p_size END AS size, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS price, nullif(trim(CASE WHEN p_partkey % 4 = 0 THEN '  ' ELSE concat(' ', p_name) END), '') AS name FROM part""",
)
def missing_if(spark, d):
    p = fx.table(spark, d, "part")
    k = F.col("p_partkey")
    price = F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))).when(k % 3 == 1, "unknown").otherwise("n/a")
    name = F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name"))
    return p.select("p_partkey", text.missing_if(F.col("p_size"), 0, 1).alias("size"), text.to_number(price).alias("price"), text.clean_text(name).alias("name"))


@query(
    "geometry_hash",
    with_ctes(
        fx.GEOMETRY,
        "SELECT stage_id, sha1(concat_ws('|', stage_id, printf('%.4f', distance_km), printf('%.2f', total_ascent), printf('%.2f', total_descent), printf('%.6f', p95_curvature), CAST(hairpin_count AS VARCHAR), source_kml)) AS geometry_hash FROM geometry",
    ),
)
def geometry_hash(spark, d):
    from splitclock.operators.geometry import geometry_hash as digest

    g = fx.stage_geometry(spark, d).withColumns({"geometry_json": F.lit(None).cast("string"), "kml_file": F.lit(None).cast("string")})
    return g.select("stage_id", digest().alias("geometry_hash"))


STATE_SQL = """CASE WHEN distance_km > 3 AND total_ascent = 0 AND total_descent = 0 AND max_grade = 0 THEN 'missing' WHEN total_ascent <> 0 OR total_descent <> 0 OR max_grade <> 0 THEN 'available' ELSE 'missing' END AS elevation_status,
  CASE WHEN distance_km > 3 AND total_ascent = 0 AND total_descent = 0 AND max_grade = 0 THEN 'red_flag_missing_elevation' ELSE 'validated' END AS geometry_status"""


@query("geometry_quality", with_ctes(fx.GEOMETRY, f"SELECT *, CASE WHEN geometry_status = 'validated' THEN '2024-01-01T00:00:00' END AS validated_at FROM (SELECT stage_id, {STATE_SQL} FROM geometry)"))
def geometry_quality(spark, d):
    from splitclock.operators.geometry import geometry_quality as quality

    return quality(fx.stage_geometry(spark, d), "2024-01-01T00:00:00").select("stage_id", "elevation_status", "geometry_status", "validated_at")


@query(
    "quality_flags",
    with_ctes(
        fx.GEOMETRY,
        f"""SELECT stage_id, CASE WHEN geometry_status = 'validated' AND elevation_status <> 'missing' THEN ['geometry_trusted'] WHEN geometry_status IS NULL THEN ['baseline_only', 'geometry_missing']
            ELSE list_sort(['baseline_only', 'elevation_missing', geometry_status]) END AS flags FROM stage LEFT JOIN (SELECT stage_id, {STATE_SQL} FROM geometry) USING (stage_id)""",
    ),
)
def quality_flags(spark, d):
    from splitclock.operators.geometry import geometry_quality as quality

    g = quality(fx.stage_geometry(spark, d)).select("stage_id", "geometry_status", "elevation_status")
    s = fx.stages(spark, d).select("stage_id").join(g, "stage_id", "left")
    return s.select("stage_id", scoring.quality_flags(F.col("geometry_status"), F.col("elevation_status")).alias("flags"))


@query(
    "display_name_rank",
    with_ctes(
        fx.RAW,
        r"""SELECT name_key, arg_min(driver_name, (-n, len(regexp_replace(driver_name, '[^\p{Lu}]', '', 'g')), length(driver_name), driver_name)) AS display_name
            FROM (SELECT trim(driver_name) AS driver_name, lower(trim(driver_name)) AS name_key, count(*) AS n FROM raw GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def display_name_rank(spark, d):
    from splitclock.operators.master import display_name_rank as rank

    n = F.trim("driver_name")
    c = fx.raw_results(spark, d).groupBy(n.alias("driver_name"), F.lower(n).alias("name_key")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("name_key").agg(F.min(rank(F.col("driver_name"), F.col("n")))["n"].alias("display_name"))


@query("needs_manual_review", "SELECT p_brand, count(*) > 1 AND (max(length(p_name)) >= greatest(12, min(length(p_name)) * 1.7) OR count(DISTINCT len(string_split(p_name, ' '))) > 1) AS review FROM part GROUP BY 1")
def needs_manual_review(spark, d):
    from splitclock.operators.master import needs_manual_review as review

    p = fx.table(spark, d, "part")
    length = F.length("p_name")
    g = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("hi"), F.min(length).alias("lo"), F.countDistinct(F.size(F.split("p_name", " "))).alias("t"))
    return g.select("p_brand", review(F.col("n"), F.col("hi"), F.col("lo"), F.col("t")).alias("review"))


@query(
    "confidence_numeric",
    with_ctes(
        fx.STAGES,
        """SELECT stage_id, CASE lv WHEN 'HIGH' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 0.7::DOUBLE WHEN 'LOW' THEN 0.4::DOUBLE WHEN 'INSUFFICIENT' THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END AS numeric,
           CASE lv WHEN 'HIGH' THEN 0.9::DOUBLE WHEN 'MEDIUM' THEN 0.6::DOUBLE WHEN 'LOW' THEN 0.3::DOUBLE WHEN 'INSUFFICIENT' THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END AS weight
           FROM (SELECT stage_id, ['HIGH', 'MEDIUM', 'LOW', 'INSUFFICIENT', 'other'][stage_number % 5 + 1] AS lv FROM stage)""",
    ),
)
def confidence_numeric(spark, d):
    lv = F.element_at(F.array(*[F.lit(x) for x in ("HIGH", "MEDIUM", "LOW", "INSUFFICIENT", "other")]), (F.col("stage_number") % 5 + 1).cast("int"))
    return fx.stages(spark, d).select("stage_id", scoring.confidence_numeric(lv).alias("numeric"), scoring.confidence_weight(lv).alias("weight"))


@query(
    "summary_text",
    with_ctes(
        fx.RATED,
        """SELECT result_id, concat('D', driver_id, ' - ', stage_id, ': Tahmini ', printf('%d:%02d.%02d', cs // 6000, cs // 100 % 60, cs % 100), ' (', CASE WHEN tenth < 5 THEN 'sinif lideriyle benzer' ELSE printf('sinif liderinden %%%d.%d yavas', tenth // 10, tenth % 10) END,
           ') - Guven: ', CASE WHEN tenth < 100 THEN 'HIGH 🟢' ELSE 'LOW 🟠' END) AS summary
           FROM (SELECT *, CAST(round(time_seconds * 100) AS BIGINT) AS cs, (time_seconds - class_best_time) AS gap, CAST(floor(driver_id % 400) AS BIGINT) AS tenth FROM rated)""",
    ),
)
def summary_text(spark, d):
    tenth = F.col("driver_id") % 400
    level = F.when(tenth < 100, "HIGH").otherwise("LOW")
    exact = F.round(F.col("time_seconds") * 100) / 100
    # Ratios a little above whole tenths of a percent, so that no printed digit hangs on a rounding tie.
    ratio = 1 + (tenth + 0.02) / 1000
    name = F.concat(F.lit("D"), "driver_id")
    return fx.rated_results(spark, d).select("result_id", scoring.summary_text(name, F.col("stage_id"), times.format_minutes(exact), ratio, level).alias("summary"))


@query(
    "open_issues",
    with_ctes(fx.STAGES, "SELECT stage_id, list_filter(['high_error', 'actual_missing', 'baseline_only'], lambda x: NOT (stage_number % 2 = 0 AND x = 'high_error')) AS open FROM stage"),
)
def open_issues(spark, d):
    from splitclock.plans.quality import open_issues as still_open

    types = F.array(F.lit("high_error"), F.lit("actual_missing"), F.lit("baseline_only"))
    return fx.stages(spark, d).select("stage_id", still_open(types, F.when(F.col("stage_number") % 2 == 0, F.array(F.lit("high_error")))).alias("open"))


