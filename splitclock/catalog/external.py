"""Queries over files, pages, models and streams. Their inputs are written from the test tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitclock import fixtures as fx
from splitclock.catalog.history import FORM, KEYS
from splitclock.catalog.predictions import classed, live_requests
from splitclock.catalog.registry import query, rounded, with_ctes
from splitclock.operators import facts, history
from splitclock.operators.aggregates import importance_mean_abs as mean_abs
from splitclock.operators.aggregates import temporal_split
from splitclock.plans import features, ml, predict
from splitclock.session import removed_after, scratch_path, stored
from splitclock.sources import html, kml, tables
from splitclock.streaming import live

# ---- tables and documents --------------------------------------------------------------------------------------


@query("replace_table", with_ctes(fx.TIMED, "SELECT result_id, time_seconds FROM timed"))
def replace_table(spark, d):
    root = scratch_path(spark, "table")
    t = fx.timed_results(spark, d).select("result_id", "time_seconds")
    first = tables.replace_table(t.withColumn("time_seconds", F.lit(0.0)), root, "1")
    second = tables.replace_table(spark.read.parquet(first).drop("time_seconds").join(t, "result_id"), root, "2")
    return tables.read_results(spark, second)


@query("features_parquet", with_ctes(fx.TIMED, "SELECT result_id, CAST(surface = 'gravel' AS INTEGER) AS surface_gravel FROM timed"))
def features_parquet(spark, d):
    f = features.stage_features(fx.timed_results(spark, d)).select("result_id", "surface_gravel")
    return tables.features_parquet(f, scratch_path(spark, "features"))


@query("export_csv", with_ctes(fx.TIMED, "SELECT result_id, CAST(stage_number AS VARCHAR) AS stage_number FROM timed"))
def export_csv(spark, d):
    path = scratch_path(spark, "csv")
    tables.export_csv(fx.timed_results(spark, d).select("result_id", "stage_number"), path)
    return spark.read.option("header", True).csv(path)


@query("read_mapping_csv", with_ctes(fx.STAGES, "SELECT rally_id, concat(rally_id, '_ss', '_', stage_number) AS stage_id, CAST(2 - stage_number % 2 AS INTEGER) AS pass_number FROM stage"))
def read_mapping_csv(spark, d):
    path = scratch_path(spark, "mapping")
    n = F.col("stage_number")
    m = fx.stages(spark, d).select("rally_id", F.concat(F.lit("SS "), n).alias("stage_name"), F.concat("stage_id", F.lit(".kml")).alias("kml_file"), F.lit("base").alias("base_stage_name"), (2 - n % 2).alias("pass_number"))
    tables.export_csv(m, path)
    return tables.mapping_stage_id(tables.read_mapping_csv(spark, path)).select("rally_id", "stage_id", "pass_number")


#: Documents of twenty drivers in a file of requests, for each stage of the rally.
REQUEST_PARTS = 1000


@query("read_batch_request", with_ctes(fx.TIMED, "SELECT stage_id, CAST(driver_id AS VARCHAR) AS driver_id, car_class AS normalized_class FROM timed"))
def read_batch_request(spark, d):
    path = scratch_path(spark, "requests")
    t = fx.timed_results(spark, d)
    driver = F.struct(F.col("driver_id").cast("string").alias("driver_id"), F.lit("n").alias("driver_name"), F.col("car_class").alias("normalized_class"), F.col("surface"))
    # One document asks for at most a few drivers of a stage.
    docs = t.groupBy("rally_id", "stage_id", "stage_number", F.floor(F.col("driver_id") / 20).alias("part")).agg(F.collect_list(driver).alias("drivers"))
    # Files of a rally and of twenty thousand drivers at most, each an array of documents over many lines: a task parses one as a whole.
    file = F.concat_ws("-", "rally_id", F.floor(F.col("part") / REQUEST_PARTS))
    files = docs.groupBy(file.alias("file")).agg(F.to_json(F.collect_list(F.struct(*[c for c in docs.columns if c != "part"])), {"pretty": "true"}).alias("value"))
    files.write.partitionBy("file").text(path)
    return tables.read_batch_request(spark, path).select("stage_id", "driver_id", "normalized_class")


@query(
    "import_manual_sheet",
    with_ctes(
        fx.RAW,
        """SELECT concat(replace(lower(rally_name), ' ', '_'), '_ss', stage_number, '_', replace(lower(trim(driver_name)), ' ', '_')) AS result_id, round(CASE WHEN time_str <> 'DNF' THEN CAST(split_part(time_str, ':', 1) AS DOUBLE) * 60 + CAST(split_part(time_str, ':', 2) AS DOUBLE) END, 6) AS time_seconds, CAST(ev // 100 AS INTEGER) AS rally_year FROM raw""",
    ),
)
def import_manual_sheet(spark, d):
    raw = fx.raw_results(spark, d)
    sheet = raw.select(
        "rally_name", F.col("rally_date").cast("string").alias("rally_date"), F.concat(F.lit("SS"), "stage_number").alias("stage_name"), "stage_number", "stage_length_km", "surface", F.lit("day").alias("day_or_night"),
        F.trim("driver_name").alias("driver_name"), F.col("vehicle").alias("car_model"), "car_class", "time_str", "status", F.lit(1).alias("overall_position"), F.lit(1).alias("class_position"),
    )
    path = scratch_path(spark, "sheet")
    tables.export_csv(sheet, path)
    return rounded(tables.read_manual_sheet(spark, path).select("result_id", "time_seconds", "rally_year"))


def event_documents(spark, d):
    """Nested documents, a few drivers of one rally in each."""
    raw = fx.raw_results(spark, d).withColumn("person", F.element_at(F.split("result_id", "_"), -1).cast("bigint"))
    none = F.lit(None).cast("string")
    r = F.struct(
        none.alias("position"), "car_number", "driver_name", none.alias("nationality"), "car_class", none.alias("team"), F.col("vehicle").alias("car_model"), "time_str", none.alias("time_diff"), "status"
    )
    part = F.floor(F.col("person") / 20).alias("part")
    stages = raw.groupBy("rally_id", "rally_name", "stage_number", "stage_name", "stage_length_km", part).agg(F.collect_list(r).alias("results"))
    s = F.struct("stage_number", "stage_name", "stage_length_km", "results")
    return stages.groupBy("rally_id", "rally_name", "part").agg(F.collect_list(s).alias("stages")).select("rally_id", "rally_name", F.lit("gravel").alias("surface"), "stages")


@query("flatten_event", with_ctes(fx.RAW, "SELECT rally_id, rally_name, stage_number, stage_length_km, car_number, driver_name, time_str, status FROM raw"))
def flatten_event(spark, d):
    path = scratch_path(spark, "events")
    event_documents(spark, d).write.json(path)
    out = tables.flatten_event(tables.read_events(spark, path))
    return out.select("rally_id", "rally_name", "stage_number", "stage_length_km", "car_number", "driver_name", "time_str", "status")


@query("nest_event", with_ctes(fx.RAW, "SELECT rally_id, stage_number, CAST(0 AS INTEGER) AS part, count(*) AS result_count, round(min(time_seconds), 6) AS first_time FROM raw GROUP BY 1, 2"))
def nest_event(spark, d):
    docs = tables.nest_event(fx.raw_results(spark, d), fx.stage_geometry(spark, d).select("rally_id", "stage_number", "distance_km", "hairpin_count"))
    return rounded(docs.select("rally_id", "stage_number", "part", "result_count", F.col("results")[0]["time_seconds"].alias("first_time")))


@query("export_geometry_snapshot", with_ctes(fx.GEOMETRY, "SELECT stage_id, distance_km, source_kml AS kml_file FROM geometry"))
def export_geometry_snapshot(spark, d):
    path = tables.export_geometry_snapshot(fx.stage_geometry(spark, d).withColumnRenamed("source_kml", "kml_file"), scratch_path(spark, "snapshot"), "1")
    return tables.load_geometry_snapshot(spark, path).select("stage_id", "distance_km", "kml_file")


@query("snapshot_before_after", with_ctes(fx.GEOMETRY, "SELECT 'pre' AS state, count(*) AS rows FROM geometry WHERE stage_number <= 6 UNION ALL SELECT 'post', count(*) FROM geometry"))
def snapshot_before_after(spark, d):
    g = fx.stage_geometry(spark, d)
    pre, post = tables.snapshot_before_after(g.where("stage_number <= 6"), g, scratch_path(spark, "merge"), "run1")
    count = lambda path, state: spark.read.parquet(path).agg(F.lit(state).alias("state"), F.count(F.lit(1)).alias("rows"))
    return count(pre, "pre").unionByName(count(post, "post"))


# ---- pages and route files -------------------------------------------------------------------------------------


def _tag(name, *parts):
    return F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))


def _pages(spark, d, row, head, stage_title, timed=None):
    """Pages of one stage and at most twenty drivers."""
    raw = fx.raw_results(spark, d, timed).withColumn("person", F.element_at(F.split("result_id", "_"), -1).cast("bigint"))
    page = F.concat("rally_id", F.lit("_ss"), "stage_number", F.lit("_"), F.floor(F.col("person") / 20))
    g = raw.groupBy(page.alias("page_id"), "rally_name", "stage_name").agg(F.array_sort(F.collect_list(F.struct("person", row.alias("tr")))).alias("rows"))
    body = F.concat(F.lit(head), F.array_join(F.col("rows.tr"), ""))
    doc = F.concat(F.lit("<html><body>"), _tag("h1", F.col("rally_name")), _tag("div", stage_title), F.lit("<table><tr><td>x</td></tr></table>"), _tag("div", stage_title), _tag("table", body), F.lit("</body></html>"))
    return g.select("page_id", F.lit("u").alias("url"), doc.alias("html"))


def result_pages(spark, d, timed=None):
    row = _tag(
        "tr", F.lit("<td>1</td>"), _tag("td", F.col("car_number")), _tag("td", F.col("driver_name"), F.lit("<br>Second Name")), F.lit("<td>TR</td>"), _tag("td", F.col("car_class")),
        _tag("td", F.lit("Team A<br>"), F.col("vehicle")), _tag("td", F.col("time_str"), F.lit("<br>90 km/h")), F.lit("<td>+1.0</td>"),
    )
    head = "<tr><th>Sıra</th><th>No</th><th>Pilot</th><th>U</th><th>S</th><th>O</th><th>T</th></tr><tr><td>9</td><td>SR 5</td><td>a</td><td>b</td><td>c</td><td>d</td><td>1:00.0</td></tr>"
    return _pages(spark, d, row, head, F.col("stage_name"), timed)


@query(
    "html_results_rows",
    with_ctes(
        fx.RAW,
        """SELECT concat(rally_id, '_ss', stage_number, '_', person // 20) AS page_id, rally_name AS title, stage_number, CAST(stage_length_km AS INTEGER) + 0.5::DOUBLE AS stage_length_km, car_number, trim(driver_name) AS driver_name, trim(car_class) AS car_class,
           vehicle AS car_model, time_str, CASE WHEN time_str = 'DNF' THEN 'DNF' ELSE 'OK' END AS status FROM raw""",
    ),
)
def html_results_rows(spark, d):
    out = html.html_results_rows(result_pages(spark, d))
    return out.select("page_id", "title", "stage_number", "stage_length_km", "car_number", "driver_name", "car_class", "car_model", "time_str", "status")


@query(
    "html_results_rows_linked",
    with_ctes(
        fx.RAW,
        """SELECT concat(rally_id, '_ss', stage_number, '_', person // 20) AS page_id, stage_number, 12.5::DOUBLE AS stage_length_km, trim(driver_name) AS driver_name, vehicle AS car_model, CASE WHEN time_str = 'DNF' THEN 'DNF' ELSE 'FINISHED' END AS status FROM raw""",
    ),
)
def html_results_rows_linked(spark, d):
    row = _tag("tr", F.lit("<td>1.</td>"), _tag("td", F.lit("<b>#7</b> "), _tag("a", F.col("driver_name"))), _tag("td", F.col("vehicle")), _tag("td", F.col("car_class")), _tag("td", F.col("time_str")))
    pages = _pages(spark, d, row, "<tr><td>pos</td><td>x</td><td>y</td><td>z</td><td>t</td></tr>", F.concat(F.lit("SS"), F.regexp_extract("stage_name", r"ÖE(\d+)", 1), F.lit(" - Name - 12.5 km")))
    return html.html_results_rows_linked(pages).select("page_id", "stage_number", "stage_length_km", "driver_name", "car_model", "status")


@query(
    "html_startlist_rows",
    with_ctes(fx.RAW, "SELECT concat(rally_id, '_ss', stage_number, '_', person // 20) AS page_id, CAST(car_number AS INTEGER) AS car_number, trim(driver_name) AS driver_name, 'Second Name' AS co_driver_name, trim(car_class) AS car_class, vehicle FROM raw QUALIFY count(*) OVER (PARTITION BY rally_id, stage_number, person // 20) >= 2"),
)
def html_startlist_rows(spark, d):
    row = _tag("tr", F.lit("<td>1</td>"), _tag("td", F.lit("#"), F.col("car_number")), F.lit("<td>Team</td>"), _tag("td", F.col("driver_name")), F.lit("<td>Second Name</td><td>TR</td>"), _tag("td", F.col("vehicle")), _tag("td", F.col("car_class")))
    head = "<tr><th>Sıra</th><th>No</th><th>Yarışmacı</th><th>Pilot</th><th>Co-Pilot</th><th>Uyruk</th><th>Otomobil</th><th>S/K</th></tr>"
    pages = _pages(spark, d, row, head, F.lit("Start List"))
    return html.html_startlist_rows(pages).select("page_id", "car_number", "driver_name", "co_driver_name", "car_class", "vehicle")


@query("ingest_stats", with_ctes(fx.RAW, "SELECT count(DISTINCT concat(rally_id, '_', stage_number, '_', person // 20)) AS total_checked, count(DISTINCT concat(rally_id, '_', stage_number, '_', person // 20)) AS rally_found, 0::BIGINT AS skipped, 0::BIGINT AS error, count(*) AS rows FROM raw"))
def ingest_stats(spark, d):
    from splitclock.functions.classes import is_event_category
    from splitclock.operators.aggregates import ingest_stats as stats

    pages = result_pages(spark, d, stored(fx.timed_results(spark, d)))
    found = html.html_results_rows(pages).groupBy("page_id").agg(F.count(F.lit(1)).alias("rows_found"), F.max("title").alias("title"))
    return stats(pages.select("page_id").join(found, "page_id", "left").withColumn("is_event", is_event_category(F.col("title"))))


def route_files(spark, d):
    """Route documents of at most a hundred points each."""
    p = fx.route_points(spark, d).withColumn("part", F.floor((F.col("seq") - 1) / 100))
    token = F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string"), F.col("alt").cast("string"))
    g = p.groupBy("route_id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", token.alias("t")))).alias("pts"))
    number = F.col("route_id") % 10 + 1
    doc = F.concat(
        F.lit('<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>Etap '), number, F.lit("</name><ExtendedData><Data name=\"part\"><value>"), F.col("part"),
        F.lit("</value></Data></ExtendedData><LineString><coordinates>bad,token "), F.array_join(F.col("pts.t"), " "), F.lit("</coordinates></LineString></Placemark></Document></kml>"),
    )
    return g.select(F.concat(F.lit("r"), "route_id", F.lit("_"), "part", F.lit(".kml")).alias("path"), F.encode(doc, "utf-8").alias("content"), "route_id", "part")


@query("kml_points", with_ctes(fx.POINTS, "SELECT concat('r', route_id, '_', (seq - 1) // 100, '.kml') AS path, concat('Etap ', route_id % 10 + 1) AS name, (seq - 1) % 100 + 1 AS seq, round(lat, 9) AS lat, round(lon, 9) AS lon, alt, CAST((seq - 1) // 100 AS VARCHAR) AS part FROM pt"))
def kml_points(spark, d):
    out = kml.kml_points(route_files(spark, d))
    return rounded(out.select("path", "name", "seq", "lat", "lon", "alt", F.col("properties")["part"].alias("part")), 9)


@query("file_inventory", "SELECT count(DISTINCT user_id) AS files, count(DISTINCT user_id) AS filled FROM events")
def file_inventory(spark, d):
    """Routes written as one text file each, then listed without reading them."""
    path = scratch_path(spark, "routes")
    kml.write_texts(route_files(spark, d).select("route_id", F.decode("content", "utf-8").alias("value")), path)
    listed = kml.file_inventory(spark, path, r"\.txt$")
    return listed.agg(F.count(F.lit(1)).alias("files"), F.count_if((F.col("size_kb") > 0) & F.col("modified").isNotNull()).alias("filled"))


@query("processed_file_log", "SELECT count(DISTINCT user_id) AS logged, count(DISTINCT user_id) FILTER (WHERE user_id % 3 = 0) AS left_over FROM events")
def processed_file_log(spark, d):
    """Two runs over the same folder: the first does two files in three, the second finds the others."""
    path = scratch_path(spark, "routes")
    kml.write_texts(route_files(spark, d).select("route_id", F.decode("content", "utf-8").alias("value")), path)
    listed = kml.file_inventory(spark, path, r"\.txt$").drop("name")
    third = F.regexp_extract("path", r"route_id=(\d+)", 1).cast("long") % 3 == 0
    none = spark.createDataFrame([], "path string, size_kb double, modified date, status string")
    log = stored(kml.log_processed(none, kml.unprocessed_files(listed, none).where(~third)))
    rest = stored(kml.unprocessed_files(listed, log))
    log = kml.log_processed(log, rest)
    return log.agg(F.count_distinct("path").alias("logged")).withColumn("left_over", rest.agg(F.count(F.lit(1))).scalar())


@query("simplify_rdp")
def simplify_rdp(spark, d):
    from splitclock.operators.simplify import simplify_rdp as simplify

    return rounded(simplify(fx.route_points(spark, d), 5.0))


@query("process_corpus")
def process_corpus(spark, d):
    from splitclock.plans.corpus import process_corpus as process
    from splitclock.operators.series import with_position
    from splitclock.schemas import STAGE_GEOMETRY

    s = fx.stages(spark, d).withColumn("stage_name", F.concat(F.lit("Etap "), "stage_number"))
    rallies = with_position(s.select("rally_id", "ev").distinct(), [], ["ev"], ["ev"], "place")
    files = route_files(spark, d).withColumn("place", F.col("route_id") % 83 + 1).join(rallies, "place").select("path", "content", "rally_id")
    out = process(files, s, spark.createDataFrame([], STAGE_GEOMETRY), "2024-01-01T00:00:00")
    return out.files.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("stages_processed").alias("stages"))


# ---- models ----------------------------------------------------------------------------------------------------

MODEL_FEATURES = features.STAGE_FEATURES + features.DRIVER_FEATURES + ["momentum_factor", "baseline_ratio"] + features.CATEGORICAL
_trained: dict = {}


def training_rows(spark, d):
    """The rows of the correction model; what is written on the way to them is removed."""

    def work():
        timed = stored(fx.timed_results(spark, d))
        rows = features.training_set_trainer(classed(spark, d, timed), stored(fx.stage_geometry(spark, d, timed))).withColumn("elevation_gain", F.lit(0.0))
        rows = ml.correction_rows(rows, MODEL_FEATURES)
        return rows, [rows]

    return removed_after(spark, work)


def correction_model(spark, d):
    """The correction model of a table folder; trained once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _trained:
        _trained[key] = ml.train_correction_model(training_rows(spark, d), MODEL_FEATURES)
    return _trained[key]


@query("train_correction_model")
def train_correction_model(spark, d):
    return correction_model(spark, d)[1]


@query("apply_correction")
def apply_correction(spark, d):
    model, _, held = correction_model(spark, d)
    return ml.apply_correction(model, held.drop("prediction")).select("result_id", "geometric_correction", "geometric_mode")


@query("model_importance")
def model_importance(spark, d):
    return ml.model_importance(spark, correction_model(spark, d)[0])


@query("top_importance")
def top_importance(spark, d):
    return ml.top_importance(ml.model_importance(spark, correction_model(spark, d)[0]))


@query("permutation_importance")
def permutation_importance(spark, d):
    model, _, held = correction_model(spark, d)
    return ml.permutation_importance(model, held.drop("prediction"), MODEL_FEATURES, "correction_factor")


@query("attribution")
def attribution(spark, d):
    model, _, held = correction_model(spark, d)
    return ml.attribution(model, held.drop("prediction"), MODEL_FEATURES)


@query("top_contributions")
def top_contributions(spark, d):
    model, _, held = correction_model(spark, d)
    return ml.top_contributions(ml.attribution(model, held.drop("prediction"), MODEL_FEATURES))


@query("importance_mean_abs")
def importance_mean_abs(spark, d):
    model, _, held = correction_model(spark, d)
    return mean_abs(ml.attribution(model, held.drop("prediction"), MODEL_FEATURES))


@query("save_load_model")
def save_load_model(spark, d):
    model, metrics, held = correction_model(spark, d)
    root = scratch_path(spark, "model")
    ml.save_model(model, root, "v1", metrics)
    again = ml.load_model(spark, root)
    return again.transform(held.drop("prediction")).select("result_id", "prediction")


@query(
    "model_invariants",
    """SELECT * FROM (VALUES ('attributions are own minus replaced', true), ('corrections stay within the clip', true), ('fallback exactly without hairpins', true), ('importances add up to one', true), ('metrics are of the held-out rows', true), ('reloaded predictions are equal', true)) AS t(fact, holds)""",
)
def model_invariants(spark, d):
    """What must hold for any trained correction model, whatever it has learned."""
    model, metrics, held = correction_model(spark, d)
    rows = held.drop("prediction")
    root = scratch_path(spark, "model")
    ml.save_model(model, root, "v1", metrics)
    again = ml.load_model(spark, root).transform(rows).select("result_id", F.col("prediction").alias("again"))
    applied = ml.apply_correction(model, rows)
    density, c = F.coalesce("hairpin_density", F.lit(0.0)), F.col("geometric_correction")
    parts = ml.attribution(model, rows, MODEL_FEATURES)
    shares = parts.groupBy("result_id").agg(F.sum("share_pct").alias("s"), F.sum(F.abs("contribution")).alias("a"))
    mae = held.agg(F.avg(F.abs(F.col("correction_factor") - F.col("prediction"))).alias("mae"), F.count(F.lit(1)).alias("n"))
    facts_ = {
        "importances add up to one": ml.model_importance(spark, model).agg((F.abs(F.sum("importance") - 1) < 1e-9) & (F.min("importance") >= 0)),
        "corrections stay within the clip": applied.agg((F.min(c) >= 0.85) & (F.max(c) <= 1.15)),
        "fallback exactly without hairpins": applied.agg(F.min(((F.col("geometric_mode") == "fallback") == (density <= 0)) & ((density > 0) | (c == 1.0)))),
        "reloaded predictions are equal": held.join(again, "result_id").agg(F.min(F.col("prediction") == F.col("again"))),
        "attributions are own minus replaced": shares.agg(F.min((F.abs(F.col("s") - 100) < 1e-6) | (F.col("a") == 0))),
        "metrics are of the held-out rows": metrics.agg(F.min((F.abs(F.col("mae") - mae.select("mae").scalar()) < 1e-9) & (F.col("n") == mae.select("n").scalar()))),
    }
    out = None
    for name, df in facts_.items():
        one = df.toDF("holds").select(F.lit(name).alias("fact"), "holds")
        out = one if out is None else out.unionByName(one)
    return out


@query("train_ratio_model")
def train_ratio_model(spark, d):
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    chosen = []

    def work():
        matrix = temporal_split(features.v1_feature_matrix(fx.timed_results(spark, d).drop("ev"), names))
        chosen.extend(features.numeric_feature_select(matrix))
        rows = ml.ratio_rows(matrix, chosen)
        return rows, [rows]

    return ml.train_ratio_model(removed_after(spark, work), chosen)[1]


# ---- streams ---------------------------------------------------------------------------------------------------


#: Lines of the input for a file of the feed.
FEED_ROWS = 200_000


def feed(spark, d, twice=False, batches=None):
    """Results written as files and read back as a stream, in about ``batches`` micro-batches of three files or more. The files are
    as many as the results need, so that none is a large part of them."""
    path = scratch_path(spark, "feed")
    t = fx.timed_results(spark, d).select("result_id", "rally_id", "stage_id", "stage_number", "driver_id", "car_class", "surface", "stage_length_km", "time_seconds", F.col("rally_date").cast("timestamp").alias("sent_at"))
    t.repartition(max(4, fx.table(spark, d, "lineitem").count() // FEED_ROWS), "stage_number", "result_id").write.parquet(path)
    if twice:
        spark.read.schema(t.schema).parquet(path).write.mode("append").parquet(path)
    per_trigger = max(3, len(spark.read.schema(t.schema).parquet(path).inputFiles()) // batches) if batches else None
    return live.stream_results(spark, path, t.schema, "parquet", per_trigger), t.schema


def _drain(spark, rows, mode):
    """Run a stream to its end into a table in the shared folder and read that."""
    path = scratch_path(spark, "drained")
    if mode == "append":
        q = rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(rows.schema).parquet(f"{path}/rows")

    def handle(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    q = rows.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/rows")


@query("stream_results", with_ctes(fx.TIMED, "SELECT result_id, time_seconds FROM timed"))
def stream_results(spark, d):
    rows, _ = feed(spark, d)
    return _drain(spark, rows, "append").select("result_id", "time_seconds")


@query("stream_dedup", with_ctes(fx.TIMED, "SELECT result_id FROM timed"))
def stream_dedup(spark, d):
    # Every result is sent twice, in micro-batches of files that come in no order of time.
    rows, _ = feed(spark, d, twice=True, batches=4)
    path = scratch_path(spark, "first")
    live.stream_dedup(rows, f"{path}/rows", f"{path}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows").select("result_id")


@query("stream_class_best", with_ctes(fx.TIMED, "SELECT stage_id, car_class, min(time_seconds) AS class_best_time, count(*) AS finisher_count FROM timed GROUP BY 1, 2"))
def stream_class_best(spark, d):
    rows, _ = feed(spark, d)
    updates = _drain(spark, live.stream_class_best(rows), "update")
    newest = updates.groupBy(*KEYS).agg(F.max_by(F.struct("class_best_time", "finisher_count"), "batch").alias("r"))
    return newest.select(*KEYS, "r.*")


@query(
    "stream_momentum",
    with_ctes(
        FORM,
        "SELECT driver_id, rally_id, round(rally_avg, 6) AS rally_avg, n AS stages_analyzed, round((baseline_ratio - rally_avg) / baseline_ratio, 6) AS momentum FROM (SELECT driver_id, rally_id, avg(ratio_to_class_best) AS rally_avg, count(*) AS n FROM rated GROUP BY 1, 2) JOIN base_ratio USING (driver_id)",
    ),
)
def stream_momentum(spark, d):
    # A third of the drivers are first sent with a slower time. The micro-batches come in no order: a final time may come first.
    path = scratch_path(spark, "momentum")
    t = fx.timed_results(spark, d).select("result_id", "rally_id", "stage_id", "stage_number", "driver_id", "car_class", "time_seconds", F.lit(1).alias("revision"))
    provisional = t.where(F.col("driver_id") % 3 == 0).withColumns({"time_seconds": F.col("time_seconds") * 1.25, "revision": F.lit(0)})
    t.unionByName(provisional).repartition(10, F.xxhash64("result_id", "revision")).write.parquet(f"{path}/feed")
    rows = live.stream_results(spark, f"{path}/feed", t.schema, "parquet", 2)
    base = history.recency_weighted_baseline(fx.rated_results(spark, d))
    live.stream_momentum(rows, stored(base), path, f"{path}/state", "revision").awaitTermination()
    out = spark.read.parquet(f"{path}/form").drop("batch")
    newest = out.groupBy("driver_id", "rally_id").agg(F.max_by(F.struct("rally_avg", "stages_analyzed", "momentum"), "batch_id").alias("f"))
    return rounded(newest.select("driver_id", "rally_id", "f.*"))


@query(
    "stream_compare_predict",
    with_ctes(
        fx.TIMED,
        """SELECT 'matched' AS comparison_status, count(*) AS predictions, count(DISTINCT t.driver_id) AS drivers, round(sum(t.time_seconds), 3) AS actual_seconds FROM timed t
           JOIN (SELECT DISTINCT rally_id, stage_number + 1 AS stage_number FROM timed) before USING (rally_id, stage_number)""",
    ),
)
def stream_compare_predict(spark, d):
    path = scratch_path(spark, "loop")
    timed = stored(fx.timed_results(spark, d))
    t = timed.select("result_id", "rally_id", "stage_id", "stage_number", "driver_id", "car_class", "surface", "stage_length_km", "time_seconds")
    asked = stored(live_requests(spark, d, timed))
    before = predict.live_history(facts.ratio_to_class_best(classed(spark, d, timed).drop("ratio_to_class_best", "class_best_time"), write=True))
    # The stages arrive one after the other; the query runs after each arrival and goes on from its checkpoint.
    for n in range(1, 11):
        t.where(F.col("stage_number") == n).write.mode("append").parquet(f"{path}/feed")
        rows = live.stream_results(spark, f"{path}/feed", t.schema, "parquet")
        live.stream_compare_predict(rows, asked, before, path, f"{path}/state").awaitTermination()
    closed = live.newest_log(spark, path).groupBy("comparison_status")
    return rounded(closed.agg(F.count(F.lit(1)).alias("predictions"), F.countDistinct("driver_id").alias("drivers"), F.sum("actual_time").alias("actual_seconds")), 3)
