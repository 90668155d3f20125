"""Pages, route files and tables."""

import io
import zipfile

from pyspark.sql import functions as F

from splitclock.schemas import STAGE_RESULTS, align, require_columns
from splitclock.sources import html, kml, tables

PAGE = """<html><head><title>t</title></head><body><h1>Ege Rallisi 2024</h1>
<table><tr><td>menu</td></tr></table><div>ÖE3 - Dağ - 8,25km</div>
<table><tr><th>Sıra</th><th>No</th><th>Pilot</th><th>U</th><th>S</th><th>A</th><th>T</th></tr>
<tr><td>1</td><td>7</td><td><b>Ada T</b><br>Eş P</td><td>TR</td><td>R4</td><td>Takım<br>Fabia</td><td>5:23.4<br>90 km/h</td><td>+0.0</td></tr>
<tr><td>2</td><td>SR 8</td><td>x</td><td>TR</td><td>R4</td><td>y</td><td>5:30.0</td></tr>
<tr><td>3</td><td>9</td><td>Can S</td><td>TR</td><td>R2</td><td>y</td><td>DNF</td></tr>
<tr><td>4</td><td>10</td><td>Ece S</td><td>TR</td><td>R2</td><td>y</td><td></td></tr></table></body></html>"""


def test_results_page(spark):
    pages = spark.createDataFrame([("p", "u", PAGE), ("empty", "u", "<p>nothing"), ("none", "u", None)], "page_id STRING, url STRING, html STRING")
    got = [(r["title"], r["stage_number"], r["stage_length_km"], r["car_number"], r["driver_name"], r["team"], r["car_model"], r["time_str"], r["status"]) for r in html.html_results_rows(pages).orderBy("row").collect()]
    head = ("Ege Rallisi 2024", 3, 8.25)
    assert got == [(*head, "7", "Ada T", "Takım", "Fabia", "5:23.4", "OK"), (*head, "9", "Can S", "y", "", "DNF", "DNF"), (*head, "10", "Ece S", "y", "", "", "DNS")]


def test_start_list_without_header(spark):
    rows = "".join(f"<tr><td>{i}</td><td>#{i}0</td><td>T</td><td>Ad {i}</td><td>Co {i}</td><td>TR</td><td>Fabia</td><td>R4</td></tr>" for i in (1, 2, 3))
    pages = spark.createDataFrame([("p", f"<h2>Ege - Start Listesi</h2><table>{rows}</table>")], "page_id STRING, html STRING")
    got = html.html_startlist_rows(pages).orderBy("row").collect()
    assert [(r["title"], r["car_number"], r["driver_name"], r["normalized_class"]) for r in got] == [("Ege", i * 10, f"Ad {i}", "Rally2") for i in (1, 2, 3)]


def test_end_date(spark):
    df = spark.createDataFrame([("5. 4. – 7. 4. 2025, asphalt",), ("none",)], "t STRING")
    assert [str(r[0]) for r in df.select(html.event_end_date(F.col("t"))).collect()] == ["2025-04-07", "None"]


DOC = """<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>D</name>
<Placemark><name> SS1 </name><ExtendedData><Data name="km"><value>8</value></Data></ExtendedData><LineString><coordinates>28,38,100 x,y 28.1,38.1</coordinates></LineString></Placemark>
<Placemark><name>Pin</name></Placemark></Document></kml>"""


def test_texts_are_one_file_a_key_without_a_folder_each(spark, tmp_path):
    rows = [(k, f"{k} ş{i}") for k in range(200) for i in range(k % 3 + 1)] + [(None, None), (None, None), (7, "")]
    kml.write_texts(spark.createDataFrame(rows, "route_id BIGINT, value STRING"), str(tmp_path / "routes"))
    found = {f.name: sorted(f.read_text("utf-8").splitlines()) for f in (tmp_path / "routes").rglob("*") if f.is_file()}
    want = {f"route_id={k}.txt": sorted(v for j, v in rows if j == k) for k in range(200)}
    assert found == want | {"route_id=__HIVE_DEFAULT_PARTITION__.txt": ["", ""]}
    assert sum(f.is_dir() for f in (tmp_path / "routes").rglob("*")) <= kml.FOLDERS
    listed = kml.file_inventory(spark, str(tmp_path / "routes"), r"\.txt$")
    assert {r["name"] for r in listed.collect()} == set(found)


def test_texts_go_to_other_stores_by_the_writer(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.texts.link./in", f"file://{tmp_path}/in")
    kml.write_texts(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "route_id BIGINT, value STRING"), "viewfs://texts/in/routes")
    listed = kml.file_inventory(spark, "viewfs://texts/in/routes", r"\.txt$").collect()
    assert sorted(r["path"].split("/")[-2] for r in listed) == ["route_id=1", "route_id=2"]


def test_route_files(spark):
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("doc.kml", DOC)
    loose = "<kml><coordinates>1,2</coordinates></kml>"
    files = spark.createDataFrame([("a/x.kml", DOC.encode()), ("b.kmz", zipped.getvalue()), ("bad.kmz", b"no zip"), ("bad.kml", b"<kml"), ("c.kml", loose.encode())], "path STRING, content BINARY")
    got = sorted((r["path"], r["name"], r["seq"], r["lat"], r["lon"], r["alt"], r["properties"].get("km")) for r in kml.kml_points(files).collect())
    two = [("SS1", 1, 38.0, 28.0, 100.0, "8"), ("SS1", 2, 38.1, 28.1, 0.0, "8")]
    assert got == [("a/x.kml", *t) for t in two] + [("b.kmz", *t) for t in two] + [("c.kml", "c", 1, 2.0, 1.0, 0.0, None)]


def test_align_and_required(spark):
    df = spark.createDataFrame([("r", "12", "x")], "result_id STRING, stage_number STRING, time_seconds STRING")
    out = align(df, STAGE_RESULTS)
    r = out.first()
    assert (r["stage_number"], r["time_seconds"], r["surface"]) == (12, None, None) and out.schema == STAGE_RESULTS
    try:
        require_columns(df, ["result_id", "nope"])
    except ValueError as e:
        assert "nope" in str(e)
    else:
        raise AssertionError


def test_batch_request_file(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text('{"rally_id": "1", "stage_id": "1_ss2", "stage_number": 2,\n "drivers": [{"driver_id": "a", "surface": "snow"}, {"driver_id": "b"}], "surface": "gravel"}')
    got = sorted((r["driver_id"], r["surface"], r["stage_number"]) for r in tables.read_batch_request(spark, str(path)).collect())
    assert got == [("a", "snow", 2), ("b", "gravel", 2)]


def test_empty_stages_are_kept(spark):
    doc = spark.createDataFrame([("1", "R", "gravel", [(1, "SS1", 5.0, [])])], "rally_id STRING, rally_name STRING, surface STRING, stages ARRAY<STRUCT<stage_number: INT, stage_name: STRING, stage_length_km: DOUBLE, results: ARRAY<STRUCT<driver_name: STRING>>>>")
    assert tables.flatten_event(doc).count() == 0 and tables.flatten_event(doc, keep_empty=True).count() == 1
