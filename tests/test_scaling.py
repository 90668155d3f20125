"""What keeps files, parts, shuffles and writes bounded as the tables grow."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from splitclock import fixtures as fx
from splitclock.catalog import external
from splitclock.operators import merge as mg
from splitclock.operators import series
from splitclock.plans import features, ml, predict
from splitclock.schemas import STAGE_RESULTS
from splitclock.session import shared_dir, stored
from splitclock.sources import html


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Sixty drivers on ten stages of one month."""
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, "BUILDING") for i in range(60)], "c_custkey long, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(i, i) for i in range(60)], "o_orderkey long, o_custkey long").write.parquet(f"{d}/orders.parquet")
    day = datetime.datetime(2020, 5, 2)
    rows = [(i, s, float(100 + i * 7 + s), 3.0, day) for i in range(60) for s in range(10)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate timestamp").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    return d


def test_a_file_of_requests_has_a_bounded_number_of_drivers(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(external, "REQUEST_PARTS", 1)
    monkeypatch.setattr(external, "scratch_path", lambda spark, name: str(tmp_path / name))
    assert external.read_batch_request(spark, tables).distinct().count() == 600
    assert len(list((tmp_path / "requests").glob("file=*"))) == 3


def test_the_feed_comes_in_more_files_when_it_grows(spark, tables, monkeypatch):
    monkeypatch.setattr(external, "FEED_ROWS", 20)
    seen = []
    monkeypatch.setattr(external.live, "stream_results", lambda spark, path, *a: seen.append((len(spark.read.parquet(path).inputFiles()), a[-1])))
    external.feed(spark, tables, twice=True, batches=4)
    files, per_trigger = seen[0]
    assert files > 30 and per_trigger == files // 4


def test_plain_pages_do_not_need_the_parser(monkeypatch):
    page = '<html><h1>R</h1><table class="a b"><TR><td>1</td><td>a<br/>b &amp; c</td><td><a href="x">n</a></td></TR></table>t</html>'
    odd = [page + "<!-- c -->", page + "<script>if (a<b) 1</script>", page + " a & b", page.replace("<td>", "<td <", 1), "a < b" + page, ""]

    def parsed(p):
        t = html._Tables()
        t.feed(p)
        t.close()
        return t.tables, t.titles, t._before

    want = {p: parsed(p) for p in [page, *odd]}
    for p in odd:
        t = html._read(p)
        assert (t.tables, t.titles, t._before) == want[p]

    def refuse(self, data):
        raise AssertionError("parsed")

    monkeypatch.setattr(html._Tables, "feed", refuse)
    t = html._read(page)
    assert (t.tables, t.titles, t._before) == want[page]


def test_what_was_stored_is_not_written_again(spark):
    one = stored(spark.range(3))
    assert stored(one) is one
    assert stored(one.where("id > 0")) is not one


def test_form_is_of_earlier_stages_of_the_rally(spark):
    results = spark.createDataFrame([(1, "a", 1, 10.0, 1.0), (1, "a", 2, 10.0, 1.5), (1, "a", 2, 10.0, 2.0), (1, "b", 1, 10.0, 9.0), (1, "a", None, 10.0, 7.0)], "driver_id long, rally_id string, stage_number int, time_seconds double, ratio_to_class_best double")
    asked = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "a", 3), (1, "a", None), (2, "a", 3), (None, "a", 3)], "driver_id long, rally_id string, stage_number int")
    out = predict.before_stage_form(asked, results)
    found = {(r["driver_id"], r["stage_number"]): (r["rally_avg"], r["stages_analyzed"]) for r in out.collect()}
    assert found == {(1, 1): (None, 0), (1, 2): (1.0, 1), (1, 3): (1.5, 3), (1, None): (None, 0), (2, 3): (None, 0), (None, 3): (None, 0)}


def test_the_labelled_batch_is_written_without_its_texts(spark, monkeypatch):
    written = []
    monkeypatch.setattr(mg, "stored", lambda df: (written.append(df.columns), stored(df))[1])
    empty = spark.createDataFrame([], STAGE_RESULTS)
    rows = spark.createDataFrame([("x", "r", 1, "A B", 10.0, 1), ("x", "r", 1, "A B", 11.0, 2)], "result_id string, rally_id string, stage_number int, driver_name string, time_seconds double, seq int")
    m = mg.merge_results(empty, rows, "run", recompute=False)
    assert sorted(r["outcome"] for r in m.outcomes.collect()) == ["conflict", "insert"]
    conflict = m.conflicts.first()
    assert [x["field"] for x in conflict["diff"]] == ["time_seconds"] and '"time_seconds":10.0' in conflict["master_payload"]
    assert written and not any("incoming_payload" in columns for columns in written)


def test_boosting_has_no_more_parts_than_cores_and_attribution_no_join(spark):
    rows = spark.range(400).repartition(50).select(F.col("id").alias("result_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    rows = rows.withColumn("y", F.col("a") * 2 + F.col("b"))
    parts = ml._for_boosting(rows)
    assert parts.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    model = ml.boosted_pipeline(["a", "b"], "y", iterations=2, depth=3).fit(parts)
    out = ml.attribution(model, rows.drop("y"), ["a", "b"])
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    mean = rows.agg(F.avg("a").alias("a"), F.avg("b").alias("b")).first()
    own = {r["result_id"]: r["prediction"] for r in model.transform(rows).collect()}
    found = out.collect()
    for f in ("a", "b"):
        moved = {r["result_id"]: r["prediction"] for r in model.transform(rows.withColumn(f, F.lit(mean[f]))).collect()}
        assert {r["result_id"]: round(r["contribution"], 9) for r in found if r["feature"] == f} == {k: round(own[k] - moved[k], 9) for k in own}
    shares = {}
    for r in found:
        shares[r["result_id"]] = shares.get(r["result_id"], 0) + r["share_pct"]
    assert len(found) == 800 and all(s == 0 or abs(s - 100) < 1e-9 for s in shares.values())


def test_written_results_give_the_same_leaders(spark, tables):
    timed = stored(fx.timed_results(spark, tables))
    key = lambda df: sorted((r["result_id"], r["class_best_time"], r["ratio_to_class_best"]) for r in df.collect())
    assert key(fx.rated_results(spark, tables, timed)) == key(fx.rated_results(spark, tables))


def test_percentiles_send_no_rows_through_the_driver(spark, monkeypatch):
    """Many rows of few values are small files: the planner would send them, not the wanted buckets, to all tasks."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    rows = stored(spark.range(200_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 5).cast("double").alias("v")))
    monkeypatch.setattr(series, "stored", kept)
    out = series.exact_quantiles(rows, ["k"], "v", {"p": 0.5})
    assert {r.k: r.p for r in out.collect()} == {0: 2.0, 1: 2.0, 2: 2.0}
    joins = [line for p in plans for line in p.splitlines() if "Join" in line]
    assert joins and all("BuildRight" in line for line in joins)


def test_series_steps_of_a_training_set_walk_narrow_rows(spark, tables, monkeypatch):
    timed = stored(fx.timed_results(spark, tables)).withColumns({"normalized_class": F.col("car_class"), "wide": F.repeat(F.lit("x"), 500)})
    geometry = stored(fx.stage_geometry(spark, tables))
    written = []
    monkeypatch.setattr(features, "stored", lambda df: written.append(df.columns) or stored(df))
    out = features.training_set_trainer(timed, geometry)
    assert sum("wide" in columns for columns in written) == 1 and len(written) > 2
    assert out.count() > 0 and "wide" in out.columns and "_row" not in out.columns


def shuffle_files(spark):
    """Shuffle files of the local session that hold rows."""
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().endswith(".data")}


def test_what_is_stored_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(20_000).withColumn("k", F.col("id") % 999)
    groups, dealt = stored(rows.repartition(4, "k").groupBy("k").count()), stored(rows.repartition(4, "k"))
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert groups.count() == 999 and dealt.select(F.sum("id")).first()[0] == 20_000 * 19_999 // 2


def test_rows_of_a_model_are_all_that_is_left_of_their_way(spark, tables):
    before = set(os.listdir(shared_dir(spark)))
    rows = external.training_rows(spark, tables)
    left = [f for f in set(os.listdir(shared_dir(spark))) - before if f.startswith("stored")]
    assert [f"{shared_dir(spark)}/{f}" for f in left] == [rows.scratch]
    assert {"split", "_early", *external.MODEL_FEATURES} <= set(rows.columns) and rows.count() >= 0


def test_each_repeat_of_a_permutation_ends_before_the_next(spark, monkeypatch):
    rows = spark.range(300).select(F.col("id").alias("result_id"), (F.col("id") % 7).cast("double").alias("a"), F.lit(1.0).alias("b"), (F.col("id") % 7 * 2.0).alias("y"))
    model = ml.boosted_pipeline(["a", "b"], "y", iterations=2, depth=3).fit(ml._for_boosting(rows))
    written = []
    monkeypatch.setattr(ml, "stored", lambda df: written.append(df.columns) or stored(df))
    out = {r["feature"]: r["importance"] for r in ml.permutation_importance(model, rows, ["a", "b"], "y", repeats=3).collect()}
    assert written == [["feature", "mse"]] * 3
    assert out["a"] > 0.5 and abs(out["b"]) < 1e-9


def files_of(df, folder):
    return [f for f in df.inputFiles() if folder in f]


def test_medians_read_a_written_history(spark, tables):
    from splitclock.catalog import history as queries

    for query in (queries.impute_median, queries.impute_surface_median):
        out = query(spark, tables)
        assert not files_of(out, tables) and out.count() == 600


def test_training_profiles_read_written_inputs(spark, tables):
    from splitclock.catalog import predictions

    assert not files_of(predictions.training_set_profiles(spark, tables), tables)


def test_a_feature_matrix_leaves_one_table(spark, tables):
    given = stored(fx.timed_results(spark, tables))
    before = set(os.listdir(shared_dir(spark)))
    out = features.v1_feature_matrix(given, ["BUILDING"])
    rows = set().union(*[{os.path.dirname(f.removeprefix("file://"))} for f in out.inputFiles()])
    left = [n for n in set(os.listdir(shared_dir(spark))) - before if os.path.join(shared_dir(spark), n) not in rows]
    # What is not read by the matrix are counts that its medians were found by.
    wide = [n for n in left if len(spark.read.parquet(os.path.join(shared_dir(spark), n)).columns) > 8]
    assert out.count() == given.count() == 600 and [n for n in wide if n not in given.scratch] == []


def test_rows_are_not_numbered_where_rallies_are_split(spark):
    from splitclock.operators.aggregates import temporal_split

    rows = [("r1", "2024-01-01", 1, "a"), ("r2", "2024-02-01", 1, "b"), ("r2", "2024-02-01", 2, "c"), ("r3", "2024-03-01", None, "d")]
    df = spark.createDataFrame(rows, "rally_id string, rally_date string, stage_number int, result_id string")
    out = temporal_split(df)
    assert "_pos" not in out._jdf.queryExecution().analyzed().toString()
    assert {r.result_id: r.split for r in out.collect()} == {"a": "train", "b": "train", "c": "train"}
    assert {r.result_id: r.split for r in temporal_split(df.where("rally_id = 'r2'")).collect()} == {"b": "train", "c": "test"}


def test_every_request_has_its_features(spark, tables):
    """Also the one that was five times as slow as the others, whose result no model learns from."""
    timed = fx.timed_results(spark, tables).withColumn("normalized_class", F.col("car_class"))
    timed = stored(timed.withColumn("time_seconds", F.when(F.col("driver_id") == 7, F.col("time_seconds") * 5).otherwise(F.col("time_seconds"))))
    geometry = stored(fx.stage_geometry(spark, tables, timed))
    trained, asked = features.training_set_trainer(timed, geometry), features.request_features(timed, geometry)
    assert asked.count() == timed.where("stage_number <> 9").count() == 540 and asked.columns == trained.columns
    assert asked.where("driver_id = 7").count() == 9 and trained.where("driver_id = 7").count() == 0


def test_every_request_gets_the_correction_of_the_model(spark, tables, monkeypatch):
    from splitclock.catalog import predictions

    model = ml.train_correction_model(external.training_rows(spark, tables), external.MODEL_FEATURES, iterations=2, depth=2)
    monkeypatch.setitem(external._trained, (spark.sparkContext.applicationId, tables), model)
    got = predictions.predict_notional_from_model(spark, tables).groupBy("geometric_mode").count().collect()
    hairpins = fx.stage_geometry(spark, tables).where("hairpin_density > 0").count()
    assert {r.geometric_mode: r["count"] for r in got} == {"geometric": 60 * hairpins, "fallback": 60 * (10 - hairpins)}


def test_the_live_form_reads_no_more_than_it_is_made_of(spark, tables, tmp_path, monkeypatch):
    from splitclock.streaming import live

    timed = stored(fx.timed_results(spark, tables))
    t = timed.select("result_id", "rally_id", "stage_id", "stage_number", "driver_id", "car_class", "surface", "stage_length_km", "time_seconds")
    t.where("stage_number = 1").write.parquet(f"{tmp_path}/feed")
    seen, real = [], live.ratio_to_class_best
    monkeypatch.setattr(live, "ratio_to_class_best", lambda rows, **how: seen.append((set(rows.columns), how)) or real(rows, **how))
    asked = stored(external.live_requests(spark, tables, timed))
    before = predict.live_history(external.facts.ratio_to_class_best(external.classed(spark, tables, timed).drop("ratio_to_class_best", "class_best_time")))
    live.stream_compare_predict(live.stream_results(spark, f"{tmp_path}/feed", t.schema, "parquet"), asked, before, str(tmp_path), f"{tmp_path}/state").awaitTermination()
    assert seen == [({"rally_id", "stage_id", "stage_number", "driver_id", "normalized_class", "time_seconds"}, {"write": True})]
    assert live.newest_log(spark, str(tmp_path)).count() == 60
