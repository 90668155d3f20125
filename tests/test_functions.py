"""Scalar goldens."""

import pytest
from pyspark.sql import functions as F

from splitclock.functions import classes, scoring, text, times


def one(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_parse_stage_time(spark):
    cases = {
        "5:23.4": 323.4, "12:34.567": 754.567, "1:05:23.456": 3923.456, "5:23": 323.0, "1:05:23": 3923.0, "04:18:3": 258.3, "75:10:5": 4510.5, "1:02:03:4": 3723.4,
        "10:37:900": 39120.0, "DNF": None, "dns": None, "DSQ": None, "": None, "invalid": None, "—": None,
    }
    got = one(spark, [*cases, None], times.parse_stage_time)
    assert got == pytest.approx([*cases.values(), None])


def test_parsers_disagree_where_they_should(spark):
    assert one(spark, ["10:37:900", "04:02:05", "x", "1:02,5", "1:02:30"], times.parse_live_time) == pytest.approx([39120.0, 242.5, 0.0, 62.5, 3750.0])
    manual = {"01:10:800": 70.8, "01:30:3": 90.3, "10:37:900": 637.9, "04:18:300": 258.3, "04:18.300": 258.3, "1:04:02": 3842.0, "12,5": 12.5, "1:75": None, "1:75:3": None, "1:04:99": None, "0": None, "a:b": None, "": None}
    assert one(spark, list(manual), times.parse_manual_time) == pytest.approx(list(manual.values()))
    assert one(spark, ["1:75", "1:75:3", "1:04:99", "0", "", "1:10:8"], times.manual_time_error) == ["seconds_not_below_60", "middle_not_below_60", "last_not_below_60", "not_positive", "empty", None]
    assert one(spark, ["12:34.5", "1:02:03:4", "1:23,4", "0:0", "x"], times.parse_collector_time) == pytest.approx([754.5, 3723.4, 83.4, None, None])


def test_format_times(spark):
    v = [323.4, 3923.456, 63.5, None, -1.0, 0.0]
    assert one(spark, v, times.format_time, "DOUBLE") == ["5:23.40", "1:05:23.46", "1:03.50", "—", "—", "0:00.00"]
    assert one(spark, [70.8, 908.25, -5.0, 59.9999], times.format_manual, "DOUBLE") == ["01:10:800", "15:08:250", "-00:05:000", "01:00:000"]
    assert one(spark, [83.44, 59.99, None], times.format_collector, "DOUBLE") == ["01:23,4", "00:59,9", "00:00,0"]


def test_names(spark):
    same = ["Ali Türkkan", "ALİ TÜRKKAN", " ali  türkkan_"]
    assert set(one(spark, same, text.normalize_name_key)) == {"ali turkkan"}
    assert set(one(spark, same, text.normalize_name_key_unicode)) == {"ali turkkan"}
    assert one(spark, ["Efehan Yazıcı", None, "!!"], text.build_driver_id) == ["drv_efehan-yazici", "drv_unknown", "drv_unknown"]
    assert one(spark, ["ışıl İNCE", "ALİ kılıç"], text.turkish_title) == ["Işıl İnce", "Ali Kılıç"]
    assert one(spark, [" çağrı ", None, ""], text.ascii_upper_name) == ["CAGRI", "BILINMEYEN", "BILINMEYEN"]
    assert one(spark, ["166a", "x", " -7"], text.numeric_prefix) == [166, 0, -7]


def test_stage_numbers(spark):
    assert one(spark, ["SSS 3", "SS12 x", "ÖE 4", "Ö.E. 5", "Etap 06", "stage 7", "8. etap", "none"], text.stage_number_from_text) == [3, 12, 4, 5, 6, 7, 8, None]
    assert one(spark, ["166_ss01", "SS 3", "x9", "a"], text.stage_number_from_id) == [1, 3, 9, None]
    assert one(spark, ["ÖE1 - X - 8,25km", "8.0 km", "none"], text.length_from_name) == [8.25, 8.0, None]


def test_classes(spark):
    assert one(spark, ["RALLY2", "  R4  ", "CustomClass123", "", None, "H13"], classes.normalize_class) == ["Rally2", "Rally2", "CustomClass123", "Unknown", "Unknown", "K3"]
    assert one(spark, ["Yeşil Bursa Rallisi", "Ege Rallisi", "Anadolu"], classes.surface_from_name) == ["asphalt", "asphalt", "gravel"]
    assert one(spark, ["Baja Rally", "İç Anadolu Ralli", "X"], classes.is_event_category) == [False, True, False]


def test_confidence(spark):
    df = spark.range(1)
    def score(*a):
        c = scoring.confidence_v2(*[F.lit(x) for x in a])
        return df.select(c["score"].alias("s"), c["level"].alias("l")).first()
    high = score(20, 15, True, 0.9, 4, 1.05, "geometric")
    assert (high["s"], high["l"]) == (100, "HIGH")
    extreme = score(20, 15, True, 0.9, 4, 1.25, "geometric")
    assert extreme["s"] == 90
    assert score(0, 0, False, 0.1, 0, 1.25, "fallback")["l"] == "VERY_LOW"


def test_similarity_of_equal_and_empty_names(spark):
    df = spark.createDataFrame([("rally a", "rally a"), ("", ""), ("x", "")], "a STRING, b STRING")
    assert [r[0] for r in df.select(text.similarity(F.col("a"), F.col("b"))).collect()] == pytest.approx([1.0, 1.0, 0.0])


def test_driver_id_equals_the_steps_one_by_one(spark):
    names = ["Çağan  Şenel 12", "a_b__C", "-x- -y-", "аб-b", "a б в c", "K̇al‌x", "İIıi", "Kelvin", "a b c", "", " ", "__", "日本", "é́.e", None]
    slow = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(text.normalize_name_key(c), F.lit(" "), F.lit("-")), "[^a-z0-9-]+", ""), "-{2,}", "-"), "^-+|-+$", "")
    assert one(spark, names, text.slugify) == [s or "unknown" for s in one(spark, names, slow)]


def test_a_driver_id_is_derived_in_one_pass(spark):
    """Each name is folded once: what a condition and its branch both name would be derived again."""
    df = spark.createDataFrame([("Ada",)], "name string").select(F.coalesce(F.nullif("name", F.lit("")), text.build_driver_id(F.col("name"))).alias("id"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
