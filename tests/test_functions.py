"""Edge rows for the column functions."""

import math
from datetime import datetime

from pyspark.sql import functions as F

from halocast.functions import geo, identifiers as ids, text, times


def one(spark, expr, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")]
    return spark.range(1).select(*cols).select(expr.alias("x")).first()["x"]


def many(spark, values, ddl, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_clean_number(spark):
    got = many(spark, [1.5, float("nan"), float("inf"), float("-inf"), None, 0.0], "double",
               ids.clean_number("v"))
    assert got == [1.5, None, None, None, None, 0.0]
    assert many(spark, ["2", "x", "NaN"], "string", ids.clean_number("v")) == [2.0, None, None]


def test_haversine_properties(spark):
    rows = [(0.0, 0.0, 0.0, 180.0), (10.0, 20.0, -30.0, 40.0), (90.0, 0.0, -90.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    out = df.select(geo.haversine("a", "b", "c", "d").alias("x"),
                    geo.haversine("c", "d", "a", "b").alias("y"),
                    geo.haversine("a", "b", "a", "b").alias("z")).collect()
    for r in out:
        assert r.x >= 0 and abs(r.x - r.y) < 1e-9 and r.z == 0
    assert abs(out[0].x - math.pi * 6371) < 1e-6


def test_wrapped_box_is_the_union_of_two_plain_boxes(spark):
    df = spark.range(-180, 181).select(F.lit(0.0).alias("lat"), F.col("id").cast("double").alias("lon"))
    wrapped = df.filter(geo.box_filter((-10, 10, 120, -70))).count()
    east = df.filter(geo.box_filter((-10, 10, 120, 180))).count()
    west = df.filter(geo.box_filter((-10, 10, -180, -70))).count()
    assert wrapped == east + west
    assert df.filter(geo.box_filter((-10, 10, 120, -70), wrap=False)).count() == 0


def test_wrapped_center(spark):
    assert one(spark, geo.center_lon(F.lit(120.0), F.lit(-70.0))) == -155.0
    assert one(spark, geo.center_lon(F.lit(150.0), F.lit(-170.0))) == 170.0
    assert one(spark, geo.center_lon(F.lit(-80.0), F.lit(20.0))) == -30.0


def test_zero_is_a_value(spark):
    assert one(spark, geo.format_position("lat", "lon"), lat=0.0, lon=0.0) == "0.00°N, 0.00°E"
    assert one(spark, geo.valid_coordinates("lat", "lon"), lat=0.0, lon=0.0) is True
    assert one(spark, geo.valid_coordinates("lat", "lon"), lat=90.0001, lon=0.0) is False
    assert one(spark, geo.valid_coordinates("lat", "lon"), lat=90.0, lon=-180.0) is True


def test_basins(spark):
    args = dict(lat=10.0, lon=-120.0)
    assert one(spark, geo.guess_basin(), **args) == "North Pacific"
    assert one(spark, geo.guess_basin(ruleset="reference"), **args) == "North Atlantic"


def test_times(spark):
    days = many(spark, [0.0, 0.5, 26829.5, 999999.0, 1e6, 1e9 + 1], "double",
                times.normalise_number("v", "optimized"))
    assert days[0] is None and days[1] == datetime(1950, 1, 1, 12)
    assert days[2] == datetime(2023, 6, 16, 12) and days[3].year == 4687
    assert days[4] is None and days[5] is None
    ultra = many(spark, [0.5, 10000.0, 26829.5, 1e9 + 1], "double", times.normalise_number("v"))
    assert ultra == [None, None, datetime(2023, 6, 16, 12), datetime(2001, 9, 9, 1, 46, 41)]
    texts = many(spark, ["2023-06-15", "20230615", "2023", "junk", "2023-06-15 01:02:03",
                         "2023-13-45"], "string", times.normalise_text("v"))
    assert texts == [datetime(2023, 6, 15), datetime(2023, 6, 15), datetime(2023, 1, 1), None,
                     datetime(2023, 6, 15, 1, 2, 3), None]


def test_identifiers(spark):
    got = many(spark, ["\x00 ", "nan", "5901234\x00\x00", None, "F1"], "string",
               ids.clean_platform("v", F.col("i")))
    assert got == ["float_0000", "float_0001", "5901234", "float_0003", "F1"]
    assert many(spark, ["2temp", "___", "a b/c", "x" * 80, "TEMP_"], "string",
                ids.safe_column_name("v")) == ["var_2temp", "unknown_var", "a_b_c", "x" * 60, "temp"]
    assert many(spark, ["a/b\\c:d e<f>", "°", "y" * 120], "string", ids.clean_filename("v")) == [
        "a_b_c_d_e_f_", "unknown", "y" * 100]
    assert many(spark, ["/in/x.nc", "plain", "a.b.nc4"], "string",
                ids.build_profile_id("v", F.lit(3))) == ["x_profile_3", "plain_profile_3",
                                                         "a.b_profile_3"]


def test_coordinates_in_file_names(spark):
    lat, lon = ids.coords_from_filename("v")
    names = ["x_12.5N_65W.nc", "x_3S_4E.nc", "plain.nc"]
    assert many(spark, names, "string", lat) == [12.5, -3.0, None]
    assert many(spark, names, "string", lon) == [-65.0, 4.0, None]


def test_standard_names(spark):
    got = many(spark, ["temp", "Psal", "DOXY_QC", "my var-1", "--"], "string",
               ids.map_standard_name("v"))
    assert got == ["TEMPERATURE", "SALINITY", "OXYGEN", "MYVAR1", "UNKNOWN_VAR"]


def test_ranges_and_lists(spark):
    got = many(spark, ["2.5-25.3°C", "-1.2-8.7°C", "40-120 µmol/L", "none"], "string",
               ids.parse_range("v"))
    assert [(r["min"], r["max"]) for r in got] == [(2.5, 25.3), (-1.2, 8.7), (40.0, 120.0),
                                                   (None, None)]
    assert many(spark, ['["A","B"]', "{broken", None], "string", ids.parse_variables("v")) == [
        ["A", "B"], [], []]


def test_regions_in_texts(spark):
    texts = ["salinity in the North Atlantic", "Equatorial waters", "nothing here"]
    df = F.lower("v")
    longest = many(spark, texts, "string", text.region_box(df, "enhanced")["name"])
    first = many(spark, texts, "string", text.region_box(df, "enhanced", "first")["name"])
    assert longest == ["north atlantic", "equator", None]
    assert first == ["atlantic", "equator", None]
    assert many(spark, texts, "string", text.region_box(df, "base")["name"])[1] == "equatorial"


def test_points_in_texts(spark):
    texts = ["around 12.5°N, 65E", "30S 20W", "12 N 65 E", "n 1 e 2", "12.5n, 65e"]
    base = many(spark, texts, "string", text.point_box("v", "base"))
    strict = many(spark, texts, "string", text.point_box("v", "enhanced"))
    assert (base[0].lat_min, base[0].lon_max) == (7.5, 70.0)
    assert (base[1].lat_min, base[1].lon_min) == (-35.0, -25.0)
    assert base[2] is not None and strict[2] is None
    assert base[3] is None and base[4] is None


def test_time_in_texts(spark):
    df = spark.createDataFrame([("past 6 months of 2020",), ("Last Year",), ("in 2019 or 2021",),
                                ("summer",), ("none",)], "text string")
    rows = text.constraints(df).collect()
    assert [r.months_back for r in rows] == [6, 12, None, None, None]
    assert [r.year_asked for r in rows] == [None, None, 2019, None, None]
    assert [r.seasonal for r in rows] == [False, False, False, True, False]


def test_scope(spark):
    df = spark.createDataFrame(
        [("carbon in ocean water",), ("temperature near iceland",), ("phone call",), ("xx",),
         ("ocean weather",), ("float profiles",), (None,)], "text string")
    by_token = [r.in_scope for r in text.in_scope(df).collect()]
    anywhere = [r.in_scope for r in text.in_scope(df, mode="substring").collect()]
    assert by_token == [True, True, False, False, False, True, False]
    assert anywhere == [False, False, True, False, False, True, False]


def test_keyword_is_literal(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), ("A_B",), ("a\\b",)], "s string")
    def hits(word):
        return {r.s for r in df.filter(text.keyword_match(word, ["s"])).collect()}
    assert hits("a%b") == {"a%b"} and hits("a_b") == {"A_B"} and hits("\\") == {"a\\b"}
