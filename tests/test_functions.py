"""Hand-computed cases for the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from geopanel.functions import bins, geo, text, times, units


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def column(spark, values, kind, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in rows.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_normalize(spark):
    got = column(spark, ["@ @bob httpx hi  ", "a\n@bob", None], "string", text.normalize_post)
    assert got == ["@ @user http hi  ", "a\n@bob", None]
    assert column(spark, [None], "string", lambda c: text.normalize_post(c, null_as_nan=True)) == ["nan"]


def test_main_topic(spark):
    labels = ["['sports', 'music']", "['sports']", "[]", None]
    assert column(spark, labels, "string", text.main_topic) == ["'sports'", "'sports'", "'no_topic'", "'no_topic'"]
    bare = column(spark, labels, "string", lambda c: text.main_topic(c, keep_quotes=False))
    assert bare == ["sports", "sports", "no_topic", "no_topic"]


def test_coordinates_first_token_is_latitude(spark):
    rows = spark.createDataFrame([("40.7 -111.9",), ("x y",), ("1",)], "c string")
    lon, lat = text.split_coordinates(F.col("c"))
    assert [tuple(r) for r in rows.select(lat, lon).collect()] == [(40.7, -111.9), (None, None), (1.0, None)]


def test_numbers_with_units(spark):
    got = column(spark, ["12.5 [ug]", "-3e-2 K", "none", ".5"], "string", text.parse_number)
    assert got == [12.5, -0.03, None, 0.5]


def test_softmax_and_argmax(spark):
    got = one(spark, text.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))
    assert got == pytest.approx([0.0900306, 0.2447285, 0.6652410], abs=1e-6)
    assert one(spark, text.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))) == pytest.approx([0.5, 0.5])
    assert one(spark, text.argmax_label(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)), ["a", "b", "c"])) == "b"


def test_pollution_bins(spark):
    values = [0.0, 5.0, 5.1, 70.0, 71.0, -1.0, None, math.nan]
    labels = column(spark, values, "double", lambda c: bins.cut_bins(c, bins.POLLUTION_BREAKS))
    assert labels == ["[0,5]", "[0,5]", "(5,10]", "(65,70]", "(70,Inf]", None, None, None]
    index = column(spark, values, "double", lambda c: bins.bin_index(c, bins.POLLUTION_BREAKS))
    assert index == [0, 0, 1, 13, 14, None, None, None]


def test_tenths_are_exact(spark):
    labels = column(spark, [0.1, 0.3, 0.30000000000000004], "double", lambda c: bins.cut_bins(c, bins.SCORE_BREAKS))
    assert labels == ["[0,0.1]", "(0.2,0.3]", "(0.3,0.4]"]


def test_open_lowest_bin(spark):
    got = column(spark, [0.0, 0.1], "double", lambda c: bins.cut_bins(c, [0, 5, 10], include_lowest=False))
    assert got == [None, "(0,5]"]


def test_interval_bounds(spark):
    rows = spark.createDataFrame([("[0,5]",), ("(70,Inf]",), ("(0.2,0.3]",)], "n string")
    assert [tuple(r) for r in rows.select(*bins.interval_bounds(F.col("n"))).collect()] == [
        (0.0, 5.0),
        (70.0, None),
        (0.2, 0.3),
    ]


def test_weekday_and_local_time(spark):
    assert one(spark, times.weekday(F.lit("2015-07-05").cast("date"))) == 0
    assert one(spark, times.weekday_name(times.weekday(F.lit("2015-07-04").cast("date")))) == "Sat"
    ts = F.lit("2015-07-05 03:30:00").cast("timestamp")
    assert str(one(spark, times.local_time(ts, F.lit("America/New_York")))) == "2015-07-04 23:30:00"
    assert str(one(spark, times.local_time(ts, F.lit("America/Los_Angeles")))) == "2015-07-04 20:30:00"


def test_hour_bins_out_of_range(spark):
    start, stop = (F.lit(f"2015-07-05 {h}:00:00").cast("timestamp") for h in ("00", "10"))
    rows = spark.createDataFrame([("2015-07-05 03:59:59",), ("2015-07-05 10:00:00",)], "t string")
    got = rows.select(times.cut_hours(F.col("t").cast("timestamp"), start, stop).cast("string").alias("b")).collect()
    assert [r["b"] for r in got] == ["2015-07-05 03:00:00", None]


def test_units(spark):
    rows = spark.createDataFrame(
        [("pm25", 2e-9), ("temperature", 300.15), ("precipitation", 0.002), ("clouds", 0.5)], "v string, x double"
    )
    got = [r[0] for r in rows.select(units.convert_units(F.col("v"), F.col("x"))).collect()]
    assert got == pytest.approx([2.0, 27.0, 2.0, 0.5])
    warm = rows.select(units.convert_units(F.col("v"), F.col("x"), units.KELVIN_PARITY)).collect()[1][0]
    assert warm == pytest.approx(28.0)


def test_distance(spark):
    miles = geo.haversine_miles(F.lit(40.85), F.lit(-111.9), F.lit(40.768612), F.lit(-111.906879))
    assert one(spark, miles) == pytest.approx(5.6349, abs=1e-3)


def test_projection_origin_and_scale(spark):
    x, y = geo.albers_xy(F.lit(-96.0), F.lit(23.0))
    assert one(spark, x) == pytest.approx(0.0, abs=1e-6)
    assert one(spark, y) == pytest.approx(0.0, abs=1e-6)
    # published example coordinates of the conterminous-US projection keep areas:
    # a small cell's projected area equals its area on the ellipsoid
    def corner(lon, lat):
        cx, cy = geo.albers_xy(F.lit(lon), F.lit(lat))
        return one(spark, cx), one(spark, cy)

    h = 0.01
    pts = [corner(-90, 40), corner(-90 + h, 40), corner(-90 + h, 40 + h), corner(-90, 40 + h)]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1]))) / 2
    e = geo.albers_constants()[0]
    band = geo.SEMI_MAJOR**2 * (
        geo._authalic(math.sin(math.radians(40 + h)), e) - geo._authalic(math.sin(math.radians(40)), e)
    ) / 2
    assert area == pytest.approx(band * math.radians(h), rel=1e-6)
