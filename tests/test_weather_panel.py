import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geopanel.operators import describe, panel, score, smooth, weather


def series(spark, rows):
    df = spark.createDataFrame(rows, "id int, t string, value double")
    return df.select("id", F.col("t").cast("timestamp").alias("timestamp"), "value")


def filled(df, **kw):
    rows = weather.interpolate_linear(df, ["id"], **kw).orderBy("id", "timestamp").collect()
    return [(r["id"], r["timestamp"].hour, round(r["value"], 9)) for r in rows]


@pytest.mark.parametrize("slice_seconds", [3600, 10**7])
def test_interpolation(spark, slice_seconds):
    d = "2015-07-01 "
    df = series(spark, [(1, d + "00:00:00", 0.0), (1, d + "03:00:00", None), (1, d + "06:00:00", 12.0), (2, d + "05:00:00", 4.0), (3, d + "00:00:00", None), (3, d + "03:00:00", 1.0), (3, d + "04:00:00", 2.0)])
    want = [(1, h, 2.0 * h) for h in range(7)] + [(2, 5, 4.0), (3, 3, 1.0), (3, 4, 2.0)]
    assert filled(df, slice_seconds=slice_seconds) == want


def test_month_of_knots(spark):
    knots = spark.range(248).select(F.lit(1).alias("id"), F.timestamp_seconds(F.lit(1435708800) + F.col("id") * 10800).alias("timestamp"), F.rand(1).alias("value"))
    knots = knots.cache()
    out = weather.interpolate_linear(knots, ["id"], slice_seconds=86400)
    assert out.count() == 742
    # the series passes through its knots
    assert out.join(knots.withColumnRenamed("value", "k"), ["id", "timestamp"]).where(F.abs(F.col("value") - F.col("k")) > 1e-12).count() == 0


def test_attach_keeps_all_posts(spark):
    t = F.lit("2015-07-01 01:00:00").cast("timestamp")
    long = spark.createDataFrame([(0, "pm25", 5.0), (0, "clouds", 0.5)], "id long, variable string, value double").withColumn("timestamp", t)
    posts = spark.range(50).select("id", (F.col("id") % 2).alias("id_geo")).withColumn("time_bin", t)
    got = weather.attach_grid_variables(posts, long, ["pm25", "clouds"], min_rows=3, spread=["id"])
    assert got.count() == 50 and got.where("pm25 = 5 and clouds = 0.5").count() == 25


def test_group_zscore(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("A", 3.0), ("B", 7.0), ("C", 4.0), ("C", 4.0)], "g string, v double")
    for out in (panel.zscore(df, ["v"], ["g"], min_rows=2), panel.zscore_rows(df, ["v"], ["g"])):
        got = sorted(map(tuple, out.collect()), key=str)
        assert got == sorted([("A", -1.0), ("A", 0.0), ("A", 1.0), ("B", None), ("C", None), ("C", None)], key=str)


def test_global_zscore(spark):
    out = panel.zscore(spark.range(101).select(F.col("id").cast("double").alias("v")), ["v"]).agg(F.avg("v"), F.stddev_samp("v")).first()
    assert out[0] == pytest.approx(0, abs=1e-12) and out[1] == pytest.approx(1)


def test_summary(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,), (None,)], "v double")
    row = describe.summarize_columns(df, ["v"]).first()
    assert tuple(row)[1:7] == (1.0, 1.75, 3.0, 3.75, 5.0, 8.0) and row["missing"] == 1


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(2.5, 1.0), (3.5, 2.0), (80.0, 9.0)], "pm25 double, o double")
    assert sorted(map(tuple, describe.response_curve(df, ["o"]).collect())) == [(2, 1.0), (4, 2.0)]


def test_strict_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "g string, v double")
    got = df.groupBy("g").agg(describe.agg_mean("v").alias("m"), describe.agg_mean("v", strict=True).alias("s"))
    assert sorted(map(tuple, got.collect())) == [("a", 1.0, None), ("b", 2.0, 2.0)]


def test_weekday_profile_lags_inside_series(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (1, 2.0, 3.0), (1, 3.0, 1.0)], "day int, a double, b double")
    got = describe.weekday_profile(df, {"A": "a", "B": "b"}).where("day = 0").collect()
    assert len(got) == 2 and all(r["lag"] is None for r in got) and got[0]["day_name"] == "Sun"


def test_select_range_and_sample(spark):
    df = spark.createDataFrame([(i, i, i, i) for i in range(50)], "id int, `x&y` int, b int, c int")
    assert panel.select_range(df, "x&y", "b", ["id"]).columns == ["id", "x&y", "b"]
    first, again = (sorted(r["id"] for r in panel.sample_n(df, 20, "id").collect()) for _ in range(2))
    assert len(first) == 20 and first == again != list(range(20))


def test_lexicon(spark):
    lex = spark.createDataFrame([("good", 3.0), ("bad", -1.5)], "token string, valence double")
    posts = spark.createDataFrame([(1, "GOOD!"), (2, "bad"), (3, None), (4, "plain")], "id int, text string")
    for limit in (0, 1 << 20):
        got = {r["id"]: r["compound"] for r in score.lexicon_compound(posts, lex, max_bytes=limit, min_rows=1).collect()}
        assert got == pytest.approx({1: 0.612372, 2: -0.361158, 3: 0.0, 4: 0.0}, abs=1e-6)


def one_hot():
    return lambda texts: np.eye(3)[[len(t) % 3 for t in texts]] * 50


def test_batch_scorer(spark):
    posts = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "id int, text string")
    got = {r["id"]: (r["m_negative"], r["m_neutral"], r["m_positive"]) for r in score.three_class_scores(posts, one_hot, "m").collect()}
    assert got[1] == pytest.approx((0, 1, 0)) and got[2] == pytest.approx((0, 0, 1)) and got[3] == pytest.approx((1, 0, 0))


def test_topic_label_list(spark):
    posts = spark.createDataFrame([(1, "a")], "id int, text string")
    make = lambda: lambda texts: np.array([[0.9, 0.2, 0.7]] * len(texts))
    row = score.topic_scores(posts, make, logits=False, classes=["x", "y_&_z", "w"]).first()
    assert row["label"] == "['x', 'w']" and row["y_&_z"] == 0.2


def test_loess_reproduces_quadratics_and_repeats(spark):
    rows = [("g", float(x), 2 + x - 0.5 * x * x) for x in range(12)]
    df = spark.createDataFrame(rows + rows, "s string, x double, y double")
    got = smooth.loess_by_group(df, ["s"], "x", "y").collect()
    assert len(got) == 12 and all(r["n"] == 2 and math.isclose(r["smooth"], r["y"], abs_tol=1e-9) for r in got)
