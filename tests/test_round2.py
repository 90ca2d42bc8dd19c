"""Missing numbers, zones, pages, archives, and fits that must not pass silently."""

import math
import os
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from geopanel import ordered
from geopanel.functions.text import softmax
from geopanel.operators import bots, describe, regress, spatial
from geopanel.skew import discard, materialize
from geopanel.sources import archives, pages
from geopanel.sources.regions import read_regions

NAN = float("nan")


def test_windows_skip_nan(spark):
    rows = [("a", datetime(2024, 1, 1, 0, 0, 0), NAN), ("a", datetime(2024, 1, 1, 0, 0, 1), 1.0)]
    df = spark.createDataFrame(rows, "username string, timestamp timestamp, vader_compound double")
    got = {r["timestamp"].second: (r["posts"], r["mean"]) for r in bots.forward_window_stats(df, 5).collect()}
    assert got == {0: (2, 1.0), 1: (1, 1.0)}


@pytest.mark.parametrize("heavy", [{}, {"min_rows": 1}])
def test_both_quantile_ways_skip_nan(spark, heavy):
    df = spark.createDataFrame([("g", NAN), ("g", 1.0), ("g", 3.0), ("g", None)], "k string, v double")
    row = describe.group_stats(df, ["k"], "v", **heavy).first()
    assert (row["count"], row["mean"], row["median"], row["min"], row["max"]) == (4, 2.0, 2.0, 1.0, 3.0)
    assert row["mean_strict"] is None
    row = describe.summarize_columns(df, ["v"]).first()
    assert (row["mean"], row["median"], row["missing"]) == (2.0, 2.0, 2)
    assert math.isclose(row["sd"], math.sqrt(2))


def test_one_zone_for_every_point(spark):
    squares = [("B", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"), ("A", "POLYGON ((10 0, 20 0, 20 10, 10 10, 10 0))")]
    zones = read_regions(spark.createDataFrame(squares, "tzid string, wkt string"))
    points = spark.createDataFrame(
        [(1, 5.0, 5.0), (2, 10.0, 5.0), (3, 50.0, 5.0), (4, None, None), (5, 15.0, 5.0), (5, 15.0, 5.0)],
        "id int, lon double, lat double",
    )
    for limit in ({}, {"max_bytes": 0, "spread": ["id"]}):
        got = sorted((r["id"], r["tzid"]) for r in spatial.attach_timezone(points, zones, tile=2.0, **limit).collect())
        assert got == [(1, "B"), (2, "A"), (3, None), (4, None), (5, "A"), (5, "A")]


def test_many_posts_on_a_page(spark):
    post = '<article><span>{0}</span><span>@{0}</span><time datetime="t{0}"></time><a href="/places/x"><span>P</span></a><div data-testid="tweetText">hi <b>{0}</b></div></article>'
    html = post.format("a") + "<article>nothing</article>" + post.format("b")
    df = spark.createDataFrame([(7, html), (8, ""), (9, None)], "page_id int, html string")
    got = pages.extract_posts(df, keep=["page_id"]).select("page_id", "post", "name", "text").collect()
    assert sorted(map(tuple, got)) == [(7, 0, "a", "hi a"), (7, 2, "b", "hi b")]


def test_ids_keep_file_order(spark, tmp_path):
    ids = [str(10**18 - i * 7919) for i in range(250)]
    with zipfile.ZipFile(os.path.join(tmp_path, "x.zip"), "w") as z:
        z.writestr("x_ID.txt", "\n".join(ids))
    rows = archives.read_id_archives(spark, str(tmp_path))
    batched = archives.batch_ids(rows, "file", "id", line="line").orderBy("line").collect()
    assert [r["id"] for r in batched] == ids
    assert [r["batch"] for r in batched] == [i // 100 for i in range(250)]


def test_unconverged_fit_raises(spark):
    rows = spark.range(400).selectExpr("id % 20 AS a", "(id * 7 + id % 3) % 17 AS b", "id % 11 + 0.5 AS x", "id % 13 + 0.1 * id AS y")
    with pytest.raises(regress.NotConverged):
        regress.fe_regression(rows, ["y"], ["x"], ["a", "b"], max_rounds=2, tol=1e-14)
    assert regress.fe_regression(rows, ["y"], ["x"], ["a", "b"]).rounds > 2


def test_softmax_binds_once(spark):
    row = spark.sql("SELECT array(1d, 2d, 3d) AS l").select(softmax(F.col("l")).alias("p")).first()["p"]
    assert [round(v, 5) for v in row] == [0.09003, 0.24473, 0.66524]


def test_discard_removes_what_was_written(spark):
    written = materialize(spark.range(5), "gone")
    folder = os.path.dirname(written.inputFiles()[0].removeprefix("file://").removeprefix("file:"))
    assert os.path.isdir(folder)
    discard(written)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("far", [[1e30, 1e36, -1e36], [float("inf"), float("-inf"), 5e-324]])
def test_far_values_do_not_widen_the_last_step(spark, far):
    values = [i * 2e-7 for i in range(5000)] + far + [10.0**-e for e in range(10, 60)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.selectExpr("1 AS k", "v AS value").groupBy("k", "value").agg(F.count("*").alias("copies"))
    targets = spark.createDataFrame([(1, 0, 2500), (1, 1, 0), (1, 2, len(values) - 1)], "k int, probe int, rank long")
    got = {r["probe"]: r["value"] for r in ordered.select_ranks(rows, ["k"], targets).collect()}
    assert got == {0: sorted(values)[2500], 1: min(values), 2: max(values)}
    span = rows.groupBy("k").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    state = targets.join(span, "k").withColumn("below", F.lit(0).cast("long"))
    for _ in range(ordered.QUANTILE_LEVELS):
        state = ordered._narrow(rows, ["k"], ["k", "probe"], state)
    assert ordered._in_question(rows, ["k"], state).count() <= 6
