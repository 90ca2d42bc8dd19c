"""Crowded keys, hours, places and lexicons: the same rows, dealt evenly."""

import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geopanel import ordered, skew
from geopanel.operators import bots, score, spatial, weather
from geopanel.sources import archives
from tests.test_spatial import SQUARE, STAR, even_odd, layer, points


def test_half_of_all_rows_on_one_key(spark):
    rows = spark.range(20_000).selectExpr("id", "IF(id % 2 = 0, 'hot', concat('k', id % 900)) AS key")
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "key string, w int")
    crowded = skew.crowded_keys(rows, ["key"], 500)
    assert [tuple(r) for r in crowded.collect()] == [("hot", 20)]
    dealt = skew.salted(rows, crowded, ["key"], ["id"], "salt").groupBy("key", "salt").count()
    assert dealt.agg(F.max("count")).first()[0] < 1.2 * 500
    for max_keys in (0, 10):
        joined = skew.salted_join(rows, dim, ["key"], "left", min_rows=500, max_keys=max_keys, spread=["id"])
        assert joined.count() == 20_000 and joined.where("w = 1").count() == 10_000
    # a large table does not make a key of so many rows usual
    assert skew.crowded_keys(rows.union(rows), ["key"], 500).first()["_salts"] == 40


def posts(spark, rows):
    df = spark.createDataFrame([(i, u, t, v) for i, (u, t, v) in enumerate(rows)], "id int, username string, t long, vader_compound double")
    return df.withColumn("timestamp", F.timestamp_micros("t"))


def test_one_user_in_one_hour_spreads(spark):
    rows = spark.range(30_000).selectExpr("'u' AS username", "id * 37 % 30011 AS t")
    sliced = ordered.range_slices(rows, ["username"], ["t"])
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * min(sizes)
    edges = sliced.groupBy("_slice").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("_slice").collect()
    assert all(x["b"] < y["a"] for x, y in zip(edges, edges[1:]))


def test_forward_windows_of_a_crowded_hour(spark):
    rng = np.random.default_rng(3)
    users = np.where(rng.random(600) < 0.7, "hot", rng.choice(list("abc"), 600))
    rows = [(str(u), int(t), float(v)) for u, t, v in zip(users, rng.integers(0, 5_000_000, 600), rng.normal(size=600))]
    rows += [(None, 10, 1.0), (None, 20, 3.0)]
    got = bots.forward_window_stats(posts(spark, rows), 0.4).toPandas().sort_values("id")
    pdf = pd.DataFrame(rows, columns=["u", "t", "v"]).fillna({"u": "-"})
    for (_, row), (_, out) in zip(pdf.iterrows(), got.iterrows()):
        inside = pdf[(pdf.u == row.u) & (pdf.t >= row.t) & (pdf.t < row.t + 400_000)]
        assert out["posts"] == len(inside) and out["mean"] == pytest.approx(inside.v.mean(), rel=1e-13, abs=1e-15)


def test_sums_of_any_size(spark):
    rows = [("u", 0, 1e20), ("u", 1, 1e-15), ("u", 2, -1e20), ("u", 3, 3e-300), ("u", 10_000_000, -2.5e-15), ("v", 0, math.inf),
            ("v", 1, 1.0), ("w", 0, 0.0), ("w", 1, None), ("x", 5, None), ("y", 0, 1.7e308), ("y", 1, -1.7e308), ("y", 2, 5e-324)]
    got = {r["id"]: r["mean"] for r in bots.forward_window_stats(posts(spark, rows), 5).collect()}
    want = {
        0: (1e-15 + 3e-300) / 4, 1: (1e-15 - 1e20) / 3, 2: -1e20 / 2, 3: 3e-300, 4: -2.5e-15, 5: None, 6: 1.0, 7: 0.0, 8: None,
        9: None, 10: 5e-324 / 3, 11: -1.7e308 / 2, 12: 5e-324,
    }
    for i, value in want.items():
        assert got[i] == (value if value is None else pytest.approx(value, rel=5e-16, abs=0)), i


def test_bursts_inside_one_second(spark):
    rng = np.random.default_rng(9)
    rows = [("hot", int(t), 0.0) for t in rng.integers(0, 10**9, 400) * 7] + [("b", t, 0.0) for t in (0, 900_000, 1_800_000, 2_700_000)]
    rows += [(None, t, 0.0) for t in (5, 6, 7)]
    pdf = pd.DataFrame(rows, columns=["u", "t", "v"]).fillna({"u": "-"}).sort_values(["u", "t"])
    gap = pdf.t - pdf.groupby("u").t.shift(2)
    for span in (1.0, 2.0):
        got = {r["username"] or "-" for r in bots.burst_users(posts(spark, rows), 3, span).collect()}
        assert got == set(pdf.u[gap <= span * 1e6])


def test_knots_off_the_step(spark):
    rows = [("a", "2015-07-01 00:07:00", 0.0), ("a", "2015-07-01 03:07:00", 6.0), ("a", "2015-07-01 03:50:00", None),
            ("a", "2015-07-01 05:07:00", 6.0), ("b", "2015-07-01 01:10:00", 1.0), ("b", "2015-07-01 01:50:00", 5.0),
            ("c", "2015-07-01 01:00:00", 7.0), ("d", "2015-07-01 01:01:00", 7.0)]
    df = spark.createDataFrame(rows, "id string, timestamp string, value double").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    for slice_seconds in (3_600, 86_400):
        got = weather.interpolate_linear(df, ["id"], slice_seconds=slice_seconds).orderBy("id", "timestamp").collect()
        assert [(r["id"], str(r["timestamp"])[11:16], round(r["value"], 9)) for r in got] == [
            ("a", "01:00", round(53 / 30, 9)), ("a", "02:00", round(113 / 30, 9)), ("a", "03:00", round(173 / 30, 9)),
            ("a", "04:00", 6.0), ("a", "05:00", 6.0), ("c", "01:00", 7.0),
        ]


def test_lexicon_inside_the_row(spark):
    texts = spark.createDataFrame([(1, "Good good, bad"), (2, None), (3, ""), (4, "it's fine"), (4, "bad")], "id int, text string")
    lexicon = spark.createDataFrame(
        [("good", 1.0), ("good", 0.5), ("bad", -2.0), ("it's", 3.0), (None, 9.0), ("none", None)], "token string, valence double"
    )
    scored = score.lexicon_compound(texts, lexicon)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan
    got = [(r["id"], r["compound"]) for r in scored.orderBy("id", "text").collect()]
    assert [i for i, _ in got] == [1, 2, 3, 4, 4]
    assert [c for _, c in got] == pytest.approx([1 / 4, 0, 0, -2 / math.sqrt(19), 3 / math.sqrt(24)])
    # the way of large lexicons gives the same for distinct ids
    joined = score.lexicon_compound(texts.limit(3), lexicon, max_entries=2)
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    assert [r["compound"] for r in joined.orderBy("id").collect()] == pytest.approx([1 / 4, 0, 0])


@pytest.mark.parametrize("budget", [5, 60, 10_000])
def test_quadtree_finds_the_same_rows(spark, budget):
    rng = np.random.default_rng(4)
    xy = np.concatenate([np.round(rng.random((300, 2)) * 16 - 2, 3), np.round(rng.normal(5, 0.3, (400, 2)), 4), [[4.4, 4.4]] * 200]) + 0.00037
    pts = points(spark, xy)
    shapes = layer(spark, star=STAR, sq=SQUARE)
    rings = {r["name"]: [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in shapes.collect()}
    joined = spatial.spatial_join_points(pts, shapes, ["name"], tile=3.0, max_bytes=0, budget=budget, min_rows=50, spread=["id"])
    got = sorted((r["id"], r["name"]) for r in joined.collect())
    want = sorted((i, n) for i, (x, y) in enumerate(xy) for n, rs in rings.items() if even_odd(rs, x, y))
    assert got == want
    zones = spatial.attach_timezone(pts, shapes.withColumnRenamed("name", "tzid"), tile=3.0, max_bytes=0, budget=budget, min_rows=50)
    names = {i: min(n for k, n in want if k == i) for i in {k for k, _ in want}}
    assert {r["id"]: r["tzid"] for r in zones.collect()} == {i: names.get(i) for i in range(len(xy))}


def test_no_tile_above_the_budget(spark):
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.random((300, 2)) * 16, rng.normal(5, 0.3, (3000, 2))])
    pts = points(spark, xy).withColumns(dict(zip(("_tx", "_ty"), spatial._tile(F.col("lon"), F.col("lat"), 3.0))))
    tiles = spatial.region_tiles(layer(spark, sq=SQUARE), ["name"], 3.0)
    placed, _ = spatial._adapted(pts, tiles, 3.0, "lon", "lat", 100, 8)
    assert placed.groupBy("_tx", "_ty", "_leaf").count().agg(F.max("count")).first()[0] <= 100


def test_archive_beyond_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "large.zip", "wb") as out:
        out.truncate((1 << 31) + 10_000_000)  # a hole, no disk
        out.seek(0, 2)
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a/one_ID.txt", "\n".join(map(str, range(120_000))))
            z.writestr("two_ID.txt", "7 \r\n8\n")
            z.writestr("skipped.md", "9\n")
    members = archives.list_members(spark, str(tmp_path))
    assert {r["file"]: r["bytes"] for r in members.collect()}["two_ID.txt"] == 6
    rows = archives.read_id_archives(spark, str(tmp_path))
    assert "content" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.groupBy("file").agg(F.count("*").alias("n"), F.max("line").alias("m")).orderBy("file").collect() == [
        ("a/one_ID.txt", 120_000, 119_999), ("two_ID.txt", 2, 1),
    ]
    assert sorted(r["id"] for r in rows.where("file = 'two_ID.txt'").collect()) == ["7", "8"]
