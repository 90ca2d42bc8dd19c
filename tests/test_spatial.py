import numpy as np
import pytest
from pyspark.sql import functions as F

from geopanel.operators import spatial
from geopanel.sources.regions import read_regions

SQUARE = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
STAR = "POLYGON ((1 1, 6 2, 11 1, 9 6, 12 11, 6 8, 0 12, 3 6, 1 1))"


def layer(spark, **shapes):
    return read_regions(spark.createDataFrame(list(shapes.items()), "name string, wkt string"))


def points(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, lon double, lat double")


def even_odd(rings, x, y):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
                inside = not inside
    return inside


@pytest.mark.parametrize("tile", [0.7, 3.0, 50.0])
def test_square_with_hole(spark, tile):
    pts = points(spark, [(1, 1), (5, 5), (11, 1), (0, 5), (10, 10), (4, 5), (-0.001, 5)])
    got = spatial.spatial_join_points(pts, layer(spark, sq=SQUARE), ["name"], tile=tile)
    assert sorted(r["id"] for r in got.collect()) == [0, 3, 4, 5]


def test_shared_border_matches_both(spark):
    two = layer(spark, a="POLYGON ((0 0, 5 0, 5 5, 0 5, 0 0))", b="POLYGON ((5 0, 9 0, 9 5, 5 5, 5 0))")
    got = spatial.spatial_join_points(points(spark, [(5, 2), (7, 2)]), two, ["name"], tile=2.0)
    assert sorted((r["id"], r["name"]) for r in got.collect()) == [(0, "a"), (0, "b"), (1, "b")]


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_random_points_brute_force(spark, max_bytes):
    rng = np.random.default_rng(2)
    xy = np.round(rng.random((800, 2)) * 16 - 2, 3) + 0.00037
    shapes = layer(spark, star=STAR, sq=SQUARE)
    rings = {r["name"]: [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in shapes.collect()}
    joined = spatial.spatial_join_points(
        points(spark, xy), shapes, ["name"], tile=1.5, max_bytes=max_bytes, min_rows=5, spread=["id"]
    )
    got = {(r["id"], r["name"]) for r in joined.collect()}
    want = {(i, n) for i, (x, y) in enumerate(xy) for n, rs in rings.items() if even_odd(rs, x, y)}
    assert got == want


def test_left_join_keeps_outsiders(spark):
    got = spatial.spatial_join_points(
        points(spark, [(1, 1), (50, 50)]), layer(spark, sq=SQUARE), ["name"], how="left"
    )
    assert sorted((r["id"], r["name"]) for r in got.collect()) == [(0, "sq"), (1, None)]


GRID = spatial.Grid(0.0, 0.0, 2.0, 1.0, 3, 4)


def test_grid_cells(spark):
    pts = points(spark, [(0, 0), (1.9, 0.9), (2, 1), (5.9, 3.9), (6, 1), (-0.1, 1)])
    got = [r["id_geo"] for r in spatial.assign_grid_cell(pts, GRID).orderBy("id").collect()]
    assert got == [0, 0, 4, 11, None, None]


def test_grid_cells_with_borders(spark):
    got = spatial.assign_grid_cell(points(spark, [(2, 1), (0, 0), (6, 1.5), (9, 9)]), GRID, boundary="all").collect()
    cells = {}
    for r in got:
        cells.setdefault(r["id"], []).append(r["id_geo"])
    assert {i: sorted(c, key=str) for i, c in cells.items()} == {0: [0, 1, 3, 4], 1: [0], 2: [5], 3: [None]}


def test_overlay_areas(spark):
    pieces = spatial.overlay_grid_regions(layer(spark, sq=SQUARE, star=STAR), ["name"], spatial.Grid(-1, -1, 1.5, 1.1, 12, 15))
    got = {r["name"]: r["a"] for r in pieces.groupBy("name").agg(F.sum("area").alias("a")).collect()}
    xs = [(1, 1), (6, 2), (11, 1), (9, 6), (12, 11), (6, 8), (0, 12), (3, 6)]
    star = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(xs, xs[1:] + xs[:1]))) / 2
    assert got["sq"] == pytest.approx(96.0) and got["star"] == pytest.approx(star)


def test_overlay_single_cells(spark):
    pieces = spatial.overlay_grid_regions(layer(spark, tri="POLYGON ((0 0, 4 0, 0 4, 0 0))"), ["name"], spatial.Grid(0, 0, 2, 2, 2, 2))
    got = {r["id_geo"]: (r["area"], r["share"]) for r in pieces.collect()}
    assert got == {0: (4.0, 1.0), 1: (2.0, 0.5), 2: (2.0, 0.5)}


def test_spatiotemporal(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5, "2015-07-05 01:00:00"), (2, 0.5, 0.5, "2015-07-05 02:00:00")], "id int, lon double, lat double, b string")
    pts = pts.select("id", "lon", "lat", F.col("b").cast("timestamp").alias("time_bin"))
    grid = spark.createDataFrame([(0, "2015-07-05 01:00:00", 7.0), (1, "2015-07-05 01:00:00", 8.0)], "id long, timestamp string, pm25 double")
    grid = grid.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    got = spatial.spatiotemporal_join(pts, grid, GRID, min_rows=1).collect()
    assert [(r["id"], r["pm25"]) for r in got] == [(1, 7.0)]
