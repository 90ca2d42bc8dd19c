"""Clipped shapes against a plain rasterised test and closed-form areas."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geopanel.functions.clip import Line, rings_wkt, twice_area
from geopanel.operators import spatial
from geopanel.sources.regions import read_regions

SHAPES = {
    "holed": "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4), (1 1, 2 1, 2 2, 1 2, 1 1))",
    "star": "POLYGON ((1 1, 6 2, 11 1, 9 6, 12 11, 6 8, 0 12, 3 6, 1 1))",
    "comb": "POLYGON ((0 0, 9 0, 9 8, 8 8, 8 1, 6 1, 6 8, 5 8, 5 1, 3 1, 3 8, 2 8, 2 1, 0 1, 0 0))",
    "two": "MULTIPOLYGON (((0 0, 3 0, 3 3, 0 3, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1)), ((5 5, 9 5, 7 9, 5 5)))",
    "spiral": "POLYGON ((0 0, 10 0, 10 10, 1 10, 1 3, 7 3, 7 7, 4 7, 4 6, 6 6, 6 4, 2 4, 2 9, 9 9, 9 1, 0 1, 0 0))",
}


def layer(spark):
    return read_regions(spark.createDataFrame(list(SHAPES.items()), "name string, wkt string"))


def rings_of(text):
    return [[tuple(map(float, p.split())) for p in r.split(",")] for r in re.findall(r"\(([^()]+)\)", text)]


def area(rings):
    return abs(sum(x1 * y2 - x2 * y1 for r in rings for (x1, y1), (x2, y2) in zip(r, r[1:]))) / 2


def even_odd(rings, x, y):
    hits = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            hits += (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1)
    return hits % 2 == 1


@pytest.mark.parametrize("grid", [spatial.Grid(-1, -1, 2.5, 2.2, 6, 7), spatial.Grid(0, 0, 1, 1, 12, 12), spatial.Grid(3.3, 2, 40, 3, 1, 2)])
def test_pieces(spark, grid):
    shapes = layer(spark)
    got = spatial.overlay_pieces(shapes, ["name"], grid).collect()
    known = {(r["name"], r["id_geo"]): r["area"] for r in spatial.overlay_grid_regions(shapes, ["name"], grid).collect()}
    assert {(r["name"], r["id_geo"]) for r in got} == set(known) and len(got) == len(known)
    rng = np.random.default_rng(0)
    for r in got:
        assert r["area"] == pytest.approx(known[r["name"], r["id_geo"]], abs=1e-9)
        x0, y0 = grid.x0 + r["id_geo"] % grid.nx * grid.dx, grid.y0 + r["id_geo"] // grid.nx * grid.dy
        rings = rings_of(r["wkt"])
        assert all(ring[0] == ring[-1] and len(ring) > 3 for ring in rings)
        assert area(rings) == pytest.approx(r["area"], abs=1e-9)
        # the same points as the region has in the cell
        whole = rings_of(SHAPES[r["name"]])
        for u, v in rng.random((20, 2)):
            x, y = x0 + u * grid.dx, y0 + v * grid.dy
            assert even_odd(rings, x, y) == even_odd(whole, x, y)
    parts = {r["name"]: 0.0 for r in got}
    for r in got:
        parts[r["name"]] += r["area"]
    if grid.nx > 1:
        assert parts == {n: pytest.approx(area(rings_of(w)) if n != "two" else 9 - 1 + 8) for n, w in SHAPES.items() if n != "holed"} | {
            "holed": pytest.approx(100 - 4 - 1)
        }


def test_a_concave_outline_falls_apart(spark):
    row = layer(spark).where("name = 'comb'").select(
        rings_wkt(Line("y", F.lit(4.0), True).clip(F.col("rings"))).alias("above"),
        rings_wkt(Line("y", F.lit(4.0), False).clip(F.col("rings"))).alias("below"),
    ).first()
    # three teeth of 1 x 4 above, one shape below
    assert row["above"].startswith("MULTIPOLYGON") and row["above"].count("((") == 3 and area(rings_of(row["above"])) == 12
    assert row["below"].startswith("POLYGON") and area(rings_of(row["below"])) == 9 + 9


def test_a_cut_hole_joins_the_outline(spark):
    row = layer(spark).where("name = 'holed'").select(
        Line("x", F.lit(5.0), True).clip(F.col("rings")).alias("r"), Line("x", F.lit(1.5), False).clip(F.col("rings")).alias("s")
    )
    row = row.select("r", F.transform("r", twice_area).alias("a"), F.transform("s", twice_area).alias("b")).first()
    assert [a / 2 for a in row["a"]] == [50 - 2] and [b / 2 for b in row["b"]] == [15 - 0.5]
