"""Polygon layers from WKT, and points to WKT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ring(text: Column) -> Column:
    """Points of one ring, closed if the text leaves it open."""
    points = F.transform(
        F.split(F.trim(text), r"\s*,\s*"),
        lambda p: F.struct(
            F.element_at(F.split(F.trim(p), r"\s+"), 1).cast("double").alias("x"),
            F.element_at(F.split(F.trim(p), r"\s+"), 2).cast("double").alias("y"),
        ),
    )
    first = F.slice(points, 1, 1)
    return F.when(F.element_at(points, 1) == F.element_at(points, -1), points).otherwise(
        F.concat(points, first)
    )


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, positive when counter-clockwise."""
    n = F.size(ring) - 1
    terms = F.zip_with(
        F.slice(ring, F.lit(1), n),
        F.slice(ring, F.lit(2), n),
        lambda a, b: a["x"] * b["y"] - b["x"] * a["y"],
    )
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v) / 2


def _directed(ring: Column, outer: Column) -> Column:
    """Outer rings counter-clockwise, holes clockwise."""
    turn = (signed_area(ring) > 0) != outer
    return F.when(turn, F.reverse(ring)).otherwise(ring)


def rings_from_wkt(wkt: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON text as array<array<struct<x,y>>>.

    The first ring of every polygon is its outline, the others are holes.
    """
    polygons = F.regexp_extract_all(wkt, F.lit(r"(\(\s*\([^()]*\)(?:\s*,\s*\([^()]*\))*\s*\))"), F.lit(1))

    def rings(polygon: Column) -> Column:
        texts = F.regexp_extract_all(polygon, F.lit(r"\(([^()]*)\)"), F.lit(1))
        return F.transform(texts, lambda t, i: _directed(_ring(t), i == 0))

    return F.flatten(F.transform(polygons, rings))


def read_regions(df: DataFrame, wkt_column: str = "wkt") -> DataFrame:
    """Replace the WKT column of an attribute table by rings and a bounding box."""
    ringed = df.withColumn("rings", rings_from_wkt(F.col(wkt_column))).drop(wkt_column)
    flat = F.flatten("rings")
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return ringed.withColumns(
        {
            "min_x": F.array_min(xs),
            "max_x": F.array_max(xs),
            "min_y": F.array_min(ys),
            "max_y": F.array_max(ys),
        }
    )


def exclude_regions(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Leave out regions by name (positions are not stable in a distributed table)."""
    return df.where(~F.col(column).isin(names))


def points_wkt(df: DataFrame, lon: str = "lon", lat: str = "lat", name: str = "wkt") -> DataFrame:
    """Add a WKT point column."""
    return df.withColumn(
        name, F.concat(F.lit("POINT ("), F.col(lon).cast("string"), F.lit(" "), F.col(lat).cast("string"), F.lit(")"))
    )


def write_points_wkt(df: DataFrame, path: str, lon: str = "lon", lat: str = "lat", mode: str = "errorifexists") -> None:
    """Write joined points with a WKT geometry column as parquet."""
    points_wkt(df, lon, lat).write.mode(mode).parquet(path)
