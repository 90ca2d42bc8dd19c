"""Planar and spherical geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius in miles, and the ellipsoid and parallels of
# the conterminous-US equal-area projection.
EARTH_MILES = 3958.7613
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
PARALLEL_1, PARALLEL_2 = 29.5, 45.5
ORIGIN_LAT, ORIGIN_LON = 23.0, -96.0


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in miles."""
    dlat = F.sin(F.radians(lat2 - lat1) / 2)
    dlon = F.sin(F.radians(lon2 - lon1) / 2)
    a = dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlon * dlon
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def ring_edges(rings: Column) -> Column:
    """All edges of closed rings as structs (x1, y1, x2, y2)."""

    def of_ring(ring: Column) -> Column:
        starts = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
        ends = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
        return F.zip_with(
            starts,
            ends,
            lambda a, b: F.struct(
                a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
            ),
        )

    return F.flatten(F.transform(rings, of_ring))


def _on_edge(e: Column, x: Column, y: Column) -> Column:
    cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (
        (cross == 0)
        & (x >= F.least(e["x1"], e["x2"]))
        & (x <= F.greatest(e["x1"], e["x2"]))
        & (y >= F.least(e["y1"], e["y2"]))
        & (y <= F.greatest(e["y1"], e["y2"]))
    )


def _crosses(e: Column, x: Column, y: Column) -> Column:
    at = e["x1"] + F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"])
    return ((e["y1"] > y) != (e["y2"] > y)) & (x < at)


def covers(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd point-in-polygon test over all edges; the boundary counts as inside."""
    odd = F.size(F.filter(edges, lambda e: _crosses(e, x, y))) % 2 == 1
    return odd | F.exists(edges, lambda e: _on_edge(e, x, y))


def area_in_box(edges: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a polygon inside an axis-parallel box, from its edges.

    Every edge contributes the signed area between itself and the line y = y0,
    after clipping to the box: the integral of ``clamp(y - y0, 0, y1 - y0)``
    over the edge's share of [x0, x1], which has a closed form. Outer rings and
    holes must have opposite directions.
    """
    height = y1 - y0

    def integral_of_clamp(u: Column) -> Column:
        inside = F.greatest(F.least(u, height), F.lit(0.0))
        return inside * inside / 2 + height * F.greatest(u - height, F.lit(0.0))

    def share(e: Column) -> Column:
        run = e["x2"] - e["x1"]
        a = F.least(F.greatest(e["x1"], x0), x1)
        b = F.least(F.greatest(e["x2"], x0), x1)
        slope = F.coalesce(F.try_divide(e["y2"] - e["y1"], run), F.lit(0.0))
        ua = e["y1"] + slope * (a - e["x1"]) - y0
        ub = e["y1"] + slope * (b - e["x1"]) - y0
        flat = F.abs(ub - ua) < 1e-12
        level = F.greatest(F.least((ua + ub) / 2, height), F.lit(0.0))
        rise = F.try_divide(integral_of_clamp(ub) - integral_of_clamp(ua), ub - ua)
        return F.when(flat, level).otherwise(rise) * (b - a)

    return F.abs(F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + share(e)))


def _authalic(sin_lat: Column | float, e: float):
    square = (1 - e * e) * sin_lat / (1 - e * e * sin_lat * sin_lat)
    ratio = (1 - e * sin_lat) / (1 + e * sin_lat)
    log = F.log(ratio) if isinstance(sin_lat, Column) else math.log(ratio)
    return square - (1 - e * e) / (2 * e) * log


def albers_constants() -> tuple[float, float, float, float]:
    """(eccentricity, n, C, rho0) of the projection, from its published definition."""
    e = math.sqrt(2 * FLATTENING - FLATTENING * FLATTENING)

    def m(lat: float) -> float:
        s = math.sin(math.radians(lat))
        return math.cos(math.radians(lat)) / math.sqrt(1 - e * e * s * s)

    def q(lat: float) -> float:
        return _authalic(math.sin(math.radians(lat)), e)

    n = (m(PARALLEL_1) ** 2 - m(PARALLEL_2) ** 2) / (q(PARALLEL_2) - q(PARALLEL_1))
    c = m(PARALLEL_1) ** 2 + n * q(PARALLEL_1)
    rho0 = SEMI_MAJOR * math.sqrt(c - n * q(ORIGIN_LAT)) / n
    return e, n, c, rho0


def albers_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude to metres in the equal-area projection."""
    e, n, c, rho0 = albers_constants()
    q = _authalic(F.sin(F.radians(lat)), e)
    rho = SEMI_MAJOR * F.sqrt(F.lit(c) - n * q) / n
    theta = n * F.radians(lon - ORIGIN_LON)
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)
