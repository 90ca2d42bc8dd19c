"""Points, regions and grid cells: joins on tile keys, never on geometry pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.functions.clip import Line, rings_wkt, twice_area
from geopanel.functions.geo import albers_xy, area_in_box, covers, ring_edges
from geopanel.functions.text import split_coordinates
from geopanel.skew import BROADCAST_BYTES, HEAVY_MIN_ROWS, join_bounded, match_listed, materialize, measured_bytes, salted_join

#: Quarterings of a crowded tile.
DEPTH = 6


@dataclass(frozen=True)
class Grid:
    """A regular grid: origin (lower left), step and number of cells per axis."""

    x0: float
    y0: float
    dx: float
    dy: float
    nx: int
    ny: int


def parse_coordinates(df: DataFrame, column: str = "coordinates") -> DataFrame:
    """Replace the coordinate text by ``lon`` and ``lat``; the first token is the latitude."""
    lon, lat = split_coordinates(F.col(column))
    return df.withColumns({"lon": lon, "lat": lat}).drop(column)


def _span(low: Column, high: Column, size: float) -> Column:
    return F.sequence(
        F.floor(low / F.lit(size)).cast("long"), F.floor(high / F.lit(size)).cast("long")
    )


def region_tiles(regions: DataFrame, attributes: list[str], tile: float) -> DataFrame:
    """Tile cover of polygons: (_tx, _ty, attributes, edges that matter in the tile).

    A ray to the right from a point in the tile can only meet edges that share
    the tile's latitude band and reach its left border or beyond; all other
    edges are left out, and so are tiles without any such edge.
    """
    edges = regions.select(*attributes, "min_x", "max_x", "min_y", "max_y", ring_edges(F.col("rings")).alias("_e"))
    bands = edges.select(
        *attributes, "min_x", "max_x", "_e", F.explode(_span(F.col("min_y"), F.col("max_y"), tile)).alias("_ty")
    )
    low, high = F.col("_ty") * F.lit(tile), (F.col("_ty") + 1) * F.lit(tile)
    bands = bands.withColumn(
        "_e",
        F.filter(
            "_e",
            lambda e: (F.greatest(e["y1"], e["y2"]) >= low) & (F.least(e["y1"], e["y2"]) <= high),
        ),
    )
    tiles = bands.select(
        *attributes, "_e", "_ty", F.explode(_span(F.col("min_x"), F.col("max_x"), tile)).alias("_tx")
    )
    left = F.col("_tx") * F.lit(tile)
    tiles = tiles.withColumn("_e", F.filter("_e", lambda e: F.greatest(e["x1"], e["x2"]) >= left))
    return tiles.where(F.size("_e") > 0)


def crowded_tiles(points: DataFrame, tile: float, lon: str, lat: str, budget: int, depth: int) -> DataFrame:
    """(_tx, _ty, _split) of the tiles that are cut into quarters, and again, while they hold more than ``budget`` points.

    A histogram over the finest cells is counted once; every coarser level is a
    sum of it. ``_split`` lists the codes of all quarters that are cut further;
    such a list belongs to one tile, so it is bounded by ``4 ** depth``.
    """
    fine = _quarter(F.col(lon), F.col(lat), tile, depth)
    counts = points.groupBy(*[c.alias(n) for c, n in zip(_tile(F.col(lon), F.col(lat), tile), ("_tx", "_ty"))], fine.alias("_code")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    # a code is its parent's code, followed by two bits
    parents = counts.select("_tx", "_ty", "_code", "_n", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("_up"))
    parents = parents.withColumn("_code", F.floor(F.col("_code") / F.pow(F.lit(4.0), F.col("_up"))).cast("long"))
    sums = parents.groupBy("_tx", "_ty", "_code").agg(F.sum("_n").alias("_n")).where(F.col("_n") > budget)
    return sums.groupBy("_tx", "_ty").agg(F.collect_list("_code").alias("_split"))


def _tile(lon: Column, lat: Column, tile: float) -> tuple[Column, Column]:
    return F.floor(lon / F.lit(tile)).cast("long"), F.floor(lat / F.lit(tile)).cast("long")


def _quarter(lon: Column, lat: Column, tile: float, depth: int) -> Column:
    """Code of a point's cell ``depth`` levels below its tile: 1, then two bits for each quartering."""
    tx, ty = _tile(lon, lat, tile)
    n = 1 << depth
    # where the point lies in its tile, in cells
    ox = F.least(F.greatest(F.floor((lon / F.lit(tile) - tx) * n), F.lit(0)), F.lit(n - 1)).cast("long")
    oy = F.least(F.greatest(F.floor((lat / F.lit(tile) - ty) * n), F.lit(0)), F.lit(n - 1)).cast("long")
    code = F.lit(1).cast("long")
    for bit in reversed(range(depth)):
        code = code * 4 + (F.shiftright(ox, bit).bitwiseAND(F.lit(1)) * 2 + F.shiftright(oy, bit).bitwiseAND(F.lit(1)))
    return code


def _adapted(
    points: DataFrame, tiles: DataFrame, tile: float, lon: str, lat: str, budget: int, depth: int
) -> tuple[DataFrame, DataFrame]:
    """Points and tiles (with ``_e``) with ``_leaf``, the quadtree cell in which they meet."""
    split = materialize(crowded_tiles(points, tile, lon, lat, budget, depth), "split")
    if split.isEmpty():
        one = F.lit(1).cast("long").alias("_leaf")
        return points.withColumn("_leaf", F.lit(1).cast("long")), tiles.select("*", one)
    placed = match_listed(points, split, ["_tx", "_ty"], "left")
    fine = _quarter(F.col(lon), F.col(lat), tile, depth)
    levels = F.transform(F.sequence(F.lit(depth), F.lit(0), F.lit(-1)), lambda up: F.floor(fine / F.pow(F.lit(4.0), up)).cast("long"))
    # down from the tile itself as long as a cell is cut
    leaf = F.aggregate(
        levels,
        F.lit(0).cast("long"),
        lambda at, code: F.when((at == 0) | F.array_contains(F.col("_split"), at), code).otherwise(at),
    )
    placed = placed.withColumn("_leaf", F.when(F.col("_split").isNull(), F.lit(1).cast("long")).otherwise(leaf)).drop("_split")

    # leaves: the quarters of cut cells that are not cut themselves
    quarters = F.flatten(F.transform("_split", lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: c * 4 + q)))
    leaves = F.filter(quarters, lambda c: ~F.array_contains(F.col("_split"), c))
    cut = match_listed(tiles, split, ["_tx", "_ty"], "left")
    cut = cut.withColumn("_leaf", F.explode(F.when(F.col("_split").isNull(), F.array(F.lit(1).cast("long"))).otherwise(leaves)))
    # the bits of a code, outermost first, are the cell's place
    level = F.floor((F.length(F.bin("_leaf")) - 1) / 2).cast("int")
    bits = F.sequence(F.lit(0), F.greatest(level - 1, F.lit(0)))

    def place(shift: int) -> Column:
        def one(acc: Column, i: Column) -> Column:
            digit = F.floor(F.col("_leaf") / F.pow(F.lit(4.0), i)).cast("long") % 4
            value = F.floor(digit / 2) if shift else digit % 2
            return acc + F.when(i < level, value * F.pow(F.lit(2.0), i)).otherwise(0.0)

        return F.aggregate(bits, F.lit(0.0), one)

    width = F.lit(tile) / F.pow(F.lit(2.0), level)
    left = F.col("_tx") * F.lit(tile) + place(1) * width
    low = F.col("_ty") * F.lit(tile) + place(0) * width
    # a little wider, for points that rounding puts into the next cell
    slack = F.lit(tile * 1e-9)
    near = F.filter(
        "_e",
        lambda e: (F.greatest(e["y1"], e["y2"]) >= low - slack)
        & (F.least(e["y1"], e["y2"]) <= low + width + slack)
        & (F.greatest(e["x1"], e["x2"]) >= left - slack),
    )
    cut = cut.withColumn("_e", near).drop("_split")
    return placed, cut.where(F.size("_e") > 0)


def spatial_join_points(
    points: DataFrame,
    regions: DataFrame,
    attributes: list[str],
    lon: str = "lon",
    lat: str = "lat",
    tile: float = 0.5,
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    budget: int = HEAVY_MIN_ROWS,
    **joining,
) -> DataFrame:
    """Append the attributes of every region that covers a point.

    Points on a shared border match every region they touch. ``regions`` is a
    layer from ``read_regions``; its tiles are broadcast when their measured
    size allows it. Otherwise both sides meet on the cells of a quadtree: tiles
    with more than ``budget`` points are quartered, up to ``DEPTH`` times, and
    the points of one place that fill a cell of that depth are salted. A left
    join keeps points outside all regions once, with NULL attributes.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    tiles = region_tiles(regions, attributes, tile)
    tx, ty = _tile(F.col(lon), F.col(lat), tile)
    keyed = points.withColumns({"_tx": tx, "_ty": ty})
    # a point has one tile, so the test can be part of the join, also of a left one
    inside = covers(F.col("_e"), F.col(lon), F.col(lat))
    if measured_bytes(tiles) <= max_bytes:
        met = join_bounded(keyed, tiles, ["_tx", "_ty"], how, condition=inside, max_bytes=max_bytes)
    else:
        keyed, tiles = _adapted(keyed, tiles, tile, lon, lat, budget, DEPTH)
        met = salted_join(keyed, tiles, ["_tx", "_ty", "_leaf"], how, condition=inside, **joining)
    return met.drop("_e", "_tx", "_ty", "_leaf")


def attach_timezone(
    points: DataFrame,
    zones: DataFrame,
    zone: str = "tzid",
    lon: str = "lon",
    lat: str = "lat",
    tile: float = 0.5,
    max_bytes: int = BROADCAST_BYTES,
    budget: int = HEAVY_MIN_ROWS,
    **joining,
) -> DataFrame:
    """Name of the time zone every point lies in, one row per point.

    A point outside all zones, or without coordinates, keeps NULL; on a shared
    border the smallest name wins. All zones of a tile travel as one row, so
    every point meets one row at most. A layer beyond ``max_bytes`` meets the
    points on quadtree cells, as in :func:`spatial_join_points`.
    """
    tiles = region_tiles(zones, [zone], tile)
    tx, ty = _tile(F.col(lon), F.col(lat), tile)
    keyed, on = points.withColumns({"_tx": tx, "_ty": ty}), ["_tx", "_ty"]
    small = measured_bytes(tiles) <= max_bytes
    if not small:
        keyed, tiles = _adapted(keyed, tiles, tile, lon, lat, budget, DEPTH)
        on = [*on, "_leaf"]
    tiles = tiles.groupBy(*on).agg(F.collect_list(F.struct(F.col(zone).alias("_z"), "_e")).alias("_zones"))
    met = join_bounded(keyed, tiles, on, "left") if small else salted_join(keyed, tiles, on, "left", **joining)
    inside = F.filter("_zones", lambda z: covers(z["_e"], F.col(lon), F.col(lat)))
    name = F.array_min(F.transform(inside, lambda z: z["_z"]))
    return met.withColumn(zone, name).drop("_tx", "_ty", "_leaf", "_zones")


def _axis_cells(value: Column, origin: float, step: float, count: int, boundary: str) -> Column:
    """Cell numbers a coordinate belongs to along one axis."""
    scaled = (value - F.lit(origin)) / F.lit(step)
    cell = F.floor(scaled).cast("long")
    if boundary == "all":
        cells = F.when(scaled == cell, F.array(cell - 1, cell)).otherwise(F.array(cell))
    else:
        cells = F.array(cell)
    return F.filter(cells, lambda c: (c >= 0) & (c < count))


def assign_grid_cell(
    points: DataFrame,
    grid: Grid,
    lon: str = "lon",
    lat: str = "lat",
    name: str = "id_geo",
    boundary: str = "half_open",
) -> DataFrame:
    """Left join of points and grid cells, by arithmetic instead of geometry.

    Cell ids are row-major numbers from the grid's origin. Points outside get
    NULL. Cells are half-open; ``boundary="all"`` gives a point on a shared
    border one row per touching cell.
    """
    xs = _axis_cells(F.col(lon), grid.x0, grid.dx, grid.nx, boundary)
    ys = _axis_cells(F.col(lat), grid.y0, grid.dy, grid.ny, boundary)
    cells = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: y * grid.nx + x)))
    if boundary != "all":
        return points.withColumn(name, F.try_element_at(cells, F.lit(1)))
    return points.select("*", F.explode_outer(cells).alias(name))


def spatiotemporal_join(
    points: DataFrame,
    grid_long: DataFrame,
    grid: Grid,
    time_bin: str = "time_bin",
    lon: str = "lon",
    lat: str = "lat",
    **salting,
) -> DataFrame:
    """Inner join on (cell, instant): the pairs of a spatial join that also agree in time."""
    placed = assign_grid_cell(points, grid, lon, lat)
    right = grid_long.withColumnsRenamed({"id": "id_geo", "timestamp": time_bin})
    return salted_join(placed, right, ["id_geo", time_bin], "inner", **salting)


def overlay_grid_regions(regions: DataFrame, attributes: list[str], grid: Grid) -> DataFrame:
    """Intersection of every region with the grid cells it touches.

    One row per non-empty piece: attributes, cell id, area of the piece and its
    share of the cell. The cells come from the region's bounding box and only
    edges over a cell's column travel with it; no polygon is compared with
    another.
    """
    edges = regions.select(*attributes, "min_x", "max_x", "min_y", "max_y", ring_edges(F.col("rings")).alias("_e"))

    def cells(low: str, high: str, origin: float, step: float, count: int) -> Column:
        first = F.greatest(F.floor((F.col(low) - F.lit(origin)) / F.lit(step)), F.lit(0))
        last = F.least(F.floor((F.col(high) - F.lit(origin)) / F.lit(step)), F.lit(count - 1))
        span = F.sequence(first.cast("long"), F.greatest(last, first).cast("long"))
        return F.filter(span, lambda c: (c <= last) & (c >= 0))

    columns = edges.select(
        *attributes, "min_y", "max_y", "_e", F.explode(cells("min_x", "max_x", grid.x0, grid.dx, grid.nx)).alias("_ix")
    )
    x0 = F.lit(grid.x0) + F.col("_ix") * F.lit(grid.dx)
    x1 = F.lit(grid.x0) + (F.col("_ix") + 1) * F.lit(grid.dx)
    columns = columns.withColumn(
        "_e",
        F.filter("_e", lambda e: (F.greatest(e["x1"], e["x2"]) > x0) & (F.least(e["x1"], e["x2"]) < x1)),
    )
    boxes = columns.select(
        *attributes, "_e", "_ix", F.explode(cells("min_y", "max_y", grid.y0, grid.dy, grid.ny)).alias("_iy")
    )
    y0 = F.lit(grid.y0) + F.col("_iy") * F.lit(grid.dy)
    y1 = F.lit(grid.y0) + (F.col("_iy") + 1) * F.lit(grid.dy)
    pieces = boxes.select(
        *attributes,
        (F.col("_iy") * grid.nx + F.col("_ix")).alias("id_geo"),
        area_in_box(F.col("_e"), x0, y0, x1, y1).alias("area"),
    )
    return pieces.where(F.col("area") > 1e-12).withColumn("share", F.col("area") / F.lit(grid.dx * grid.dy))


def overlay_pieces(regions: DataFrame, attributes: list[str], grid: Grid) -> DataFrame:
    """The clipped shape of every region in every grid cell that it touches.

    One row per non-empty piece: attributes, cell id, rings, WKT, area of the
    shape and its share of the cell. A region is cut into the grid's columns
    first and each strip into cells, so an edge is looked at in the cells of its
    own column only.
    """
    small = 1e-12

    def cells(low: Column, high: Column, origin: float, step: float, count: int) -> Column:
        first = F.greatest(F.floor((low - F.lit(origin)) / F.lit(step)), F.lit(0)).cast("long")
        last = F.least(F.floor((high - F.lit(origin)) / F.lit(step)), F.lit(count - 1)).cast("long")
        return F.filter(F.sequence(first, F.greatest(last, first)), lambda c: (c <= last) & (c >= 0))

    def cut(df: DataFrame, axis: str, number: str, origin: float, step: float) -> DataFrame:
        low = F.lit(origin) + F.col(number) * F.lit(step)
        high = F.lit(origin) + (F.col(number) + 1) * F.lit(step)
        for bound, above in ((low, True), (high, False)):
            df = df.withColumn("rings", Line(axis, bound, above).clip(F.col("rings")))
        # what touches the line only leaves rings without area
        df = df.withColumn("rings", F.filter("rings", lambda r: F.abs(twice_area(r)) > 2 * small))
        return df.where(F.size("rings") > 0)

    strips = regions.select(
        *attributes, "rings", F.explode(cells(F.col("min_x"), F.col("max_x"), grid.x0, grid.dx, grid.nx)).alias("_ix")
    )
    strips = cut(strips, "x", "_ix", grid.x0, grid.dx)
    ys = F.transform(F.flatten("rings"), lambda p: p["y"])
    strips = strips.withColumns({"_low": F.array_min(ys), "_high": F.array_max(ys)})
    pieces = strips.select(
        *attributes, "rings", "_ix", F.explode(cells(F.col("_low"), F.col("_high"), grid.y0, grid.dy, grid.ny)).alias("_iy")
    )
    pieces = cut(pieces, "y", "_iy", grid.y0, grid.dy)
    area = F.aggregate("rings", F.lit(0.0), lambda acc, r: acc + twice_area(r)) / 2
    shaped = pieces.select(
        *attributes, (F.col("_iy") * grid.nx + F.col("_ix")).alias("id_geo"), "rings", rings_wkt(F.col("rings")).alias("wkt"),
        area.alias("area"),
    )
    return shaped.where(F.col("area") > small).withColumn("share", F.col("area") / F.lit(grid.dx * grid.dy))


def project_albers(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add equal-area metres ``x``, ``y``."""
    x, y = albers_xy(F.col(lon), F.col(lat))
    return df.withColumns({"x": x, "y": y})


def density_grid(df: DataFrame, resolution: float, x: str = "x", y: str = "y") -> DataFrame:
    """Points per square of side ``resolution``."""
    return df.groupBy(
        F.floor(F.col(x) / F.lit(resolution)).alias("ix"), F.floor(F.col(y) / F.lit(resolution)).alias("iy")
    ).agg(F.count(F.lit(1)).alias("points"))
