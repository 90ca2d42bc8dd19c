"""The library's inputs, derived from the available tables.

There are no posts, grids or region layers among the tables, so each is built
by a deterministic rule that the SQL side repeats: posts from ``events``,
regions from ``nation``, the grid from event averages, a panel from ``orders``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.functions.units import GRID_VARIABLES
from geopanel.operators.spatial import Grid
from geopanel.sources.regions import read_regions

# 5 x 4 cells over the extent of the derived coordinates.
GRID = Grid(x0=-125.0, y0=24.0, dx=11.8, dy=6.5, nx=5, ny=4)
FINE_GRID = Grid(x0=-126.0, y0=23.0, dx=2.0, dy=1.5, nx=31, ny=19)

# One zone per region key.
ZONES = ["America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Phoenix"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scaled(event_id: Column, factor: int, modulus: int, offset: float) -> Column:
    return (event_id * factor % modulus) / 10.3 + offset


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored posts with weather and coordinates."""
    e = F.col("event_id")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return table(spark, sf_dir, "events").select(
        e.alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"),
        F.col("user_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(e % 11 == 0, "[]")
        .otherwise(F.concat(F.lit("['"), F.col("event_type"), F.lit("', 'other']")))
        .alias("label"),
        F.concat_ws(" ", "event_type", "props").alias("text"),
        (F.col("value") / 503.0).alias("vader_compound"),
        (k / 100.0).alias("percent_score"),
        (k / 101.0).alias("roberta_positive"),
        (k * 7 % 100 / 101.0).alias("roberta_negative"),
        ((k * 3 + e) % 100 / 101.0).alias("bertweet_positive"),
        ((k * 13 + 5) % 100 / 101.0).alias("bertweet_negative"),
        (F.col("value") / 5.03).alias("pm25"),
        _scaled(e, 31, 400, -5.0).alias("temperature"),
        _scaled(e, 17, 90, 0.0).alias("precipitation"),
        _scaled(e, 29, 1000, 0.0).alias("visibility"),
        _scaled(e, 41, 200, -10.0).alias("wind_x"),
        _scaled(e, 43, 170, -8.0).alias("wind_y"),
        _scaled(e, 47, 300, -8.0).alias("dewpoint"),
        _scaled(e, 59, 20, 0.0).alias("aod550"),
        _scaled(e, 61, 1000, 0.0).alias("clouds"),
        ((F.lit(2400) + e * 53 % 2600) / 100.0).alias("lat"),
        ((F.lit(-12500) + e * 37 % 5900) / 100.0).alias("lon"),
    )


def county_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with the county (nation) and state (region) of their user."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("NAME"), "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("STATE_NAME"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).drop("r_regionkey")
    rows = posts(spark, sf_dir)
    joined = rows.join(places, (F.col("user_id") % 25) == F.col("n_nationkey"))
    return joined.withColumns(
        {
            "CNTY_UNIQUE": F.concat_ws(" ", "NAME", "STATE_NAME"),
            "date": F.to_date("timestamp"),
            "time_bin": F.date_trunc("hour", "timestamp"),
        }
    )


def coordinate_text(event_id: Column) -> Column:
    """``"<lat> <lon>"`` with two decimals, built from whole hundredths."""
    north = 2400 + event_id * 53 % 2600
    west = 12500 - event_id * 37 % 5900

    def decimal(hundredths: Column) -> Column:
        whole = F.floor(hundredths / 100).cast("string")
        return F.concat(whole, F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))

    return F.concat(decimal(north), F.lit(" -"), decimal(west))


def region_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One notched box per nation in a 5 x 5 layout; even keys have a hole."""
    key = F.col("n_nationkey")
    x = F.lit(-125.0037) + 11.8 * (key % 5)
    y = F.lit(23.9963) + 5.2 * F.floor(key / 5)

    def point(dx: float, dy: float) -> Column:
        return F.format_string("%.4f %.4f", x + dx, y + dy)

    def ring(*points: tuple[float, float]) -> Column:
        return F.concat(F.lit("("), F.concat_ws(", ", *[point(*p) for p in points]), F.lit(")"))

    outline = ring((0, 0), (11.8, 0), (11.8, 5.2), (5.9, 3.1), (0, 5.2), (0, 0))
    hole = ring((2, 1), (3, 1), (3, 2), (2, 2), (2, 1))
    wkt = F.when(key % 2 == 0, F.concat(F.lit("POLYGON ("), outline, F.lit(", "), hole, F.lit(")"))).otherwise(
        F.concat(F.lit("POLYGON ("), outline, F.lit(")"))
    )
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("NAME"), wkt.alias("wkt"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_regions(region_wkt(spark, sf_dir))


def zone_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five vertical strips, one time zone each."""
    key = F.col("r_regionkey")
    left = F.lit(-125.0037) + 11.8 * key
    wkt = F.format_string(
        "POLYGON ((%.4f 20, %.4f 20, %.4f 60, %.4f 60, %.4f 20))", left, left + 11.8, left + 11.8, left, left
    )
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), key + 1)
    return read_regions(table(spark, sf_dir, "region").select(zone.alias("tzid"), wkt.alias("wkt")))


def three_hours(ts: Column) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / 10_800) * 10_800)


def grid_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-hourly values per cell and variable, with gaps: (id, variable, timestamp, value)."""
    rows = posts(spark, sf_dir).select(
        (F.col("id") % 20).alias("id"),
        three_hours(F.col("timestamp")).alias("timestamp"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(v).alias("variable"), F.col(v).alias("value"))
                    for v in GRID_VARIABLES
                ]
            )
        ),
    )
    return rows.groupBy("id", "variable", "timestamp").agg(F.avg("value").alias("value"))


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as regression rows: y, x1, z1, z2, nation, date, weight."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_lines"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        "o_orderkey",
        (F.col("o_totalprice") / 1000.0).alias("y"),
        (F.col("c_acctbal") / 1000.0).alias("x1"),
        (F.col("o_orderkey") % 7).cast("double").alias("x2"),
        (F.col("o_totalprice") / 2000.0 + F.col("o_orderkey") % 13).alias("endog"),
        (F.col("o_orderkey") % 13).cast("double").alias("z1"),
        (F.col("o_orderkey") % 29).cast("double").alias("z2"),
        F.col("c_nationkey").alias("nation"),
        F.to_date("o_orderdate").alias("date"),
        "o_orderstatus",
        (F.coalesce("_lines", F.lit(0)) + 1).cast("double").alias("weight"),
    )
