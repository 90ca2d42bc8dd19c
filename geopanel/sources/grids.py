"""Gridded variables: wide tables (one column per instant) and long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.functions.text import parse_number
from geopanel.functions.times import column_instant


def grid_to_long(wide: DataFrame, value: str = "value", cell: str = "id") -> DataFrame:
    """Wide raster table to (cell, timestamp, value).

    Column names are instants; a bare date is midnight. Text values may carry
    units and are parsed as numbers.
    """
    instants = [c for c in wide.columns if c != cell]
    types = dict(wide.dtypes)
    numbers = wide.select(
        F.col(cell),
        *[
            (parse_number(F.col(f"`{c}`")) if types[c] == "string" else F.col(f"`{c}`").cast("double")).alias(c)
            for c in instants
        ],
    )
    long = numbers.unpivot([cell], [f"`{c}`" for c in instants], "timestamp", value)
    return long.withColumn("timestamp", column_instant(F.regexp_replace("timestamp", "`", "")))


def read_grid(spark: SparkSession, path: str, variable: str, cell: str = "id") -> DataFrame:
    """One variable of a long grid table stored with ``variable`` as partition column.

    The filter is on the partition column, so only that variable's files are read.
    """
    return spark.read.parquet(path).where(F.col("variable") == variable).drop("variable")


def write_grid(long: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a long grid table (with a ``variable`` column) partitioned by variable."""
    long.write.mode(mode).partitionBy("variable").parquet(path)


def select_instants(df: DataFrame, start: str, stop: str, column: str = "timestamp") -> DataFrame:
    """Time slice ``[start, stop]`` of a long grid."""
    ts = F.col(column)
    return df.where((ts >= F.lit(start).cast("timestamp")) & (ts <= F.lit(stop).cast("timestamp")))


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Replace characters outside letters, digits, dot and underscore by a dot."""
    import re

    return df.toDF(*[re.sub(r"[^A-Za-z0-9_.]", ".", c) for c in df.columns])
