"""Hourly gridded series and their attachment to posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.functions.units import GRID_VARIABLES
from geopanel.ordered import next_in_key
from geopanel.skew import salted_join

SLICE_SECONDS = 30 * 86_400


def interpolate_linear(
    df: DataFrame,
    keys: list[str],
    value: str = "value",
    timestamp: str = "timestamp",
    step_seconds: int = 3_600,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Fill a series per key to a finer step by straight lines between its knots.

    NULL knots are left out before, so inner gaps are bridged and nothing is
    made up before the first or after the last knot; a key with one knot keeps
    that row if it is on a step. Rows come at multiples of the step only, also
    where knots lie between them: a knot and the one after it (the next slice's
    first, if it is the last of its own) give the rows from the one to the
    other. A long series is cut into slices of ``slice_seconds``, so no key has
    to fit one task.
    """
    knots = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(
        *keys, F.unix_seconds(timestamp).alias("_t"), F.col(value).cast("double").alias("_v")
    )
    followed = next_in_key(knots, keys, "_t", F.floor(F.col("_t") / F.lit(slice_seconds)), ["_v"], "_next")
    step = F.lit(step_seconds).cast("long")
    # the last knot gives its own row only
    begin, end = F.ceil(F.col("_t") / step) * step, F.coalesce(F.col("_next._t") - 1, F.col("_t"))
    spots = F.when(begin <= end, F.sequence(begin, F.greatest(end, begin), step)).otherwise(F.array().cast("array<bigint>"))
    filled = followed.select("*", F.explode(spots).alias("_at"))
    slope = (F.col("_next._v") - F.col("_v")) / F.nullif(F.col("_next._t") - F.col("_t"), F.lit(0).cast("long"))
    line = F.col("_v") + F.coalesce(slope * (F.col("_at") - F.col("_t")), F.lit(0.0))
    return filled.select(*keys, F.timestamp_seconds("_at").alias(timestamp), line.alias(value))


def widen_variables(long: DataFrame, variables: list[str] = GRID_VARIABLES, cell: str = "id") -> DataFrame:
    """(cell, timestamp, variable, value) to one column per variable, in one shuffle."""
    picks = [F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables]
    return long.groupBy(cell, "timestamp").agg(*picks)


def attach_grid_variables(
    posts: DataFrame,
    long: DataFrame,
    variables: list[str] = GRID_VARIABLES,
    cell: str = "id_geo",
    time_bin: str = "time_bin",
    **salting,
) -> DataFrame:
    """Left-join all grid variables to posts on (cell, hour).

    The variables are brought side by side first, so posts are shuffled once
    instead of once per variable; cell-hours with very many posts are salted.
    """
    wide = widen_variables(long, variables).withColumnsRenamed({"id": cell, "timestamp": time_bin})
    return salted_join(posts, wide, [cell, time_bin], "left", **salting)


def cell_mean(long: DataFrame, cell: str = "id", value: str = "value") -> DataFrame:
    """Mean over time per cell."""
    return long.groupBy(cell).agg(F.avg(value).alias("mean_value"))
