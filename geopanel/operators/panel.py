"""Analysis tables: projections, bins, standardising, region-by-day panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geopanel.functions.bins import POLLUTION_BREAKS, cut_bins
from geopanel.functions.times import local_time, weekday
from geopanel.functions.text import main_topic
from geopanel.ordered import aggregate_with_quantiles, smallest
from geopanel.skew import salted_join

# The five sentiment outcomes and the panel's weather columns.
SENTIMENTS = [
    "vader_compound",
    "roberta_positive",
    "roberta_negative",
    "bertweet_positive",
    "bertweet_negative",
]
PANEL_MEDIANS = {
    "pm25": "pm25",
    "temp_med": "temperature",
    "wind_x": "wind_x",
    "wind_y": "wind_y",
    "dewpoint": "dewpoint",
    "aod550": "aod550",
    "precip": "precipitation",
    "clouds": "clouds",
    "visibility": "visibility",
    **{s: s for s in SENTIMENTS},
}


def select_range(df: DataFrame, first: str, last: str, keep: list[str] | None = None) -> DataFrame:
    """Columns from ``first`` to ``last`` in table order, after ``keep``."""
    names = df.columns
    run = names[names.index(first) : names.index(last) + 1]
    return df.select(*[F.col(f"`{c}`") for c in [*(keep or []), *run]])


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with NULL or NaN in any (given) column."""
    return df.dropna("any", subset=columns)


def assemble_scores(posts: DataFrame, tables: list[DataFrame], on: str = "id") -> DataFrame:
    """Inner-join score tables to posts on the post id (or any other row key).

    Post ids are unique, so all tables hash to the same places and are sorted
    and merged once each.
    """
    out = posts
    for table in tables:
        out = out.join(table, on)
    return out


def add_analysis_columns(df: DataFrame, breaks: list[float] = POLLUTION_BREAKS) -> DataFrame:
    """Local time, weekday, date, hour, pollution bin, main topic and region key."""
    local = local_time(F.col("timestamp"), F.col("timezone"))
    return df.withColumns(
        {
            "local_time": local,
            "local_timebin": local_time(F.col("time_bin"), F.col("timezone")),
            "date": F.to_date(local),
            "day": weekday(F.to_date(local)),
            "day_hour": F.hour(local),
            "pm25_cat": cut_bins(F.col("pm25"), breaks),
            "main_label": main_topic(F.col("label")),
            "CNTY_UNIQUE": F.concat_ws(" ", "NAME", "STATE_NAME"),
        }
    )


def _standard(value: Column, mean: Column, sd: Column, low: Column, high: Column) -> Column:
    """(value - mean) / sd; NULL for one value or a constant column."""
    return F.when(high > low, F.try_divide(value - mean, sd))


def zscore(df: DataFrame, columns: list[str], by: list[str] | None = None, **salting) -> DataFrame:
    """Standardise columns over the whole table, or inside every group of ``by``.

    The group statistics come from one combinable aggregation. Without groups
    they are one row, read as a scalar subquery; with groups they are joined
    back with heavy groups salted, so no group is collected.
    """
    stats = [
        F.struct(
            F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("low"), F.max(c).alias("high")
        ).alias(f"_z_{c}")
        for c in columns
    ]
    if by:
        joined = salted_join(df, df.groupBy(*by).agg(*stats), by, "left", null_safe=True, **salting)
    else:
        one = df.agg(F.struct(*stats).alias("_z")).scalar()
        joined = df.withColumn("_z", one).select(*df.columns, "_z.*")
    out = joined.withColumns(
        {
            c: _standard(
                F.col(c), F.col(f"_z_{c}.mean"), F.col(f"_z_{c}.sd"), F.col(f"_z_{c}.low"), F.col(f"_z_{c}.high")
            )
            for c in columns
        }
    )
    return out.select(*df.columns)


def zscore_rows(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Group-wise z-score by window, for tables whose groups are short by construction."""
    group = Window.partitionBy(*by)
    return df.withColumns(
        {
            c: _standard(
                F.col(c),
                F.avg(c).over(group),
                F.stddev_samp(c).over(group),
                F.min(c).over(group),
                F.max(c).over(group),
            )
            for c in columns
        }
    )


def build_panel(
    df: DataFrame,
    region: str = "CNTY_UNIQUE",
    date: str = "date",
    medians: dict[str, str] = PANEL_MEDIANS,
    temperature: str | None = "temperature",
    breaks: list[float] = POLLUTION_BREAKS,
    standardize: bool = True,
    **heavy,
) -> DataFrame:
    """Region-by-day panel: post count, exact medians, temperature extremes.

    ``pm25_cat`` bins the raw median; afterwards every measure is standardised
    inside its region, which by then has one row per date. Pass a filtered ``df`` for a subset (bots, fewer states).
    """
    plain = {"num_tweets": F.count(F.lit(1))}
    if temperature:
        plain |= {"temp_max": F.max(temperature), "temp_min": F.min(temperature)}
    quantiles = {name: (column, 0.5) for name, column in medians.items()}
    panel = aggregate_with_quantiles(df, [region, date], plain, quantiles, **heavy)
    if "pm25" in medians:
        panel = panel.withColumn("pm25_cat", cut_bins(F.col("pm25"), breaks))
    panel = panel.withColumn("day", weekday(F.col(date)))
    if standardize:
        measures = [c for c in plain if c != "num_tweets"] + list(medians)
        panel = zscore_rows(panel, measures, [region])
    return panel


def sample_n(df: DataFrame, n: int, id_column: str, seed: str = "") -> DataFrame:
    """Exactly ``n`` rows without replacement, the same ones on every run.

    Rows are ranked by a hash of the id; the cut is found by counting.
    """
    digest = F.md5(F.concat(F.lit(seed), F.col(id_column).cast("string")))
    ranked = df.withColumn("_hash", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    return smallest(ranked, "_hash", id_column, n).drop("_hash")
