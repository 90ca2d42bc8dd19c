"""Descriptive tables. All aggregations here combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geopanel.functions.missing import present
from geopanel.functions.times import floor_hour, weekday_name
from geopanel.operators.panel import SENTIMENTS, drop_missing, zscore
from geopanel.ordered import aggregate_with_quantiles


def group_count(df: DataFrame, keys: list[str], name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def agg_mean(column: str, strict: bool = False) -> Column:
    """Mean that skips NULL and NaN, or (``strict``) is NULL as soon as one value is missing."""
    value = present(column)
    mean = F.avg(value)
    return F.when(F.count(value) == F.count(F.lit(1)), mean) if strict else mean


def group_stats(df: DataFrame, keys: list[str], column: str, **heavy) -> DataFrame:
    """Count, mean (NULL-skipping and strict), exact median, minimum, maximum per group."""
    return aggregate_with_quantiles(
        df,
        keys,
        {
            "count": F.count(F.lit(1)),
            "mean": agg_mean(column),
            "mean_strict": agg_mean(column, strict=True),
            "min": F.min(present(column)),
            "max": F.max(present(column)),
        },
        {"median": (column, 0.5)},
        **heavy,
    )


def summarize_columns(df: DataFrame, columns: list[str], keys: list[str] | None = None, **heavy) -> DataFrame:
    """Six-number summary, sample SD and missing count, one row per (key and) column."""
    keys = keys or []
    plain, quantiles = {}, {}
    for c in columns:
        plain |= {
            f"{c}|min": F.min(present(c)),
            f"{c}|mean": F.avg(present(c)),
            f"{c}|max": F.max(present(c)),
            f"{c}|sd": F.stddev_samp(present(c)),
            f"{c}|missing": F.count_if(present(c).isNull()),
        }
        quantiles |= {f"{c}|q1": (c, 0.25), f"{c}|median": (c, 0.5), f"{c}|q3": (c, 0.75)}
    wide = aggregate_with_quantiles(df, keys, plain, quantiles, **heavy)
    parts = ["min", "q1", "median", "mean", "q3", "max", "sd"]
    rows = [
        F.struct(
            F.lit(c).alias("variable"),
            *[F.col(f"`{c}|{p}`").cast("double").alias(p) for p in parts],
            F.col(f"`{c}|missing`").alias("missing"),
        )
        for c in columns
    ]
    return wide.select(*keys, F.inline(F.array(*rows)))


def corr_matrix(df: DataFrame, columns: list[str], standardized: bool = False) -> DataFrame:
    """Pearson correlations of all pairs over complete rows, as (a, b, r)."""
    complete = drop_missing(df.select(*columns))
    if standardized:
        complete = zscore(complete, columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = complete.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = []
    for a in columns:
        for b in columns:
            name = f"`{a}|{b}`" if (a, b) in pairs else f"`{b}|{a}`"
            rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(name).alias("r")))
    return one.select(F.inline(F.array(*rows)))


def grouped_corr(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Correlation of group size and group mean over all groups."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("m"))
    return groups.dropna("any", subset=["m"]).agg(
        F.corr(F.col("n").cast("double"), F.col("m")).alias("r"), F.count(F.lit(1)).alias("groups")
    )


def binned_crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per pair of bins."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("count"))


def users_per_bin(df: DataFrame, bin_column: str, user: str = "username") -> DataFrame:
    """Distinct users per bin; users without a bin form a group of their own."""
    pairs = df.select(bin_column, user).distinct()
    return pairs.groupBy(bin_column).agg(F.count(F.lit(1)).alias("users"))


def mean_se(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Mean and standard error of the mean per group."""
    return df.groupBy(*keys).agg(
        F.avg(column).alias("mean"),
        (F.stddev_samp(column) / F.sqrt(F.count(column))).alias("se"),
        F.count(column).alias("n"),
    )


def hourly_series(
    df: DataFrame,
    time_bin: str = "local_timebin",
    pm25: str = "pm25",
    sentiment: str | None = None,
    use_max: bool = False,
) -> DataFrame:
    """Posts and mean (or highest) pollution per hour, optionally with mean sentiment."""
    out = [F.count(F.lit(1)).alias("count"), (F.max(pm25) if use_max else F.avg(pm25)).alias("pm25")]
    if sentiment:
        out.append(F.avg(sentiment).alias("sentiment"))
    return df.groupBy(time_bin).agg(*out)


def region_summary(
    df: DataFrame, region: str = "CNTY_UNIQUE", pm25: str = "pm25", sentiments: list[str] = SENTIMENTS, **heavy
) -> DataFrame:
    """Whole-period rollup per region: posts, pollution mean, median and maximum, mean sentiments."""
    return aggregate_with_quantiles(
        df,
        [region],
        {
            "num_tweets": F.count(F.lit(1)),
            "mean_pollution": F.avg(pm25),
            "max_pollution": F.max(pm25),
            **{f"mean_{s}": F.avg(s) for s in sentiments},
        },
        {"median_pollution": (pm25, 0.5)},
        **heavy,
    )


def attach_population(regions: DataFrame, summary: DataFrame, region: str = "CNTY_UNIQUE", population: str = "POP2010") -> DataFrame:
    """Keep every region; add its summary, posts per head and the map's logarithms."""
    joined = regions.join(summary, region, "left")
    per_head = F.try_divide(F.col("num_tweets"), F.col(population))
    return joined.withColumns(
        {
            "tweets_pc": per_head,
            "log10_tweets": F.log10("num_tweets"),
            "ln_tweets_pc": F.when(per_head > 0, F.log(per_head)),
        }
    )


def regions_over_limit(summary: DataFrame, limit: float = 15.0, column: str = "mean_pollution") -> DataFrame:
    """How many regions exceed the limit."""
    return summary.where(F.col(column) > limit).agg(F.count(F.lit(1)).alias("regions"))


def response_curve(df: DataFrame, outcomes: list[str], pm25: str = "pm25", below: float = 75.0) -> DataFrame:
    """Mean outcomes per whole unit of pollution (rounded half to even)."""
    kept = df.where(F.col(pm25) < below)
    return kept.groupBy(F.bround(pm25, 0).cast("long").alias("int_pm")).agg(*[F.avg(o).alias(o) for o in outcomes])


def weekday_profile(df: DataFrame, measures: dict[str, str], day: str = "day") -> DataFrame:
    """Mean of standardised measures per weekday, long, with day-to-day change.

    ``measures`` maps the name of a series to its column. The change is taken
    inside a series; its first day has none.
    """
    columns = list(measures.values())
    scaled = zscore(drop_missing(df.select(day, *columns)), columns)
    means = scaled.groupBy(day).agg(*[F.avg(c).alias(name) for name, c in measures.items()])
    long = means.unpivot([day], list(measures), "variable", "value")
    # at most seven rows per series
    before = F.lag("value").over(Window.partitionBy("variable").orderBy(day))
    return long.select(
        day,
        weekday_name(F.col(day)).alias("day_name"),
        "variable",
        "value",
        before.alias("lag"),
        (F.col("value") - before).alias("diff"),
    )


def event_study(df: DataFrame, start: str, stop: str, where: Column, date: str = "date") -> DataFrame:
    """Daily polarity around an event: mean of the two models' positive and negative scores."""
    kept = df.where((F.col(date) >= F.lit(start).cast("date")) & (F.col(date) <= F.lit(stop).cast("date")) & where)
    days = kept.groupBy(date).agg(
        ((F.avg("roberta_positive") + F.avg("bertweet_positive")) / 2).alias("Positive"),
        ((F.avg("roberta_negative") + F.avg("bertweet_negative")) / 2).alias("Negative"),
    )
    return days.unpivot([date], ["Positive", "Negative"], "variable", "value")


def sentiment_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whole-table means of several columns."""
    return df.agg(*[F.avg(present(c)).alias(c) for c in columns], F.count(F.lit(1)).alias("posts"))
