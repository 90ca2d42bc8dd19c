"""One callable per operator: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.functions.bins import (
    COARSE_BREAKS,
    POLLUTION_BREAKS,
    SCORE_BREAKS,
    bin_index,
    cut_bins,
    interval_bounds,
)
from geopanel.functions.text import TOPICS, argmax_label, escape_quotes, main_topic, normalize_post
from geopanel.functions.times import cut_hours, weekday
from geopanel.functions.units import GRID_VARIABLES, convert_units
from geopanel.operators import bots, describe, panel, regress, score, smooth, spatial, weather
from geopanel.ordered import row_positions
from geopanel.plans import standins as src
from geopanel.sources import archives, grids, pages
from geopanel.sources import posts as post_source
from geopanel.sources import regions as region_source
from geopanel.skew import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SIX_HOURS, TWELVE_HOURS = 21_600, 43_200


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(value: Column | str) -> Column:
    """Round to six decimals; adding zero turns -0.0 into 0.0."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def rounded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: r6(F.col(f"`{c}`")) for c in columns})


def text_time(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


def text_date(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd")


# --- panel -----------------------------------------------------------------

MEDIANS = panel.PANEL_MEDIANS


def topical_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.county_posts(spark, sf_dir).withColumn("main_label", main_topic(F.col("label")))
    return rows.where(F.col("main_label") != "'no_topic'")


@query
def panel_zscore_flagship(spark, sf_dir):
    rows = panel.build_panel(topical_posts(spark, sf_dir), medians=MEDIANS)
    daily = rows.groupBy("date").agg(
        F.sum("num_tweets").alias("num_tweets"),
        *[F.avg(c).alias(c) for c in [*MEDIANS, "temp_max", "temp_min"]],
    )
    return rounded(daily.withColumn("date", text_date("date")), [*MEDIANS, "temp_max", "temp_min"])


@query
def build_panel(spark, sf_dir):
    rows = panel.build_panel(topical_posts(spark, sf_dir), medians=MEDIANS, standardize=False)
    rows = rows.withColumn("date", text_date("date")).withColumn("day", F.col("day").cast("long"))
    return rounded(rows, [*MEDIANS, "temp_max", "temp_min"])


@query
def panel_zscore(spark, sf_dir):
    rows = panel.build_panel(topical_posts(spark, sf_dir), medians=MEDIANS)
    rows = rows.select("CNTY_UNIQUE", text_date("date").alias("date"), "num_tweets", *MEDIANS)
    return rounded(rows, list(MEDIANS))


@query
def zscore_global(spark, sf_dir):
    rows = src.posts(spark, sf_dir).select("id", "pm25", "vader_compound")
    return rounded(panel.zscore(rows, ["pm25", "vader_compound"]), ["pm25", "vader_compound"])


@query
def zscore_by_user(spark, sf_dir):
    rows = src.posts(spark, sf_dir).select("id", "username", "pm25")
    return rounded(panel.zscore(rows, ["pm25"], ["username"]), ["pm25"])


# --- parsing ---------------------------------------------------------------


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text = F.concat(F.lit("post|"), F.col("event_type"), F.lit("\nline {"), F.col("props"), F.lit("}"))
    text = F.when(e % 7 == 0, F.concat(text, F.lit(' {"a":"b\tc"}'))).otherwise(text)
    filler = [F.lit(f"f{i}") for i in range(17)]
    fields = list(filler)
    fields[0], fields[3], fields[7] = text, e.cast("string"), F.concat(F.lit("u|"), F.col("user_id").cast("string"))
    fields[9] = (e % 2).cast("string")
    fields[10], fields[11] = (e % 50).cast("string"), (e % 70).cast("string")
    fields[16] = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    whole = F.concat_ws("\t", *fields)
    short = F.concat_ws("\t", *fields[:16])
    bare = F.concat(F.lit("no tabs {"), e.cast("string"), F.lit("}"))
    value = F.when(e % 5 == 0, short).when(e % 23 == 0, bare).otherwise(whole)
    return src.table(spark, sf_dir, "events").select(value.alias("value"))


@query
def parse_posts(spark, sf_dir):
    return post_source.parse_posts(raw_records(spark, sf_dir))


@query
def parse_reject_counts(spark, sf_dir):
    return post_source.parse_rejects(raw_records(spark, sf_dir))


@query
def parsed_points(spark, sf_dir):
    rows = src.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_id") % 8 != 0).cast("int").alias("geo_available"),
        F.when(F.col("event_id") % 50 == 3, "n/a").otherwise(src.coordinate_text(F.col("event_id"))).alias("coordinates"),
        F.concat_ws(" ", "event_type", F.lit("zone")).alias("place"),
    )
    points = spatial.parse_coordinates(rows.where(F.col("geo_available") == 1))
    return panel.drop_missing(points).withColumnRenamed("place", "region").drop("geo_available")


# --- files written to the shared folder and read again ---------------------


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def raw_dump(spark, sf_dir):
    path = own_folder(spark, "dump")
    post_source.write_raw_posts(raw_records(spark, sf_dir), path)
    return post_source.parse_posts(post_source.read_raw_posts(spark, path))


@query
def delimited_table(spark, sf_dir):
    e = F.col("event_id")
    rows = src.table(spark, sf_dir, "events").select(
        e.cast("string").alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.concat(F.col("event_type"), F.when(e % 3 == 0, F.lit("\n|")).otherwise(F.lit(" ")), F.col("props")).alias("text"),
        (e % 2).cast("string").alias("geo_available"),
        F.when(e % 5 != 0, src.coordinate_text(e)).alias("coordinates"),
    )
    path = own_folder(spark, "delimited")
    post_source.write_delimited(rows, path)
    return post_source.read_delimited(spark, path, post_source.POSTS)


@query
def delimited_single_lines(spark, sf_dir):
    """Without line breaks in fields, files are split."""
    rows = src.posts(spark, sf_dir).select("id", "username", F.col("text"), "pm25")
    path = own_folder(spark, "lines")
    post_source.write_delimited(rows, path)
    return rounded(post_source.read_delimited(spark, path, rows.schema, multi_line=False), ["pm25"])


@query
def saved_table(spark, sf_dir):
    rows = src.posts(spark, sf_dir).select("id", "username", "pm25", F.to_date("timestamp").alias("date"))
    path = own_folder(spark, "table")
    post_source.write_table(rows, path, ["date"])
    days = post_source.read_table(spark, path).groupBy("date")
    counts = days.agg(F.count(F.lit(1)).alias("posts"), F.min("username").alias("first"), F.avg("pm25").alias("pm25"))
    return rounded(counts.withColumn("date", text_date("date")), ["pm25"])


#: Ids of an archive of the query below, and of one of its members.
ARCHIVE_IDS, MEMBER_IDS = 1_000, 300


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """One zip archive of .txt members for every ``ARCHIVE_IDS`` ids (doc_id), on the executors."""

    def write(group: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        ids = group["doc_id"].sort_values()
        archive = int(ids.iloc[0]) // ARCHIVE_IDS
        files, inner = fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")
        files.create_dir(inner, recursive=True)
        with files.open_output_stream(f"{inner}/{archive}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for member, part in ids.groupby(ids // MEMBER_IDS):
                z.writestr(f"{archive}/{member}_ID.txt", "".join(f"{i}{' ' * (i % 3)}\t\r\n" for i in part))
            z.writestr("readme.md", "no ids\n")
        return pd.DataFrame({"archive": [archive], "ids": [len(ids)]})

    keyed = rows.select("doc_id", F.floor(F.col("doc_id") / ARCHIVE_IDS).alias("archive"))
    return keyed.groupBy("archive").applyInPandas(write, "archive long, ids long")


@query
def id_archives(spark, sf_dir):
    path = own_folder(spark, "archives")
    write_archives(src.table(spark, sf_dir, "documents").select("doc_id"), path).count()
    return archives.read_id_archives(spark, path).select("file", "line", "id")


@query
def safe_names(spark, sf_dir):
    """Topic columns under names of safe characters, one row for each."""
    names = [c for c in TOPICS if "&" in c]
    safe = grids.sanitize_columns(scored_topics(spark, sf_dir).select("doc_id", *[f"`{c}`" for c in names]))
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), r6(F.col(f"`{c}`")).alias("p")) for c in safe.columns[1:]])
    return safe.select("doc_id", F.inline(pairs))


@query
def row_key_scores(spark, sf_dir):
    """Score tables without ids, joined on the row's position in each file."""
    rows = src.posts(spark, sf_dir).withColumn("file", F.lit("posts"))
    rows = row_positions(rows, ["file"], "id", 4096, "X1")
    base = rows.select("X1", "username", "vader_compound")
    roberta = rows.where(F.col("id") % 10 != 1).select("X1", "roberta_positive", "roberta_negative")
    topics = rows.where(F.col("id") % 10 != 3).select("X1", "label")
    joined = panel.assemble_scores(base, [roberta, topics], on="X1")
    return rounded(joined, ["vader_compound", "roberta_positive", "roberta_negative"])


# --- text and scores -------------------------------------------------------


@query
def normalize_posts(spark, sf_dir):
    docs = src.table(spark, sf_dir, "documents")
    tagged = F.concat(F.lit("@ @"), F.col("source"), F.lit("  "), F.col("text"), F.lit(" http://x/"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", normalize_post(tagged).alias("text"))


@query
def escape_post_quotes(spark, sf_dir):
    return src.table(spark, sf_dir, "events").select("event_id", escape_quotes(F.col("props")).alias("text"))


@query
def main_topic_per_post(spark, sf_dir):
    return src.posts(spark, sf_dir).select("id", main_topic(F.col("label")).alias("main_label"))


# A small lexicon of frequent words.
LEXICON = [
    ("the", 1.5), ("of", -0.5), ("and", 0.7), ("to", -1.2), ("le", 1.1), ("la", -0.4),
    ("und", 0.9), ("der", -1.6), ("el", 2.1), ("de", -0.8), ("que", 0.3), ("is", 1.9),
]


@query
def lexicon_compound(spark, sf_dir):
    docs = src.table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = spark.createDataFrame(LEXICON, "token string, valence double")
    scored = score.lexicon_compound(docs, lexicon, "doc_id")
    return scored.select("doc_id", r6("compound").alias("compound"))


def length_scorer() -> score.Scorer:
    """A deterministic stand-in for a three-class model."""

    def run(texts: Sequence[str]) -> np.ndarray:
        n = np.array([len(t) for t in texts])
        return np.stack([n % 7, n % 5, n % 3], axis=1).astype(float)

    return run


def topic_scorer() -> score.Scorer:
    """A deterministic stand-in for a 19-class model."""

    def run(texts: Sequence[str]) -> np.ndarray:
        n = np.array([len(t) for t in texts])[:, None]
        return (n * (np.arange(19) + 3) % 11) / 2.0

    return run


@query
def score_batches_softmax(spark, sf_dir):
    docs = src.table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["model_negative", "model_neutral", "model_positive"]
    scored = score.three_class_scores(docs, length_scorer, "model")
    best = argmax_label(F.array(*names), ["negative", "neutral", "positive"])
    return rounded(scored.withColumn("best", best).drop("text"), names)


def scored_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score.topic_scores(docs, topic_scorer, threshold=0.15).drop("text")


@query
def topic_probabilities(spark, sf_dir):
    return rounded(scored_topics(spark, sf_dir), TOPICS).withColumnsRenamed({t: t.replace("_&_", "_and_") for t in TOPICS})


@query
def topic_subset(spark, sf_dir):
    kept = score.topic_subset(scored_topics(spark, sf_dir), "sports", 0.15)
    return kept.select("doc_id", r6(F.col("sports")).alias("p"), main_topic(F.col("label")).alias("main_label"))


PAGE_PATTERNS = {
    "title": r"(?s)<title[^>]*>([^<]*)</title>",
    "heading": r"(?s)<h1[^>]*>([^<]*)</h1>",
    "text": r"(?s)<p[^>]*>(.*?)</p>",
}
PAGE_LINKS = r'<a href="([^"]*)"'


@query
def extract_page_fields(spark, sf_dir):
    rows = src.table(spark, sf_dir, "pages")
    return pages.extract_post_fields(rows, patterns=PAGE_PATTERNS, image_text=PAGE_LINKS, keep=["page_id"])


# --- ids, search, joins ----------------------------------------------------


@query
def id_batches(spark, sf_dir):
    docs = src.table(spark, sf_dir, "documents").select("source", "doc_id")
    return archives.batch_ids(docs, "source", "doc_id", size=10, slice_width=256)


@query
def coverage_report(spark, sf_dir):
    docs = src.table(spark, sf_dir, "documents").select("source", "doc_id")
    report = archives.coverage_report(docs, src.table(spark, sf_dir, "labels"), "source", "doc_id")
    return rounded(report, ["ratio"])


@query
def search_posts(spark, sf_dir):
    found = pages.search_posts(
        src.posts(spark, sf_dir), "click", "2024-01-03", "2024-01-28", within=(40.768612, -111.906879, 600.0)
    )
    return found.select("id", "text", text_time("timestamp").alias("timestamp"))


@query
def assemble_scores(spark, sf_dir):
    rows = src.posts(spark, sf_dir)
    base = rows.select("id", "username", "vader_compound")
    roberta = rows.where(F.col("id") % 10 != 1).select("id", "roberta_positive", "roberta_negative")
    bertweet = panel.select_range(rows.where(F.col("id") % 10 != 2), "bertweet_positive", "bertweet_negative", ["id"])
    topics = rows.where(F.col("id") % 10 != 3).select("id", "label")
    joined = panel.assemble_scores(base, [roberta, bertweet, topics])
    return rounded(joined, panel.SENTIMENTS)


# --- bots ------------------------------------------------------------------


@query
def forward_window_stats(spark, sf_dir):
    rows = src.posts(spark, sf_dir).select("id", "username", "timestamp", "vader_compound")
    found = bots.forward_window_stats(rows, SIX_HOURS)
    return found.select("id", "posts", r6("mean").alias("mean"))


@query
def forward_window_extremes(spark, sf_dir):
    """Window means over values of very different size, relative to their own size."""
    huge, tiny = F.col("id") % 3 == 0, F.col("id") % 3 == 1
    value = F.col("vader_compound") * F.when(huge, 1e20).when(tiny, 1e-15).otherwise(1.0)
    rows = src.posts(spark, sf_dir).select("id", "username", "timestamp", value.alias("v"))
    found = bots.forward_window_stats(rows, SIX_HOURS, value="v")
    scale = F.when(F.abs("mean") > 1e10, 1e-20).when(F.abs("mean") < 1e-5, 1e15).otherwise(1.0)
    return found.select("id", "posts", r6(F.col("mean") * scale).alias("mean"))


@query
def burst_users(spark, sf_dir):
    return bots.burst_users(src.posts(spark, sf_dir), posts=5, seconds=TWELVE_HOURS)


@query
def high_volume_users(spark, sf_dir):
    return bots.high_volume_users(src.posts(spark, sf_dir), limit=5)


@query
def bot_sweep(spark, sf_dir):
    rows = src.posts(spark, sf_dir).withColumn("label", main_topic(F.col("label")))
    swept = bots.bot_sweep(rows, windows=[SIX_HOURS, TWELVE_HOURS], thresholds=[1, 2, 3, 4, 5, 5000])
    return rounded(swept.withColumn("time_window", F.col("time_window").cast("long")), ["mean_sentiment"])


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.posts(spark, sf_dir)
    return bots.flagged_users(bots.burst_users(rows, 5, TWELVE_HOURS), bots.high_volume_users(rows, 5))


@query
def flagged_users(spark, sf_dir):
    return flagged(spark, sf_dir)


@query
def humans_anti(spark, sf_dir):
    return bots.drop_users(src.posts(spark, sf_dir), flagged(spark, sf_dir)).select("id", "username")


@query
def bots_semi_means(spark, sf_dir):
    rows = src.posts(spark, sf_dir)
    kept = bots.keep_users(rows, bots.burst_users(rows, 5, TWELVE_HOURS))
    names = ["vader_compound", "roberta_positive", "bertweet_negative"]
    return rounded(describe.sentiment_means(kept, names), names)


@query
def bots_union_zscore(spark, sf_dir):
    rows = src.posts(spark, sf_dir)
    burst = bots.keep_users(rows, bots.burst_users(rows, 5, TWELVE_HOURS))
    volume = bots.keep_users(rows, bots.high_volume_users(rows, 5))
    both = panel.drop_missing(burst.unionByName(volume).select("id", "pm25", "vader_compound"))
    return rounded(panel.zscore(both, ["pm25", "vader_compound"]), ["pm25", "vader_compound"])


@query
def top_topic_per_user(spark, sf_dir):
    rows = src.posts(spark, sf_dir).withColumn("label", main_topic(F.col("label")))
    return bots.top_value(rows, ["username"], "label")


@query
def distinct_users(spark, sf_dir):
    return src.posts(spark, sf_dir).select("username").distinct()


# --- time, bins, filters ---------------------------------------------------


@query
def local_time_features(spark, sf_dir):
    rows = src.county_posts(spark, sf_dir)
    zoned = spatial.attach_timezone(rows, src.zone_layer(spark, sf_dir), tile=5.0)
    zoned = zoned.withColumnRenamed("tzid", "timezone")
    out = panel.add_analysis_columns(zoned)
    return out.select(
        "id",
        "timezone",
        text_time("local_time").alias("local_time"),
        text_time("local_timebin").alias("local_timebin"),
        text_date("date").alias("date"),
        F.col("day").cast("long").alias("day"),
        F.col("day_hour").cast("long").alias("day_hour"),
        "pm25_cat",
        "main_label",
    )


@query
def hour_bins_in_range(spark, sf_dir):
    start, stop = F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    rows = src.posts(spark, sf_dir).select(cut_hours(F.col("timestamp"), start, stop).alias("time_bin"))
    counts = describe.group_count(rows, ["time_bin"], "posts")
    return counts.select(text_time("time_bin").alias("time_bin"), "posts")


@query
def cut_bins_hist(spark, sf_dir):
    rows = src.posts(spark, sf_dir).select(cut_bins(F.col("pm25"), POLLUTION_BREAKS).alias("pm25_cat"))
    return describe.group_count(rows, ["pm25_cat"])


@query
def coarse_bins_hist(spark, sf_dir):
    rows = src.posts(spark, sf_dir).select(cut_bins(F.col("pm25") * 2 - 3, COARSE_BREAKS).alias("pm25_cat"))
    return describe.group_count(rows, ["pm25_cat"])


@query
def users_per_bin(spark, sf_dir):
    rows = src.posts(spark, sf_dir).withColumn("pm25_cat", cut_bins(F.col("pm25"), POLLUTION_BREAKS))
    return describe.users_per_bin(rows, "pm25_cat")


@query
def binned_crosstab(spark, sf_dir):
    rows = src.posts(spark, sf_dir).select(
        cut_bins(F.col("percent_score"), SCORE_BREAKS).alias("roberta_cat"),
        cut_bins(F.col("bertweet_positive"), SCORE_BREAKS).alias("bertweet_cat"),
    )
    return describe.binned_crosstab(rows, "roberta_cat", "bertweet_cat")


@query
def interval_label_sort(spark, sf_dir):
    rows = src.posts(spark, sf_dir).select(cut_bins(F.col("pm25"), POLLUTION_BREAKS).alias("name"))
    counts = describe.group_count(rows, ["name"])
    lo, hi = interval_bounds(F.col("name"))
    bounded = counts.withColumns({"start": lo, "end": hi})
    return bounded.orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))


@query
def filter_regions_dates(spark, sf_dir):
    rows = region_source.exclude_regions(src.county_posts(spark, sf_dir), "NAME", ["NATION_3", "NATION_7"])
    kept = rows.where(
        F.col("CNTY_UNIQUE").contains("AM")
        & F.col("date").between(F.lit("2024-01-03").cast("date"), F.lit("2024-01-20").cast("date"))
        & (F.col("vader_compound") != 0)
        & (F.col("pm25") < 75)
    )
    return kept.select("id", "CNTY_UNIQUE", text_date("date").alias("date"))


# --- descriptives ----------------------------------------------------------


@query
def group_stats(spark, sf_dir):
    rows = src.posts(spark, sf_dir)
    rows = rows.withColumn("measure", F.when((F.col("id") % 97 != 0) | (F.col("user_id") % 2 == 0), F.col("pm25")))
    stats = describe.group_stats(rows, ["username"], "measure")
    return rounded(stats, ["mean", "mean_strict", "min", "max", "median"])


@query
def group_stats_heavy(spark, sf_dir):
    # the same operator with every topic treated as a heavy group
    rows = src.posts(spark, sf_dir).withColumn("label", main_topic(F.col("label")))
    stats = describe.group_stats(rows, ["label"], "pm25", min_rows=1)
    return rounded(stats, ["mean", "mean_strict", "min", "max", "median"])


@query
def summary_stats(spark, sf_dir):
    rows = src.posts(spark, sf_dir).withColumn("pm25", F.when(F.col("id") % 10 != 0, F.col("pm25")))
    stats = describe.summarize_columns(rows, ["pm25", "vader_compound", "temperature"])
    return rounded(stats, ["min", "q1", "median", "mean", "q3", "max", "sd"])


@query
def summary_posts_per_user(spark, sf_dir):
    counts = describe.group_count(src.posts(spark, sf_dir), ["username"])
    stats = describe.summarize_columns(counts, ["count"])
    return rounded(stats, ["min", "q1", "median", "mean", "q3", "max", "sd"])


@query
def corr_matrix(spark, sf_dir):
    return rounded(describe.corr_matrix(src.posts(spark, sf_dir), panel.SENTIMENTS), ["r"])


@query
def corr_matrix_standardized(spark, sf_dir):
    return rounded(describe.corr_matrix(src.posts(spark, sf_dir), panel.SENTIMENTS[:3], standardized=True), ["r"])


@query
def grouped_corr(spark, sf_dir):
    rows = src.county_posts(spark, sf_dir)
    return rounded(describe.grouped_corr(rows, ["time_bin", "STATE_NAME"], "pm25"), ["r"])


@query
def mean_se(spark, sf_dir):
    rows = src.county_posts(spark, sf_dir)
    return rounded(describe.mean_se(rows, ["CNTY_UNIQUE"], "vader_compound"), ["mean", "se"])


def summarized_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.region_summary(src.county_posts(spark, sf_dir), "NAME")


@query
def region_summary(spark, sf_dir):
    summary = summarized_regions(spark, sf_dir)
    return rounded(summary, [c for c in summary.columns if c not in ("NAME", "num_tweets")])


@query
def region_population(spark, sf_dir):
    customers = src.table(spark, sf_dir, "customer")
    heads = customers.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("POP2010"))
    nation = src.table(spark, sf_dir, "nation")
    layer = nation.join(heads, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_name").alias("NAME"), "POP2010"
    )
    # regions without posts must survive
    summary = summarized_regions(spark, sf_dir).where(F.col("NAME") != "NATION_4").select("NAME", "num_tweets")
    joined = describe.attach_population(layer, summary, "NAME")
    return rounded(joined, ["POP2010", "num_tweets", "tweets_pc", "log10_tweets", "ln_tweets_pc"])


@query
def regions_over_limit(spark, sf_dir):
    return describe.regions_over_limit(summarized_regions(spark, sf_dir), 9.5)


@query
def hourly_series(spark, sf_dir):
    rows = src.county_posts(spark, sf_dir)
    series = describe.hourly_series(rows, "time_bin", sentiment="vader_compound", use_max=True)
    return rounded(series.withColumn("time_bin", text_time("time_bin")), ["pm25", "sentiment"])


@query
def hourly_series_topic(spark, sf_dir):
    rows = src.county_posts(spark, sf_dir).where(main_topic(F.col("label")) == "'click'")
    series = describe.hourly_series(rows, "time_bin")
    return rounded(series.withColumn("time_bin", text_time("time_bin")), ["pm25"])


@query
def weekday_profile_diff(spark, sf_dir):
    rows = src.county_posts(spark, sf_dir).withColumn("day", weekday(F.col("date")))
    measures = {"RoBERTa": "roberta_positive", "BERTweet": "bertweet_positive", "VADER": "vader_compound"}
    profile = describe.weekday_profile(rows, measures)
    return rounded(profile.withColumn("day", F.col("day").cast("long")), ["value", "lag", "diff"])


@query
def response_curve(spark, sf_dir):
    names = ["vader_compound", "roberta_positive", "bertweet_positive"]
    return rounded(describe.response_curve(src.posts(spark, sf_dir), names), names)


@query
def event_study_topic(spark, sf_dir):
    rows = src.county_posts(spark, sf_dir).withColumn("main_label", main_topic(F.col("label")))
    measures = panel.SENTIMENTS
    scaled = panel.zscore(rows, measures)
    study = describe.event_study(scaled, "2024-01-03", "2024-01-11", F.col("main_label") == "'view'")
    return rounded(study.withColumn("date", text_date("date")), ["value"])


@query
def event_study_place(spark, sf_dir):
    rows = src.county_posts(spark, sf_dir)
    scaled = panel.zscore(rows, panel.SENTIMENTS)
    study = describe.event_study(scaled, "2024-01-10", "2024-01-20", F.col("CNTY_UNIQUE").contains("ASIA"))
    return rounded(study.withColumn("date", text_date("date")), ["value"])


@query
def sample_n(spark, sf_dir):
    return panel.sample_n(src.posts(spark, sf_dir).select("id", "username"), 500, "id", seed="s")


# --- grid ------------------------------------------------------------------


def wide_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide raster table: one text column per three-hour instant, values with units."""
    names = ["2024-01-02"] + [f"2024-01-02 {h:02d}:00:00" for h in range(3, 24, 3)]
    slot = F.floor(F.hour("timestamp") / 3)
    value = [F.max(F.when(slot == i, F.col("user_id") * 3 + F.col("id") % 7)) for i in range(8)]
    texts = [F.concat(v.cast("string"), F.lit(".5 [ug m-3]")).alias(n) for v, n in zip(value, names)]
    return src.posts(spark, sf_dir).groupBy((F.col("id") % 20).alias("id")).agg(*texts)


@query
def grid_long(spark, sf_dir):
    long = grids.grid_to_long(wide_grid(spark, sf_dir), "pm25")
    return long.withColumn("timestamp", text_time("timestamp"))


@query
def wide_grid_midnight(spark, sf_dir):
    long = grids.grid_to_long(wide_grid(spark, sf_dir), "pm25")
    return long.where(F.hour("timestamp") == 0).select("id", text_time("timestamp").alias("timestamp"), "pm25")


@query
def grid_units(spark, sf_dir):
    series = src.grid_series(spark, sf_dir)
    # concentrations arrive in kg
    raw = F.when(F.col("variable") == "pm25", F.col("value") / 1e9).otherwise(F.col("value"))
    value = convert_units(F.col("variable"), raw, kelvin=272.15)
    return series.select("id", "variable", text_time("timestamp").alias("timestamp"), r6(value).alias("value"))


@query
def grid_slice(spark, sf_dir):
    series = src.grid_series(spark, sf_dir).where(F.col("variable") == "pm25")
    part = grids.select_instants(series, "2024-01-05", "2024-01-07 21:00:00")
    return part.select("id", text_time("timestamp").alias("timestamp"), r6("value").alias("value"))


@query
def interpolate_hourly(spark, sf_dir):
    series = src.grid_series(spark, sf_dir)
    hourly = weather.interpolate_linear(series, ["id", "variable"], slice_seconds=5 * 86_400)
    return hourly.select("id", "variable", text_time("timestamp").alias("timestamp"), r6("value").alias("value"))


@query
def interpolate_off_step(spark, sf_dir):
    """Knots at seven past the hour, rows at whole hours."""
    series = src.grid_series(spark, sf_dir).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL '7' MINUTE"))
    hourly = weather.interpolate_linear(series, ["id", "variable"], slice_seconds=5 * 86_400)
    return hourly.select("id", "variable", text_time("timestamp").alias("timestamp"), r6("value").alias("value"))


@query
def grid_attach(spark, sf_dir):
    hourly = weather.interpolate_linear(src.grid_series(spark, sf_dir), ["id", "variable"])
    rows = src.posts(spark, sf_dir).select("id", "lon", "lat", F.date_trunc("hour", "timestamp").alias("time_bin"))
    placed = spatial.assign_grid_cell(rows, src.GRID)
    names = GRID_VARIABLES
    joined = weather.attach_grid_variables(placed, hourly, names, spread=["id"])
    return rounded(joined.select("id", "id_geo", *names), names)


@query
def cell_mean(spark, sf_dir):
    series = src.grid_series(spark, sf_dir).where(F.col("variable") == "pm25")
    return rounded(weather.cell_mean(series), ["mean_value"])


# --- space -----------------------------------------------------------------


@query
def points_in_regions(spark, sf_dir):
    rows = src.posts(spark, sf_dir).select("id", "lon", "lat")
    return spatial.spatial_join_points(rows, src.regions(spark, sf_dir), ["NAME"], tile=2.0).select("id", "NAME")


@query
def points_in_regions_left(spark, sf_dir):
    rows = src.posts(spark, sf_dir).select("id", "lon", "lat")
    # a broadcast limit of zero takes the shuffled, salted way
    joined = spatial.spatial_join_points(
        rows, src.regions(spark, sf_dir), ["NAME"], tile=2.0, how="left", max_bytes=0, spread=["id"]
    )
    return joined.select("id", "NAME")


@query
def assign_grid_cell(spark, sf_dir):
    rows = src.posts(spark, sf_dir).select("id", (F.col("lon") - 3).alias("lon"), "lat")
    return spatial.assign_grid_cell(rows, src.GRID).select("id", F.col("id_geo").cast("double").alias("id_geo"))


@query
def spatiotemporal_join(spark, sf_dir):
    rows = src.posts(spark, sf_dir).select("id", "lon", "lat", src.three_hours(F.col("timestamp")).alias("time_bin"))
    series = src.grid_series(spark, sf_dir).where(F.col("variable") == "pm25").drop("variable")
    joined = spatial.spatiotemporal_join(rows, series, src.GRID, spread=["id"])
    return joined.select("id", "id_geo", r6("value").alias("pm25"))


@query
def overlay_grid_regions(spark, sf_dir):
    pieces = spatial.overlay_grid_regions(src.regions(spark, sf_dir), ["NAME"], src.FINE_GRID)
    rows = spatial.assign_grid_cell(src.posts(spark, sf_dir).select("lon", "lat", "pm25"), src.FINE_GRID)
    cells = rows.groupBy("id_geo").agg(F.avg("pm25").alias("pm25"))
    joined = pieces.join(cells, "id_geo", "left")
    weighted = joined.groupBy("NAME").agg(
        F.count(F.lit(1)).alias("pieces"),
        F.sum("area").alias("area"),
        (F.sum(F.col("area") * F.col("pm25")) / F.sum(F.when(F.col("pm25").isNotNull(), F.col("area")))).alias("pm25"),
    )
    return rounded(weighted, ["area", "pm25"])


@query
def overlay_pieces(spark, sf_dir):
    """The clipped shapes, written as WKT and read again; and whether they stay in their cell."""
    grid = src.FINE_GRID
    pieces = spatial.overlay_pieces(src.regions(spark, sf_dir), ["NAME"], grid).select("NAME", "id_geo", "wkt", "share")
    again = region_source.read_regions(pieces)
    area = F.aggregate("rings", F.lit(0.0), lambda acc, r: acc + region_source.signed_area(r))
    x0 = F.lit(grid.x0) + F.col("id_geo") % grid.nx * grid.dx
    y0 = F.lit(grid.y0) + F.floor(F.col("id_geo") / grid.nx) * grid.dy
    inside = (
        (F.col("min_x") >= x0) & (F.col("max_x") <= x0 + grid.dx) & (F.col("min_y") >= y0) & (F.col("max_y") <= y0 + grid.dy)
    )
    shapes = again.select("NAME", "id_geo", area.alias("area"), "share", inside.alias("inside"))
    cells = spatial.assign_grid_cell(src.posts(spark, sf_dir).select("lon", "lat", "pm25"), grid).groupBy("id_geo")
    joined = shapes.join(cells.agg(F.avg("pm25").alias("pm25")), "id_geo", "left")
    return rounded(joined, ["area", "share", "pm25"])


@query
def project_albers(spark, sf_dir):
    rows = spatial.project_albers(src.posts(spark, sf_dir).select("id", "lon", "lat"))
    return rows.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query
def density_grid(spark, sf_dir):
    return spatial.density_grid(spatial.project_albers(src.posts(spark, sf_dir).select("lon", "lat")), 100_000.0)


@query
def points_wkt(spark, sf_dir):
    rows = src.posts(spark, sf_dir).select("id", "lon", "lat")
    return region_source.points_wkt(rows).select("id", "wkt")


@query
def regions_from_wkt(spark, sf_dir):
    layer = src.regions(spark, sf_dir)
    area = F.aggregate("rings", F.lit(0.0), lambda acc, r: acc + region_source.signed_area(r))
    layer = layer.withColumns({"area": area, "n_rings": F.size("rings").cast("long")})
    rows = src.posts(spark, sf_dir).select("lon", "lat")
    counts = spatial.spatial_join_points(rows, layer, ["NAME"], tile=2.0).groupBy("NAME").agg(F.count(F.lit(1)).alias("posts"))
    box = ["min_x", "max_x", "min_y", "max_y", "area"]
    return rounded(layer.select("NAME", "n_rings", *box).join(counts, "NAME", "left"), box)


# --- regressions -----------------------------------------------------------

FIT = ["estimate", "se", "ci_low", "ci_high"]


@query
def ols(spark, sf_dir):
    rows = regress.with_squares(src.order_panel(spark, sf_dir), ["x1"])
    table = regress.ols(rows, ["y"], ["x1", "x1_sq"]).table(spark)
    return rounded(table, ["estimate", "se"]).select("outcome", "term", "estimate", "se", "n")


@query
def ols_absorb_instant(spark, sf_dir):
    rows = src.posts(spark, sf_dir).withColumn("instant", F.date_trunc("hour", "timestamp"))
    rows = rows.where(F.col("vader_compound") != 0)
    table = regress.fe_regression(rows, ["roberta_positive"], ["pm25"], ["instant"]).table(spark)
    return rounded(table, ["estimate", "se"]).select("outcome", "term", "estimate", "se", "n")


@query
def two_stage_ls(spark, sf_dir):
    fit = regress.two_stage_ls(src.order_panel(spark, sf_dir), ["y"], ["endog"], ["x1"], ["z1", "z2"])
    table = fit.table(spark).where(F.col("term") == "endog")
    return rounded(table, ["estimate", "se"]).select("outcome", "term", "estimate", "se", "n")


@query
def fe_oneway(spark, sf_dir):
    fit = regress.fe_regression(src.order_panel(spark, sf_dir), ["y", "z2"], ["x1"], ["nation"])
    return rounded(fit.table(spark), FIT).select("outcome", "term", "estimate", "se", "n")


@query
def fe_cluster_se(spark, sf_dir):
    rows = src.order_panel(spark, sf_dir)
    fit = regress.fe_regression(rows, ["y"], ["x1"], ["nation"], cluster=["nation"], weights="weight")
    return rounded(fit.table(spark), FIT).select("outcome", "term", "estimate", "se", "n")


@query
def fe_multiway(spark, sf_dir):
    rows = src.order_panel(spark, sf_dir)
    fit = regress.fe_regression(
        rows, ["y"], ["x1"], ["nation", "date"], cluster=["nation", "date"], weights="weight"
    )
    return rounded(fit.table(spark), FIT).select("outcome", "term", "estimate", "se", "n")


@query
def fe_main(spark, sf_dir):
    """All outcomes on the standardised panel: three effects, count weights, two-way clusters."""
    rows = regress.with_squares(panel.build_panel(topical_posts(spark, sf_dir)), ["temp_med"])
    fit = regress.fe_regression(
        rows,
        panel.SENTIMENTS,
        ["pm25", "temp_med", "temp_med_sq", "precip", "visibility"],
        ["CNTY_UNIQUE", "date", "day"],
        cluster=["CNTY_UNIQUE", "date"],
        weights="num_tweets",
    )
    return rounded(fit.table(spark), FIT).select("outcome", "term", *FIT, "n")


PANEL_TERMS = ["pm25", "temp_med", "temp_med_sq", "precip", "visibility"]
POST_TERMS = ["pm25", "temperature", "temperature_sq", "precipitation", "visibility"]


def individual_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topical_posts(spark, sf_dir).withColumn("day", F.dayofweek("date"))
    return regress.with_squares(rows, ["temperature"])


@query
def fe_individual(spark, sf_dir):
    """All outcomes post by post: also user and topic effects."""
    fit = regress.fe_regression(
        individual_posts(spark, sf_dir),
        panel.SENTIMENTS,
        POST_TERMS,
        ["CNTY_UNIQUE", "date", "day", "username", "main_label"],
        cluster=["CNTY_UNIQUE", "date"],
    )
    return rounded(fit.table(spark), FIT).select("outcome", "term", *FIT, "n")


@query
def robustness_posts(spark, sf_dir):
    """Bots and without two states, each on a panel of its own; one topic post by post, and with user effects."""
    rows = individual_posts(spark, sf_dir)
    busy = bots.burst_users(rows, posts=2, seconds=600).select("username").withColumn("_bot", F.lit(True))
    marked = rows.join(busy, "username", "left")
    table = None
    for name, condition in {
        "bots": F.col("_bot").isNotNull(),
        "without_two": ~F.col("STATE_NAME").isin("AFRICA", "ASIA"),
    }.items():
        days = regress.with_squares(panel.build_panel(marked.where(condition)), ["temp_med"])
        part = regress.robustness_suite(
            days, {name: F.lit(True)}, panel.SENTIMENTS, PANEL_TERMS, ["CNTY_UNIQUE", "date", "day"],
            cluster=["CNTY_UNIQUE", "date"], weights="num_tweets",
        )
        table = part if table is None else table.unionByName(part)
    topic = F.col("main_label") == "'click'"
    both = regress.robustness_suite(
        rows, {"topic": topic}, panel.SENTIMENTS, POST_TERMS, ["CNTY_UNIQUE", "date"], cluster=["CNTY_UNIQUE", "date"]
    )
    users = regress.robustness_suite(
        rows, {"topic_users": topic}, panel.SENTIMENTS, ["pm25"], ["NAME", "date", "username"], cluster=["NAME"]
    )
    table = table.unionByName(both).unionByName(users)
    return rounded(table, FIT).select("subset", "outcome", "term", *FIT, "n")


def bin_fit(spark: SparkSession, sf_dir: str) -> regress.Fit:
    rows = src.county_posts(spark, sf_dir).withColumn("pm25_cat", cut_bins(F.col("pm25"), POLLUTION_BREAKS))
    return regress.fe_bins(
        rows, ["roberta_positive"], "pm25_cat", POLLUTION_BREAKS, [], ["CNTY_UNIQUE"], cluster=["CNTY_UNIQUE"]
    )


@query
def fe_pm_bins(spark, sf_dir):
    return rounded(bin_fit(spark, sf_dir).table(spark), FIT).select("outcome", "term", "estimate", "n")


@query
def coef_table(spark, sf_dir):
    table = regress.coef_table(bin_fit(spark, sf_dir), spark, "pm25_cat", POLLUTION_BREAKS)
    return rounded(table, FIT).select("outcome", "interval", "position", "estimate", "n")


@query
def smoothed_coefs(spark, sf_dir):
    """The bin coefficients and their limits as smooth curves over the intervals, the zero row included."""
    table = regress.coef_table(bin_fit(spark, sf_dir), spark, "pm25_cat", POLLUTION_BREAKS)
    series = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("value")) for c in ("estimate", "ci_low", "ci_high")])
    points = table.select("outcome", "position", F.inline(series))
    return rounded(smooth.loess_by_vertices(points, ["outcome", "series"], "position", "value"), ["value", "smooth"])


@query
def robustness_suite(spark, sf_dir):
    rows = src.order_panel(spark, sf_dir)
    subsets = {
        "all": F.lit(True),
        "finished": F.col("o_orderstatus") == "F",
        "without_two": ~F.col("nation").isin(3, 7),
    }
    table = regress.robustness_suite(rows, subsets, ["y"], ["x1"], ["nation"], cluster=["nation"])
    return rounded(table, FIT).select("subset", "outcome", "term", "estimate", "se", "n")


@query
def loess_curve(spark, sf_dir):
    rows = src.posts(spark, sf_dir).select(
        main_topic(F.col("label")).alias("series"),
        bin_index(F.col("pm25"), POLLUTION_BREAKS).alias("position"),
        "vader_compound",
    )
    points = rows.groupBy("series", "position").agg(F.avg("vader_compound").alias("value"))
    smoothed = smooth.loess_by_group(points, ["series"], "position", "value")
    return rounded(smoothed, ["value", "smooth"])
