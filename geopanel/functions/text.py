"""Text expressions: post normalising, main topic, number parsing, softmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The topic classes, in the order of their columns.
TOPICS = [
    "arts_&_culture",
    "business_&_entrepreneurs",
    "celebrity_&_pop_culture",
    "diaries_&_daily_life",
    "family",
    "fashion_&_style",
    "film_tv_&_video",
    "fitness_&_health",
    "food_&_dining",
    "gaming",
    "learning_&_educational",
    "music",
    "news_&_social_concern",
    "other_hobbies",
    "relationships",
    "science_&_technology",
    "sports",
    "travel_&_adventure",
    "youth_&_student_life",
]

# Placeholders used by the normaliser and the topic default.
USER_TAG = "@user"
LINK_TAG = "http"
NO_TOPIC = "'no_topic'"


def normalize_post(text: Column, null_as_nan: bool = False) -> Column:
    """Mask user tags and links, word by word.

    Words are separated by single spaces only, so line breaks stay inside words
    and empty words (double spaces) survive. A lone ``@`` is kept.
    ``null_as_nan`` turns NULL into the text ``nan``, as a string cast of a
    missing value does in the original data preparation.
    """
    if null_as_nan:
        text = F.coalesce(text, F.lit("nan"))

    def mask(word: Column) -> Column:
        tagged = word.startswith("@") & (F.length(word) > 1)
        return F.when(tagged, USER_TAG).when(word.startswith("http"), LINK_TAG).otherwise(word)

    return F.array_join(F.transform(F.split(text, " ", -1), mask), " ")


def main_topic(label: Column, keep_quotes: bool = True) -> Column:
    """First entry of a printed list such as ``['sports', 'music']``.

    An empty list or NULL gives ``'no_topic'``. The quote characters are part of
    the value unless ``keep_quotes`` is False.
    """
    inner = F.regexp_replace(label, r"[\[\]]", "")
    first = F.element_at(F.split(inner, ","), 1)
    topic = F.when(label.isNull() | (inner == ""), F.lit(NO_TOPIC)).otherwise(first)
    if keep_quotes:
        return topic
    return F.regexp_replace(F.trim(topic), "^'|'$", "")


def parse_number(text: Column) -> Column:
    """First number in a text that may carry units; NULL when there is none."""
    digits = F.regexp_extract(text, r"-?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", 0)
    return digits.try_cast("double")


def split_coordinates(text: Column) -> tuple[Column, Column]:
    """``"<lat> <lon>"`` to (lon, lat) doubles; unreadable parts become NULL."""
    parts = F.split(text, " ")
    lat = F.try_element_at(parts, F.lit(1)).try_cast("double")
    lon = F.try_element_at(parts, F.lit(2)).try_cast("double")
    return lon, lat


def softmax(logits: Column) -> Column:
    """Softmax of an array of doubles, shifted by its maximum.

    One-element arrays bind the array, its maximum and its total, so that each
    is computed once and the work is linear in the classes.
    """
    bound = F.transform(F.array(F.struct(logits.alias("v"), F.array_max(logits).alias("top"))), _powers)
    return F.element_at(F.transform(bound, _shares), 1)


def _powers(s: Column) -> Column:
    powers = F.transform(s["v"], lambda v: F.exp(v - s["top"]))
    return F.element_at(F.transform(F.array(powers), _with_total), 1)


def _with_total(p: Column) -> Column:
    return F.struct(p.alias("p"), F.aggregate(p, F.lit(0.0), lambda acc, v: acc + v).alias("total"))


def _shares(s: Column) -> Column:
    return F.transform(s["p"], lambda v: v / s["total"])


def argmax_label(scores: Column, classes: list[str]) -> Column:
    """Name of the class with the highest score, the first one on ties."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))


def escape_quotes(text: Column) -> Column:
    """Replace double quotes by their HTML entity."""
    return F.replace(text, F.lit('"'), F.lit("&quot;"))
