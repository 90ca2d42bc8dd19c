"""Sentiment and topic scores: a lexicon and pluggable batch scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geopanel.functions.text import TOPICS, softmax
from geopanel.skew import join_bounded

# Fixed value: the published normalising constant of the compound score.
ALPHA = 15.0
#: Tokens of a lexicon that is kept as one value.
MAX_ENTRIES = 50_000

Scorer = Callable[[Sequence[str]], np.ndarray]


def _word_table(lexicon: DataFrame, max_entries: int) -> list[dict[str, float]] | None:
    """A lexicon of up to ``max_entries`` tokens as buckets of a hash table; None if it has more."""
    summed = lexicon.where("token IS NOT NULL").groupBy("token").agg(F.sum("valence").alias("valence"))
    rows = summed.where("valence IS NOT NULL").select("token", "valence")
    width = 1 << max(0, (max_entries - 1).bit_length())
    found = rows.select("*", F.pmod(F.xxhash64("token"), F.lit(width)).alias("bucket")).limit(max_entries + 1).collect()
    if len(found) > max_entries:
        return None
    small = 1 << max(0, (len(found) - 1).bit_length())
    table: list[dict[str, float]] = [{} for _ in range(small)]
    for r in found:
        table[r["bucket"] % small][r["token"]] = float(r["valence"])
    return table


def lexicon_compound(
    df: DataFrame,
    lexicon: DataFrame,
    id_column: str = "id",
    text: str = "text",
    name: str = "compound",
    max_entries: int = MAX_ENTRIES,
    **joining,
) -> DataFrame:
    """One score in [-1, 1] per post: valence sum s over its words, s / sqrt(s² + 15).

    ``lexicon`` holds (token, valence), lower case; repeated tokens add up. Up
    to ``max_entries`` tokens travel as one value, a hash table of small maps,
    and words are summed up inside the row: no row is shuffled. A larger lexicon
    is joined with the words, frequent ones salted. Posts without any listed
    word score 0.
    """
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}']+")
    table = _word_table(lexicon, max_entries)
    if table is not None:
        value = df.sparkSession.createDataFrame([(table,)], "buckets array<map<string,double>>").scalar()

        def valence(word: Column) -> Column:
            bucket = F.get("_table", F.pmod(F.xxhash64(word), F.lit(len(table))).cast("int"))
            return F.coalesce(F.try_element_at(bucket, word), F.lit(0.0))

        s = F.aggregate(words, F.lit(0.0), lambda acc, word: acc + valence(word))
        scored = df.withColumn("_table", value).withColumn("_s", s).drop("_table")
        return scored.withColumn(name, F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + ALPHA)).drop("_s")
    tokens = df.select(id_column, F.explode(words).alias("token"))
    hits = join_bounded(tokens, lexicon.select("token", "valence"), ["token"], spread=[id_column], **joining)
    sums = hits.groupBy(id_column).agg(F.sum("valence").alias("_s"))
    s = F.coalesce(F.col("_s"), F.lit(0.0))
    return df.join(sums, id_column, "left").withColumn(name, s / F.sqrt(s * s + ALPHA)).drop("_s")


def score_batches(
    df: DataFrame,
    make_scorer: Callable[[], Scorer],
    classes: Sequence[str],
    text: str = "text",
    logits: bool = True,
    name: str = "scores",
) -> DataFrame:
    """Add an array of class scores from a caller-supplied model.

    ``make_scorer`` is called once per task and returns a function from a batch
    of texts to an (n, classes) array, so a model is loaded once and sees whole
    Arrow batches. With ``logits`` the softmax is applied by Spark.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    width = len(classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            texts = batch[text].fillna("").astype(str).tolist()
            scores = np.asarray(scorer(texts), dtype=float).reshape(len(texts), width)
            yield batch.assign(**{name: list(scores)})

    scored = df.mapInPandas(run, schema)
    return scored.withColumn(name, softmax(F.col(name))) if logits else scored


def spread_scores(df: DataFrame, columns: Sequence[str], name: str = "scores") -> DataFrame:
    """Array of scores to one column per class."""
    return df.withColumns({c: F.element_at(name, i + 1) for i, c in enumerate(columns)}).drop(name)


def three_class_scores(df: DataFrame, make_scorer: Callable[[], Scorer], prefix: str, text: str = "text") -> DataFrame:
    """Columns ``<prefix>_negative``, ``_neutral``, ``_positive``."""
    columns = [f"{prefix}_{c}" for c in ("negative", "neutral", "positive")]
    return spread_scores(score_batches(df, make_scorer, columns, text), columns)


def topic_scores(
    df: DataFrame,
    make_scorer: Callable[[], Scorer],
    text: str = "text",
    threshold: float = 0.5,
    logits: bool = True,
    classes: Sequence[str] = TOPICS,
) -> DataFrame:
    """One probability column per topic and ``label``, the printed list of topics above the threshold."""
    scored = score_batches(df, make_scorer, classes, text, logits)
    names = F.array(*[F.lit(c) for c in classes])
    pairs = F.zip_with(names, F.col("scores"), lambda n, p: F.struct(n.alias("n"), p.alias("p")))
    above = F.transform(F.filter(pairs, lambda s: s["p"] > threshold), lambda s: s["n"])
    quoted = F.transform(above, lambda n: F.concat(F.lit("'"), n, F.lit("'")))
    label = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return spread_scores(scored.withColumn("label", label), classes)


def topic_subset(df: DataFrame, topic: str, above: float = 0.5) -> DataFrame:
    """Posts whose probability of ``topic`` exceeds the limit."""
    return df.where(F.col(f"`{topic}`") > above)
