"""A training corpus from raw documents: five stages, each one an operator of ``geopanel.llm``.

Every stage works on all rows that its predecessor kept. All but the last
return the columns of the documents table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import geopanel
from geopanel.llm import decontaminate, langid, neardup, repeats, spm
from geopanel.llm.blocks import bound_batches
from geopanel.skew import join_bounded, materialize

# ship the package with the tasks, so workers need no installed copy
cloudpickle.register_pickle_by_value(geopanel)

#: Columns of the documents table.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A passage goes wherever it repeats if it has so many bytes, or more than so many words in fewer bytes.
PASSAGE = 256
PASSAGE_WORDS = 50
#: Columns that name a row's document; rows that are delivered again share them.
SAME = ["doc_id", "text_hash"]


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``rejected`` (doc_id, text_hash) names; texts are not shuffled if it is small."""
    hashed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    return join_bounded(hashed, rejected.distinct(), SAME, "left_anti", null_safe=True).select(*COLUMNS)


def _single(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with one row for each (doc_id, text_hash) in ``repeated``, the smallest; other texts are not shuffled."""
    hashed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    others = join_bounded(hashed, repeated.select(*SAME), SAME, "left_anti", null_safe=True).select(*COLUMNS)
    again = join_bounded(hashed, repeated.select(*SAME), SAME, "left_semi", null_safe=True)
    once = again.groupBy(*SAME).agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return others.unionByName(once)


def _in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage in a session whose Python workers get small batches; executors keep memory from stage to stage."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


@_in_small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what has no identifiable language: no text, no letters, or no n-gram that any language has.

    A row that is delivered more than once (same id and text) goes on once.
    """
    counted = docs.groupBy("doc_id", F.xxhash64("text").alias("text_hash")).count()
    once = _single(docs, materialize(counted.where("count > 1"), "repeated"))
    found = langid.predict(once, langid.fit(docs), COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > 0)).select(*COLUMNS)


@_in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group that shares 0.8 of its 5-word shingles: smallest id (null last), then text hash.

    Texts without shingles stand alone and stay.
    """
    found = materialize(neardup.near_duplicates(docs.select("doc_id", "text")), "groups")
    # of a document that is delivered twice, one row stays
    again = found.where("leads AND n_shingles > 0").groupBy(*SAME).count().where("count > 1")
    return _single(_without(docs, found.where("NOT leads").select(*SAME)), materialize(again, "repeated"))


@_in_small_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out passages that also occur elsewhere (bytes or words); a document of nothing else goes."""
    kept = repeats.without_repeats(docs.select("doc_id", "text"), PASSAGE, PASSAGE_WORDS)
    cut = kept.where("n_removed > 0").select("doc_id", "text_hash", "kept_text").dropDuplicates(["doc_id", "text_hash"])
    cut = materialize(cut, "passages")
    hashed = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    untouched = join_bounded(hashed, cut.select(*SAME), SAME, "left_anti", null_safe=True).select(*COLUMNS)
    # rows with cuts, and their cuts: both are as large as what repeats
    touched = join_bounded(hashed, cut.select(*SAME), SAME, "left_semi", null_safe=True).drop("text")
    right = cut.withColumnsRenamed({k: f"_{k}" for k in SAME})
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("text_hash").eqNullSafe(F.col("_text_hash"))
    changed = touched.join(right, on).where("trim(kept_text) <> ''").withColumn("text", F.col("kept_text"))
    changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return untouched.unionByName(changed.select(*COLUMNS))


@_in_small_batches
def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item, verbatim or re-parameterised."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(docs.select("doc_id", "text"), items)
    return _without(docs, materialize(found.select("doc_id", "text_hash").distinct(), "contaminated"))


@_in_small_batches
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with what decoding them gives."""
    vocabulary = spm.load(public_tokenizers.path("piece_bpe_32k.model"))
    done = spm.encoded(docs, vocabulary, ["doc_id", "lang", "source"])
    return done.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_items", benchmark_items),
    ("pieces", pieces),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; every result is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
