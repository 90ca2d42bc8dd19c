"""The registered queries of the subpackage, one for each operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.skew import checkpoint_dir

from . import centroids, decontaminate, exact, langid, neardup, quality, records, repeats, resample, shards, spm, token_counts, toxicity

#: The id that ends each document in the record files.
END_ID = 2
TOKEN_LIMIT = 2048
SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents")
    vocabulary = spm.load(public_tokenizers.path("piece_bpe_32k.model"))
    done = spm.encoded(docs, vocabulary, ["doc_id"])
    return done.select(
        "doc_id", "n_bytes", F.size("ids").cast("long").alias("n_pieces"), "ids_crc32", "decoded_crc32", "round_trip"
    )


def op2_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are similar."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated 400-byte strings take from every document, and the bytes of its repeated passages of over 50 words."""
    found = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), marked=50)
    found = found.withColumnRenamed("n_passage", "n_removed_words")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_removed_words")


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).drop("text_hash")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base columns and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, ["doc_id"], quality.order_rules(docs))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_consistent_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of all documents whose row counts differ by one at most."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    placed = shards.assign(rows, "doc_id", SHARDS, ["text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = table(spark, sf_dir, "documents")
    counts = token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as record files in the shared folder, and what reading them back gives."""
    folder = f"{checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = records.write(docs, path, folder, END_ID, public_tokenizers.PATTERN)
    return records.read(spark, manifest)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold(4) != 2))
    held = docs.select("doc_id", "text", (fold(4) == 2).alias("held_out"))
    return langid.predict(held, model, ["doc_id", "held_out"])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    held = docs.withColumn("held_out", fold(5) == 0)
    scored = toxicity.score(held, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal texts stays, for every document."""
    return exact.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_heap_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and sums of every kept vector."""
    found, points = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return centroids.summary(found, points)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document, and its rank in the draw towards the benchmark's texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_superminhash_dedup": op2_superminhash_dedup,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_template_decontamination": op4_template_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_consistent_shards": op6_consistent_shards,
    "op7_token_counts": op7_token_counts,
    "op8_token_records": op8_token_records,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_cuckoo_dedup": op11_cuckoo_dedup,
    "op12_heap_centroids": op12_heap_centroids,
    "op13_importance_resampling": op13_importance_resampling,
}

def centroid_sql(k: int, rounds: int, dims: int) -> str:
    """All rounds written out: nearest centroid of every vector, floor of every mean, and so on."""
    part = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m
  FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM v) ORDER BY h, v LIMIT {k})"""
    ]
    for i in range(rounds + 1):
        part.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, min((d, c)) AS best
  FROM (SELECT r, c, list_sum([(v[i] - m[i]) * (v[i] - m[i]) for i in range(1, {dims + 1})])::BIGINT AS d FROM v, c{i})
  GROUP BY r)"""
        )
        if i < rounds:
            part.append(
                f"""n{i} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT a.best[2] AS c, unnest(range(1, {dims + 1})) AS i, unnest(v.v) AS x FROM a{i} a JOIN v USING (r)) GROUP BY c, i),
l{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM n{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(l.m, o.m) AS m FROM c{i} o LEFT JOIN l{i} l ON o.c = l.c)"""
            )
    return "WITH " + ",\n".join(part) + f"""
SELECT vec_id, c::INT AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c = best[2]
"""


ORACLES: dict[str, str] = {
    "op5_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) AS l
  FROM documents),
f AS (
  SELECT r, doc_id, text, len(w) AS n_words, len(l) AS n_lines,
         length(regexp_replace(text, '[\x09-\x0D\x20]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines
  FROM d),
t AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM t) WHERE n > 1),
p AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM c, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
a AS (
  SELECT f.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM f LEFT JOIN p USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * (length(text) - length(replace(text, '!', ''))) > 3 * n_words
            OR 10 * length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > 3 * word_chars) AS kept
FROM a
""",
    "op11_cuckoo_dedup": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
""",
    "op12_heap_centroids": centroid_sql(40, 5, 64),
    "op13_importance_resampling": """
WITH texts AS (
  SELECT row_number() OVER () AS r, true AS doc, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT -row_number() OVER (), false, NULL, coalesce(text, '') FROM benchmark),
w AS (
  SELECT r, doc, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM texts),
f AS (
  SELECT r, doc, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS f FROM w),
c AS (SELECT r, doc, f, count(*) AS n FROM f GROUP BY ALL),
z AS (
  SELECT list(v ORDER BY i) AS z
  FROM (SELECT i, list_reduce(range(0, 9), lambda a, b: if(b = 0, i, if(a % 2 = 1, xor(a // 2, 3988292384), a // 2)), i) AS v
        FROM range(0, 256) t(i))),
b AS (
  SELECT f, xor(4294967295, list_reduce(
           [('0x' || h[k : k + 1])::BIGINT for k in range(1, len(h), 2)],
           lambda a, b: xor(a // 256, z[xor(a, b) % 256 + 1]), 4294967295)) % 10000 AS b
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM c)), z),
k AS (
  SELECT b, sum(n) FILTER (doc) AS s, sum(n) FILTER (NOT doc) AS t FROM c JOIN b USING (f) GROUP BY b),
g AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM k) + 10000)::DOUBLE
           / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM k) + 10000)::DOUBLE)))::BIGINT AS g
  FROM k),
m AS (
  SELECT r, sum(n) AS n, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight
  FROM c JOIN b USING (f) JOIN g USING (b) WHERE doc GROUP BY r),
s AS (
  SELECT w.r, doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
  FROM w LEFT JOIN m USING (r) WHERE doc),
p AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM s),
q AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS able
  FROM p WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * able // 100 THEN rank END AS rank
FROM p LEFT JOIN q USING (r)
""",
}
