"""Toxicity by weak supervision.

Many voters say whether a text looks toxic: lexicon entries (words and word
beginnings found in labelled texts), patterns, and the recorded label itself. A
generative label model estimates every voter's hit and false-alarm rates by
expectation maximisation, without trusting any voter alone, and the residual
correlation between voters, by which the evidence of voters that repeat each
other is discounted. Its posterior labels train a logistic regression over the
lexicon and the patterns, which scores every text.

Everything is learned from at most ``FIT_ROWS`` labels, those with the smallest
hashes of their id. This list is therefore safe to broadcast to the texts,
which are not shuffled; a text of the sample reaches the driver as the few
lexicon numbers that it contains. Every text is scored.

Cases: a null or empty text gets the score of a text without any voter; with no
labelled row of either kind every score is the share of toxic labels (0.5
without any); ties between lexicon entries go to the smaller hash; repeated
rows are scored one by one; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.ordered import smallest
from geopanel.skew import materialize

from .blocks import LOWER, blocks, prefix_hashes, raw, span_hashes, text_array

#: Bounds of what the driver sees: lexicon entries, and labelled rows of the fit.
LEXICON = 4096
FIT_ROWS = 40_000
#: An entry occurs in as many toxic texts at least, and is so much more frequent there.
LEAST_TEXTS, LEAST_RATIO = 3, 4.0
#: Word beginnings, in bytes, that are entries beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Lexicon entries that vote in the label model.
VOTERS = 64
PATTERNS = ("shouting", "exclaiming", "repeating")

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    """Sorted entry hashes, their weights, pattern weights and intercept."""

    entries: np.ndarray
    weights: np.ndarray
    patterns: np.ndarray
    bias: float


def _lowered(texts: pa.Array) -> pa.Array:
    return pa.array([t.lower() for t in texts.to_pylist()], pa.large_string())


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, entry hash) pairs of words and word beginnings."""
    data, at = raw(_lowered(texts))
    letter = _LETTER[data]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    joined = letter[1:] & letter[:-1] & (owner[1:] == owner[:-1])
    start = np.flatnonzero(letter & np.concatenate([[True], ~joined]))
    end = np.flatnonzero(letter & np.concatenate([~joined, [True]])) + 1
    sums = prefix_hashes(data)
    of, hashes = [owner[start]], [span_hashes(sums, start, end)]
    for k in BEGINNINGS:
        long = end - start > k
        of.append(owner[start[long]])
        hashes.append(span_hashes(sums, start[long], start[long] + k) ^ np.uint64(k))
    of, hashes = np.concatenate(of), np.concatenate(hashes)
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return of[new], hashes[new]


def patterns(texts: pa.Array) -> np.ndarray:
    """One row a text: share of capitals, of exclamation marks, of doubled bytes."""
    data, at = raw(texts)
    n = np.maximum(np.diff(at), 1)[:, None]
    same = np.zeros(len(data), bool)
    same[1:] = data[1:] == data[:-1]
    marks = np.stack([(data >= 65) & (data < 91), data == 33, same], 1).astype(np.int64)
    sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(marks, 0)])
    return (sums[at[1:]] - sums[at[:-1]]) / n


def entry_counts(rows: DataFrame) -> DataFrame:
    """(entry, toxic, clean): texts of either label that contain each entry.

    ``rows`` has text and toxic. Every task adds up its own rows first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            h, back = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return h, *(np.bincount(back, weights=np.concatenate([x[i] for x in held])) for i in (1, 2))

        for part in blocks(batches):
            of, h = features(text_array(part))
            y = part.column("toxic").to_numpy(zero_copy_only=False).astype(float)[of]
            held.append((h, y, 1 - y))
            if len(held) > 8:
                held = [merged()]
        if held:
            h, t, c = merged()
            for i in range(0, len(h), 100_000):
                s = slice(i, i + 100_000)
                yield pa.record_batch(
                    [pa.array(h[s].view(np.int64)), pa.array(t[s].astype(np.int64)), pa.array(c[s].astype(np.int64))],
                    ["entry", "toxic", "clean"],
                )

    counted = rows.select("text", "toxic").mapInArrow(count, "entry long, toxic long, clean long")
    return counted.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _hits(texts: pa.Array, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    of, h = features(texts)
    if not len(entries):
        return of[:0], np.zeros(0, np.int64)
    i = np.minimum(np.searchsorted(entries, h), len(entries) - 1)
    hit = entries[i] == h
    return of[hit], i[hit]


def label_model(votes: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the positive class and the evidence weight of each voter.

    ``votes`` is rows x voters in {0, 1}. Rates start from agreement with the
    last voter and are re-estimated by expectation maximisation; voters whose
    residuals correlate share their evidence.
    """
    post = np.clip(votes[:, -1] * 0.9 + 0.05, 0, 1)
    share = np.ones(votes.shape[1])
    for _ in range(rounds):
        hit = (post @ votes + 1) / (post.sum() + 2)
        alarm = ((1 - post) @ votes + 0.1) / ((1 - post).sum() + 2)
        residual = votes - post[:, None] * hit - (1 - post[:, None]) * alarm
        spread = np.sqrt((residual**2).mean(0)) + 1e-9
        corr = np.abs(residual.T @ residual) / len(votes) / np.outer(spread, spread)
        np.fill_diagonal(corr, 0)
        share = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(0))
        yes, no = np.log(hit / alarm), np.log((1 - hit) / (1 - alarm))
        score = np.log(prior / (1 - prior)) + votes @ (share * yes) + (1 - votes) @ (share * no)
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post, share


def sampled_labels(labels: DataFrame) -> DataFrame:
    """At most ``FIT_ROWS`` labels (doc_id, toxic 0/1), one for each id: those with the smallest hashes, ties by id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = materialize(known.withColumn("_hash", F.xxhash64("doc_id")), "labels")
    return smallest(known, "_hash", "doc_id", FIT_ROWS).drop("_hash")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) covers.

    Of texts that share an id the smallest is taken. The rows are written once
    and read in the order of their ids, so a fit of the same tables is the same
    however they are partitioned.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(sampled_labels(labels)), "doc_id"
    )
    rows = materialize(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "fit")
    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, t = sizes["n"], sizes["t"]
    if not t or t == n:
        p = min(max(t / n if n else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(len(PATTERNS)), float(np.log(p / (1 - p))))
    ratio = (F.col("toxic") + 0.1) / t / ((F.col("clean") + 0.1) / (n - t))
    kept = (
        entry_counts(rows)
        .where((F.col("toxic") >= LEAST_TEXTS) & (ratio >= LEAST_RATIO))
        .withColumn("gain", F.col("toxic") * F.log(ratio))
        .orderBy(F.desc("gain"), "entry")
        .limit(LEXICON)
        .toPandas()
    )
    ranked = kept["entry"].to_numpy(np.int64).view(np.uint64)
    entries = np.sort(ranked)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            texts = text_array(part)
            of, i = _hits(texts, entries)
            cut = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.record_batch(
                [
                    part.column("doc_id"),
                    part.column("toxic"),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(i.astype(np.int32))),
                    pa.array(patterns(texts).tolist(), pa.list_(pa.float64())),
                ],
                ["doc_id", "toxic", "hits", "marks"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    hits = rows.mapInArrow(seen, f"doc_id {kind}, toxic int, hits array<int>, marks array<double>")
    # as many rows as labels at most
    got = hits.toPandas().sort_values("doc_id", ignore_index=True)
    y = got["toxic"].to_numpy(float)
    size = [len(x) for x in got["hits"]]
    of = np.repeat(np.arange(len(got)), size)
    hit = np.concatenate([*got["hits"], np.zeros(0)]).astype(np.int64)
    marks = np.array(got["marks"].tolist(), float).reshape(len(got), len(PATTERNS))

    first = {e: k for k, e in enumerate(ranked[:VOTERS])}
    column = np.array([first.get(e, -1) for e in entries])[hit] if len(hit) else hit
    votes = np.zeros((len(got), len(first) + len(PATTERNS) + 2), np.float64)
    votes[of[column >= 0], column[column >= 0]] = 1
    votes[:, len(first) : len(first) + len(PATTERNS)] = marks > np.quantile(marks, 0.95, axis=0)
    votes[:, -2] = np.bincount(of, minlength=len(got)) >= 3  # three entries of the whole lexicon
    votes[:, -1] = y
    post, _ = label_model(votes, t / n)

    # logistic regression on the posterior labels
    width = len(entries) + len(PATTERNS)
    w, bias = np.zeros(width), float(np.log(t / (n - t)))
    momentum, slow = np.zeros(width + 1), np.zeros(width + 1)
    count = np.maximum(np.bincount(of, minlength=len(got)), 1)
    value = 1 / np.sqrt(count)[of]
    for step in range(1, 401):
        z = bias + np.bincount(of, weights=w[hit] * value, minlength=len(got)) + marks @ w[len(entries) :]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - post) / len(got)
        g = np.concatenate([np.bincount(hit, weights=error[of] * value, minlength=len(entries)), error @ marks, [error.sum()]])
        g[:-1] += 1e-5 * w
        momentum, slow = 0.9 * momentum + 0.1 * g, 0.999 * slow + 0.001 * g * g
        move = 0.1 * (momentum / (1 - 0.9**step)) / (np.sqrt(slow / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(entries, w[: len(entries)], w[len(entries) :], float(bias))


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability that each text is toxic."""
    of, i = _hits(texts, model.entries)
    count = np.maximum(np.bincount(of, minlength=len(texts)), 1)
    z = model.bias + patterns(texts) @ model.patterns
    z = z + np.bincount(of, weights=model.weights[i] / np.sqrt(count)[of], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of every row with ``score``."""
    inner = docs.select(*columns, F.col("text").alias("_text"))
    schema = inner.drop("_text").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def renamed(source):
            for b in source:
                yield b.rename_columns([*(f"c{i}" for i in range(len(columns))), "text"])

        for part in blocks(renamed(batches)):
            out = [part.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(score_texts(text_array(part), model))], [*columns, "score"])

    return inner.mapInArrow(run, schema)
