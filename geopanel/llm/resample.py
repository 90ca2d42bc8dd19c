"""Resampling towards a target by importance weights, ranked by a distributed radix sort.

Features are runs of one or two words, hashed into ``BUCKETS`` buckets. One pass
counts the buckets of the corpus and of the target; their log ratios are one
array of gains, and a second pass scores each document by the mean gain of its
features. Gumbel noise that is a function of the id turns scores into a draw
without replacement: the highest scores are the sample.

The order is made by a least-significant-digit radix sort. Rows have a place
from 0 on; a chunk is a range of places, and chunks are what tasks work on. A
pass counts every chunk's digits, turns the counts into global prefix offsets
(digit by digit, inside a digit chunk by chunk) and gives each row the place
``offset + rank among the chunk's rows of that digit``. That is stable, so after
the last digit of the composite key (score down, then id up) the places are the
ranks. A chunk has the same number of rows whatever the keys are, so equal
scores and hot digits do not gather in one task.

CRC-32 is taken of each word once, byte by byte for all words together; the
CRC of two words follows from theirs, because appending a word is a linear map.

Cases: null texts have no words; documents without features weigh 0; null ids
are drawn as empty text and come last among equal scores; repeated rows are
rows of their own; an empty table gives no rows, an empty target counts
nothing; other columns are never read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geopanel.skew import discard, materialize

from .blocks import LOWER, blocks, raw, text_array, word_spans

BUCKETS = 10_000
#: Bits of a digit.
DIGIT = 12
#: Chunks of a sort, and the most rows of one.
CHUNKS, CHUNK_ROWS = 256, 500_000
#: Words up to so many bytes go through the tables.
SHORT = 64

#: Bytes that are part of no word: ASCII but digits and letters.
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def crc_table() -> np.ndarray:
    """CRC-32 of each byte alone, without the inversions at both ends."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & np.uint32(1), (crc >> np.uint32(1)) ^ np.uint32(0xEDB88320), crc >> np.uint32(1))
    return crc


STEP = crc_table()


def _fed(crc: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return STEP[(crc ^ byte) & np.uint32(255)] ^ (crc >> np.uint32(8))


def shift_tables() -> np.ndarray:
    """[n, k, b]: what byte ``b`` at place ``k`` of a CRC becomes when ``n`` bytes are appended."""
    now = np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]
    out = [now]
    for _ in range(SHORT):
        now = _fed(now, np.uint32(0))
        out.append(now)
    return np.stack(out)


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    first, size = start[order], size[order]
    long_ = int((size > SHORT).sum())
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(size[long_]) if long_ < len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))  # sizes above k
        crc[long_:n] = _fed(crc[long_:n], data[first[long_:n] + k].astype(np.uint32))
    crc = ~crc
    for i in range(long_):
        crc[i] = zlib.crc32(data[first[i] : first[i] + size[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def pair_crcs(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """CRC-32 of the words ``first`` and ``first + 1`` joined by one blank."""
    head = ~_fed(~crc[first], np.uint32(32))
    size = (end - start)[first + 1]
    n = np.minimum(size, SHORT)
    out = crc[first + 1].copy()
    for k in range(4):
        out ^= shifts[n, k, (head >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(size > SHORT):
        word = first[i] + 1
        out[i] = zlib.crc32(data[start[word] : end[word]].tobytes(), int(head[i]))
    return out


def features(texts: pa.Array, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature, and the words of every text."""
    data, at = raw(texts)
    data = LOWER[data]
    start, end, owner = word_spans(data, at, OUTSIDE)
    crc = word_crcs(data, start, end)
    first = np.flatnonzero(owner[:-1] == owner[1:])
    both = pair_crcs(crc, data, start, end, first, shifts)
    bucket = np.concatenate([crc, both]) % np.uint32(BUCKETS)
    return bucket.astype(np.int64), np.concatenate([owner, owner[first]]), np.bincount(owner, minlength=len(at) - 1)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all ``texts`` in each bucket; each task sends one row for each bucket that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, counts = shift_tables(), np.zeros(BUCKETS, np.int64)
        for part in blocks(batches):
            counts += np.bincount(features(text_array(part), shifts)[0], minlength=BUCKETS)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio) of each bucket."""
    s, t = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array(
        [math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64
    )


def weights(docs: DataFrame, gain: np.ndarray, id_column: str = "doc_id") -> DataFrame:
    """(id column, n_words, n_features, weight) of every document."""
    inner = docs.select(F.col(id_column).cast("long").alias(id_column), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = shift_tables()
        for part in blocks(batches):
            bucket, owner, words = features(text_array(part), shifts)
            n = np.bincount(owner, minlength=part.num_rows)
            # whole numbers far below 2**53
            total = np.bincount(owner, gain[bucket].astype(np.float64), part.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                [id_column, "n_words", "n_features", "weight"],
            )

    return inner.mapInArrow(run, f"{id_column} long, n_words long, n_features long, weight long")


def noise(id_column: str, seed: int) -> Column:
    """Gumbel noise in thousandths, a function of the id."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(name, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _digits(value: Column, bits: int) -> list[Column]:
    """Digits of a number from 0 to ``2**bits - 1``, the least significant first."""
    passes = -(-bits // DIGIT)
    width = -(-bits // max(1, passes))
    return [(F.shiftrightunsigned(value, width * k)).bitwiseAND(F.lit((1 << width) - 1)).cast("int") for k in range(passes)]


def key_digits(rows: DataFrame, high: str, low: str) -> list[Column]:
    """Digits of the composite key (``high`` down, ``low`` up with nulls last), the least significant first."""
    edge = rows.agg(
        F.min(high).alias("a"), F.max(high).alias("b"), F.min(low).alias("c"), F.max(low).alias("d"), F.count("*").alias("n"),
        F.count(low).alias("m"),
    ).first()
    if not edge["n"]:
        return []
    top = (edge["b"] - edge["a"]).bit_length()
    if edge["m"] and (edge["d"] - edge["c"]).bit_length() > 62:  # as unsigned numbers
        end = _digits(F.coalesce(F.col(low), F.lit(0)).bitwiseXOR(F.lit(-(2**63))), 64)
        return [*end, *_digits(F.col(low).isNull().cast("long"), 1), *_digits(F.lit(edge["b"]) - F.col(high), top)]
    span = edge["d"] - edge["c"] + 1 if edge["m"] else 0
    end = F.coalesce(F.col(low) - F.lit(edge["c"] or 0), F.lit(span)).cast("long")
    bits = span.bit_length()
    begin = F.lit(edge["b"]) - F.col(high)
    if top + bits > 62:
        return [*_digits(end, bits), *_digits(begin, top)]
    return _digits(F.shiftleft(begin, bits).bitwiseOR(end), top + bits)


def counting_pass(rows: DataFrame, digit: Column, chunk: Column) -> DataFrame:
    """``rows`` with the places that a stable sort by ``digit`` gives them; ``chunk`` does not fall along places."""
    keyed = rows.withColumns({"_chunk": chunk, "_digit": digit}).repartition("_chunk")
    inside = Window.partitionBy("_chunk", "_digit").orderBy("place")
    ranked = keyed.withColumn("_rank", F.row_number().over(inside))
    counts = keyed.groupBy("_chunk", "_digit").agg(F.count("*").alias("_n"))
    # at most 2**DIGIT rows meet here
    totals = counts.groupBy("_digit").agg(F.sum("_n").alias("_all"))
    smaller = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_digit", F.coalesce(F.sum("_all").over(smaller), F.lit(0)).alias("_base"))
    earlier = Window.partitionBy("_digit").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    offsets = offsets.join(F.broadcast(totals), "_digit").select("_chunk", "_digit", (F.col("_base") + F.col("_before")).alias("_start"))
    moved = ranked.join(offsets, ["_chunk", "_digit"])
    return moved.withColumn("place", F.col("_start") + F.col("_rank") - 1).select(*rows.columns)


def radix_sorted(rows: DataFrame, digits: list[Column]) -> DataFrame:
    """Written ``rows`` with ``place``, 0 for the first, in the order of ``digits`` (least significant first).

    ``rows`` has a ``place`` that ``monotonically_increasing_id`` gave it when it was written.
    """
    size = max(1, min(CHUNK_ROWS, -(-rows.count() // CHUNKS)))
    # the numbers of a written partition follow each other
    chunk = F.shiftright("place", CHUNK_ROWS.bit_length() - 1)
    for number, digit in enumerate(digits or [F.lit(0)]):
        before, rows = rows, materialize(counting_pass(rows, digit, chunk), "sorted")
        if number:
            discard(before)
        chunk = F.floor(F.col("place") / F.lit(size))
    return rows


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_column: str = "doc_id"
) -> DataFrame:
    """(id column, n_features, weight, score, rank) of every row of ``docs``; rank is null where it is not drawn."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weights(docs, gain, id_column).withColumn("score", F.col("weight") + noise(id_column, seed))
    scored = materialize(scored.withColumn("place", F.monotonically_increasing_id()), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ordered = radix_sorted(able, key_digits(able, "score", id_column))
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
    columns = [id_column, "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ordered.select(*columns, rank).unionByName(rest)
