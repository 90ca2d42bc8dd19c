"""Texts as flat byte arrays, a bounded block at a time.

Python workers outlive their tasks, so what a task has freed is given back to
the machine at its end (:func:`release`). Arrow keeps the texts of a batch as one UTF-8 buffer with offsets. The
operators work on that buffer with numpy, ``BLOCK_BYTES`` at a time (one text
at least), so that the memory of a task does not grow with its partition.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Text bytes that are held as wide arrays at one time.
BLOCK_BYTES = 2_000_000
#: Bytes of a batch that Spark hands to a Python worker (one row at least).
BATCH_BYTES = "2m"
#: The same for operators that hold many wide arrays of a block at once.
SMALL_BLOCK = 256_000
#: A text of more bytes is worked on in pieces where an operator can.
LONG_TEXT = 1_000_000

#: Bytes 9-13 and 32.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
#: A second hash beside the first: 128 bits together.
BASE_2 = 0xC2B2AE3D27D4EB4F | 1
INVERSE_2 = pow(BASE_2, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64; made anew, as each task has globals of its own."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        np.multiply(out[:more], np.uint64(pow(base, have, 2**64)), out=out[have : have + more])
        have += more
    return out


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def prefix_hashes(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """Running sums from which :func:`span_hashes` takes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(base, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int = INVERSE) -> np.ndarray:
    """64-bit hash of each ``data[start:end]``; equal spans have equal hashes."""
    h = (sums[end] - sums[start]) * powers(inverse, len(sums))[start]
    return mix(h ^ (end - start).astype(np.uint64))


def release() -> None:
    """Give free memory of this process back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Batches of at most about ``BATCH_BYTES`` for the Python workers of this session; a limit that it has stays.

    Spark's own limit is 64 MB. An executor holds a batch on both sides, with
    the one before it and room to grow, once for each task. The limit is read
    when a plan runs, so it stays set.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, spark.conf.get(name, BATCH_BYTES))


def text_array(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as large strings without nulls (null: empty)."""
    column = batch.column(batch.schema.get_field_index(name))
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of texts and where each text starts, with the end."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches with a ``text`` column into parts of about ``limit`` text bytes."""
    gc.collect()  # what the worker's last task left in reference cycles
    batch = None
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw(text_array(batch))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            last = min(last, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
    del batch
    release()


def word_spans(data: np.ndarray, at: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (bytes that are not ``outside``: 9-13, 32) and its text's number."""
    word = ~outside[data]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    opens[first] = word[first]
    start = np.flatnonzero(opens)
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    last = at[1:][at[:-1] < at[1:]] - 1
    closes[last] = word[last]
    end = np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` for each of ``n`` owners."""
    return np.bincount(owner, weights=values, minlength=n)
