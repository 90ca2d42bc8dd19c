"""Exact duplicates through a cuckoo-filter index of live digests.

A text's digest is the SHA-256 of its bytes after lower-casing A-Z. The index
is dealt into parts by the digest's first bits. A part is a cuckoo filter: each
live digest leaves a 16-bit fingerprint in one of two buckets of four slots,
and beside every slot stands the stored key (the whole digest with the row that
stays and the number of copies). A lookup reads two buckets; a fingerprint that
agrees is a hit only if the stored key agrees too, so false positives cost a
comparison and never a row. A new digest moves others on while both its buckets
are full; when that does not end, the filter has overflowed and is rebuilt with
twice the buckets from the stored keys. A deleted digest frees its slot.

The index is a written table with one row for each live digest and its place in
the filter, so a later batch loads the filters as they are: :func:`insert` and
:func:`delete` bring rows and stored entries of a part together in one task.
Rows are combined a block at a time before the shuffle, so that a digest that a
third of all rows share arrives as a few rows.

Cases: null texts are empty texts; null ids are smaller than any other and a
group of null ids alone keeps a null id; of rows that repeat an id and its text
exactly one stays; other columns are never read; an empty table gives an empty
index.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.skew import materialize

from .blocks import mix

SLOTS = 4
#: Rounds of moving fingerprints on before a filter counts as overflowed.
KICKS = 200
#: Rows a part is meant for; more only make its filter larger.
PART_ROWS = 200_000
#: Parts of an index at least.
LEAST_PARTS = 128
#: Rows that a task combines before they are shuffled.
COMBINE_ROWS = 200_000
#: Groups over both limits (rows, and one in so many of all rows) are joined by broadcast: fewer than HOT_KEYS.
HOT_ROWS, HOT_KEYS = 1_000, 10_000

LEAST_ID = np.iinfo(np.int64).min
STORED, REMOVED, ADDED = 0, 1, 2
ENTRY = "part int, buckets int, bucket int, slot int, digest binary, known boolean, id long, row long, copies long"


class Index(NamedTuple):
    """Live digests by part; ``entries`` has the columns of ``ENTRY``."""

    entries: DataFrame
    parts: int


class Cuckoo:
    """The filter of one part and its stored keys."""

    def __init__(self, buckets: int = 64):
        self.keys = np.zeros((0, 4), np.uint64)
        # known id, id, row, copies of each stored key
        self.values = np.zeros((0, 4), np.int64)
        self.live = np.zeros(0, bool)
        self.checked = self.false = self.grown = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.owner = np.full((buckets, SLOTS), -1, np.int64)

    def _prints(self, keys: np.ndarray) -> np.ndarray:
        return np.maximum(keys[:, 2] >> np.uint64(48), 1).astype(np.uint16)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys[:, 1] & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's stored key, or -1."""
        prints, bucket = self._prints(keys), self._first(keys)
        out = np.full(len(keys), -1, np.int64)
        for place in (bucket, self._other(bucket, prints)):
            row, slot = np.nonzero(self.table[place] == prints[:, None])
            who = self.owner[place[row], slot]
            same = (self.keys[who] == keys[row]).all(1)
            out[row[same]] = who[same]
            self.checked += len(row)
            self.false += len(row) - int(same.sum())
        return out

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Store distinct keys that are not in the filter."""
        have = len(self.keys)
        self.keys = np.concatenate([self.keys, keys])
        self.values = np.concatenate([self.values, values])
        self.live = np.concatenate([self.live, np.ones(len(keys), bool)])
        self._place(np.arange(have, len(self.keys)))

    def _place(self, who: np.ndarray) -> None:
        if self.live.sum() <= 0.98 * self.table.size:
            prints, bucket = self._prints(self.keys[who]), self._first(self.keys[who])
            for kick in range(KICKS):
                order = np.argsort(bucket, kind="stable")
                who, prints, bucket = who[order], prints[order], bucket[order]
                rank = np.arange(len(who)) - np.searchsorted(bucket, bucket)
                free = self.table[bucket] == 0
                room = free.sum(1)
                fits = rank < room
                slot = np.argsort(~free, 1, kind="stable")[np.arange(len(who)), np.minimum(rank, SLOTS - 1)]
                self.table[bucket[fits], slot[fits]] = prints[fits]
                self.owner[bucket[fits], slot[fits]] = who[fits]
                guest = (rank == room)[~fits]
                who, prints, bucket = who[~fits], prints[~fits], bucket[~fits]
                if not len(who):
                    return
                if kick:
                    # one in each full bucket takes a slot, and what was there moves on
                    at = bucket[guest]
                    slot = (mix(who[guest].astype(np.uint64) + np.uint64(kick << 40)) & np.uint64(SLOTS - 1)).astype(np.int64)
                    moved = self.table[at, slot], self.owner[at, slot]
                    self.table[at, slot], self.owner[at, slot] = prints[guest], who[guest]
                    prints[guest], who[guest] = moved
                bucket = self._other(bucket, prints)
        self.resize(2 * len(self.table))

    def resize(self, buckets: int) -> None:
        """Rebuild the filter from the stored keys."""
        self.grown += 1
        self._clear(buckets)
        self._place(np.flatnonzero(self.live))

    def delete(self, keys: np.ndarray) -> None:
        """Free the slots of those keys that are stored."""
        who = np.unique(self.find(keys))
        who = who[who >= 0]
        prints, bucket = self._prints(self.keys[who]), self._first(self.keys[who])
        for place in (bucket, self._other(bucket, prints)):
            row, slot = np.nonzero(self.owner[place] == who[:, None])
            self.table[place[row], slot] = 0
            self.owner[place[row], slot] = -1
        self.live[who] = False

    def load(self, bucket: np.ndarray, slot: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
        """Take stored keys with the places that they had in a filter of this size."""
        have = len(self.keys)
        self.keys = np.concatenate([self.keys, keys])
        self.values = np.concatenate([self.values, values])
        self.live = np.concatenate([self.live, np.ones(len(keys), bool)])
        self.table[bucket, slot] = self._prints(keys)
        self.owner[bucket, slot] = np.arange(have, len(self.keys))

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Insert what is new; of what is live, count the copies and pass it on to the larger (known, id, row)."""
        keys, values = combined(keys, values)
        who = self.find(keys)
        old = who >= 0
        if old.any():
            at, new = who[old], values[old]
            have = self.values[at]
            larger = np.zeros(len(at), bool)
            for k in (2, 1, 0):
                larger = (new[:, k] > have[:, k]) | ((new[:, k] == have[:, k]) & larger)
            copies = have[:, 3] + new[:, 3]
            self.values[at] = np.where(larger[:, None], new, have)
            self.values[at, 3] = copies
        self.insert(keys[~old], values[~old])


def combined(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with its largest (known, id, row) and all its copies."""
    if not len(keys):
        return keys, values
    order = np.lexsort((*values.T[2::-1], *keys.T))
    keys, values = keys[order], values[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(keys)]]) - 1
    out = values[last]
    out[:, 3] = np.add.reduceat(values[:, 3], first)
    return keys[last], out


def _words(column: pa.Array) -> np.ndarray:
    """32-byte digests as four words each."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, 4), np.uint64)
    _, offsets, data = column.buffers()
    first = int(np.frombuffer(offsets, np.int64)[column.offset])
    return np.frombuffer(data, ">u8", 4 * len(column), first).astype(np.uint64).reshape(-1, 4)


def _binary(keys: np.ndarray) -> pa.Array:
    data = keys.astype(">u8").tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(keys), [None, pa.py_buffer(data)]).cast(pa.binary())


def _values(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """known, id, row, copies from four columns."""
    return np.stack([batch.column(first + k).cast(pa.int64()).to_numpy(zero_copy_only=False) for k in range(4)], 1)


def digests(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id column, digest, row) of every row, written; ``row`` numbers the rows."""
    text = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(
        F.col(id_column).cast("long").alias(id_column), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    )
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def _combine(rows: DataFrame, id_column: str) -> DataFrame:
    """(digest, known, id, row, copies) with the rows of each block of a task combined."""
    inner = rows.select(
        "digest", F.col(id_column).isNotNull().alias("known"), F.coalesce(id_column, F.lit(int(LEAST_ID))).alias("id"), "row",
        F.lit(1).cast("long").alias("copies"),
    )

    def packed(keys: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        k, v = combined(np.concatenate(keys), np.concatenate(values))
        columns = [_binary(k), pa.array(v[:, 0] > 0), *(pa.array(v[:, i]) for i in (1, 2, 3))]
        return pa.RecordBatch.from_arrays(columns, ["digest", "known", "id", "row", "copies"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, n = [], [], 0
        for batch in batches:
            keys.append(_words(batch.column(0)))
            values.append(_values(batch, 1))
            n += batch.num_rows
            if n >= COMBINE_ROWS:
                yield packed(keys, values)
                keys, values, n = [], [], 0
        if n:
            yield packed(keys, values)

    return inner.mapInArrow(run, "digest binary, known boolean, id long, row long, copies long")


def _maintained(stored: DataFrame | None, changes: DataFrame, kind: int, parts: int) -> DataFrame:
    """The entries after ``changes`` (digest, known, id, row, copies) were added or removed."""
    names = ["part", "kind", "digest", "known", "id", "row", "copies", "buckets", "bucket", "slot"]
    # the first 31 bits of a digest name its part
    part = (F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % parts).cast("int")
    zero = F.lit(0)
    rows = changes.select("*", part.alias("part"), F.lit(kind).alias("kind"), *(zero.alias(c) for c in names[7:])).select(*names)
    if stored is not None:
        rows = rows.unionByName(stored.withColumns({"part": part, "kind": F.lit(STORED)}).select(*names))
    dealt = rows.repartition("part").sortWithinPartitions("part", "kind")

    def out(part: int, index: Cuckoo) -> Iterator[pa.RecordBatch]:
        bucket, slot = np.nonzero(index.owner >= 0)
        for first in range(0, len(bucket), COMBINE_ROWS):
            b, s = bucket[first : first + COMBINE_ROWS], slot[first : first + COMBINE_ROWS]
            who = index.owner[b, s]
            v = index.values[who]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(who), part, np.int32)),
                    pa.array(np.full(len(who), len(index.table), np.int32)),
                    pa.array(b.astype(np.int32)),
                    pa.array(s.astype(np.int32)),
                    _binary(index.keys[who]),
                    pa.array(v[:, 0] > 0),
                    *(pa.array(v[:, i]) for i in (1, 2, 3)),
                ],
                ["part", "buckets", "bucket", "slot", "digest", "known", "id", "row", "copies"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        for batch in batches:
            marks = np.stack([batch.column(k).to_numpy() for k in (0, 1)], 1)
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
            for first, last in zip([0, *edges], [*edges, len(marks)]):
                if first == last:
                    continue
                if marks[first, 0] != now:
                    if index is not None:
                        yield from out(now, index)
                    now, index = int(marks[first, 0]), None
                piece = batch.slice(first, last - first)
                keys = _words(piece.column(2))
                if marks[first, 1] == STORED:
                    places = [piece.column(k).to_numpy().astype(np.int64) for k in (7, 8, 9)]
                    index = index or Cuckoo(int(places[0][0]))
                    index.load(places[1], places[2], keys, _values(piece, 3))
                else:
                    index = index or Cuckoo()
                    if marks[first, 1] == REMOVED:
                        index.delete(keys)
                    else:
                        index.add(keys, _values(piece, 3))
        if index is not None:
            yield from out(now, index)

    return materialize(dealt.mapInArrow(run, ENTRY), "cuckoo")


def build(rows: DataFrame, id_column: str = "doc_id") -> Index:
    """An index of the written ``rows`` of :func:`digests`."""
    parts = max(LEAST_PARTS, -(-rows.count() // PART_ROWS))
    return Index(_maintained(None, _combine(rows, id_column), ADDED, parts), parts)


def insert(index: Index, rows: DataFrame, id_column: str = "doc_id") -> Index:
    """The index with the written ``rows`` added; number their rows apart from those that it has."""
    return Index(_maintained(index.entries, _combine(rows, id_column), ADDED, index.parts), index.parts)


def delete(index: Index, rows: DataFrame, id_column: str = "doc_id") -> Index:
    """The index without the digests of ``rows``: their texts are live no more."""
    return Index(_maintained(index.entries, _combine(rows, id_column), REMOVED, index.parts), index.parts)


def lookup(index: Index, rows: DataFrame) -> DataFrame:
    """``rows`` (digest, …) that are live, with keep_id, keep_row and group_size.

    The few groups that hold more than 1 in ``HOT_KEYS`` of all copies are
    joined by broadcast, so no task gets such a group whole.
    """
    total = index.entries.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") > max(HOT_ROWS, total // HOT_KEYS)
    live = index.entries.select(
        "digest", F.when(F.col("known"), F.col("id")).alias("keep_id"), F.col("row").alias("keep_row"), "copies"
    )
    large = F.broadcast(live.where(hot))
    some = rows.join(large, "digest")
    rest = rows.join(large.select("digest"), "digest", "left_anti").join(live.where(~hot), "digest")
    return some.unionByName(rest).withColumnRenamed("copies", "group_size")


def deduplicate(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id column, keep_id, group_size, kept, text_sha256) of every row of ``docs`` (id column, text)."""
    rows = digests(docs, id_column)
    found = lookup(build(rows, id_column), rows)
    return found.select(
        id_column, "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
