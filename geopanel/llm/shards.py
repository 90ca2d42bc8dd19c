"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a 64-bit ring; a row belongs to the first point
clockwise of its key's hash. A shard takes rows only up to its capacity; the
rest continue clockwise to the next point whose shard has room. With the
capacities summing to the number of rows every shard ends exactly full, so
counts differ by one at most, and a row leaves its home only if that is full.

Rows are sorted along the ring once (a range shuffle of ids and numbers, no
texts). After that an arc between two points is an interval of positions, so
the overflow is worked out on arc counts alone: the driver sees one number for
each arc and partition, never a row, and a row finds its shard and its slot
from its position.

Cases: null keys hash like any other value; rows with the same key are
neighbours on the ring, in the order of the tie columns and then of the input,
so a hot key is cut where its shard is full; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.skew import materialize

from .blocks import mix

#: Points of each shard on the ring.
POINTS = 128
_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


@dataclass
class Ring:
    """Points in clockwise order and the shard of each."""

    at: np.ndarray
    shard: np.ndarray

    @classmethod
    def build(cls, shards: int, points: int = POINTS) -> Ring:
        s = np.repeat(np.arange(shards, dtype=np.uint64), points)
        v = np.tile(np.arange(points, dtype=np.uint64), shards)
        at = mix(mix(s + np.uint64(1)) ^ (v + np.uint64(1))).view(np.int64)
        order = np.lexsort((s, at))
        return cls(at[order], s[order].astype(np.int64))

    def arc(self, h: np.ndarray) -> np.ndarray:
        """The first point at or after each hash; past the last point, the first."""
        i = np.searchsorted(self.at, h)
        return np.where(i == len(self.at), 0, i)


def segments(ring: Ring, arcs: list[tuple[int, int, int]], capacity: list[int]) -> np.ndarray:
    """Rows (start, shard, slot): from position ``start`` on, that shard, from that slot.

    ``arcs`` has (first position, rows, point) for every arc with rows, in
    clockwise order. First every point serves its own arc as far as its shard
    has room, then what is left walks on clockwise.
    """
    room, used = list(capacity), [0] * len(capacity)
    out: list[tuple[int, int, int]] = []

    def take(start: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            out.append((start, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return n

    left = []
    for start, n, point in arcs:
        got = take(start, n, int(ring.shard[point]))
        if got < n:
            left.append((start + got, n - got, point))
    for start, n, point in left:
        while n:
            point = (point + 1) % len(ring.at)
            got = take(start, n, int(ring.shard[point]))
            start, n = start + got, n - got
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def capacities(rows: int, shards: int) -> list[int]:
    """Equal capacities that sum to ``rows``."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def assign(rows: DataFrame, key: str, shards: int, ties: list[str], points: int = POINTS) -> DataFrame:
    """All rows with ``shard`` and ``slot`` (gapless from 0 in every shard)."""
    ring = Ring.build(shards, points)
    hashed = rows.withColumns({"_hash": F.xxhash64(key), "_input": F.monotonically_increasing_id()})
    order = ["_hash", key, *ties, "_input"]
    sorted_rows = hashed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(
        sorted_rows.drop("_input").withColumn("_at", F.monotonically_increasing_id()), "ring"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column("_at").to_numpy() >> _ROW_BITS
            # rows past the last point belong to the first; they keep a number of their own here
            raw_arc = np.searchsorted(ring.at, b.column("_hash").to_numpy())
            both, n = np.unique(part * (len(ring.at) + 1) + raw_arc, return_counts=True)
            yield pa.record_batch(
                [pa.array(both // (len(ring.at) + 1)), pa.array(both % (len(ring.at) + 1)), pa.array(n)],
                ["part", "arc", "n"],
            )

    counted = (
        placed.select("_at", "_hash")
        .mapInArrow(count, "part long, arc long, n long")
        .groupBy("part", "arc")
        .agg(F.sum("n").alias("n"))
        .orderBy("part", "arc")
        .collect()
    )
    offset: dict[int, int] = {}
    arcs: list[tuple[int, int, int]] = []
    total = 0
    for part, arc, n in counted:
        offset.setdefault(part, total)
        point = arc % len(ring.at)
        if arcs and arcs[-1][2] == point:
            arcs[-1] = (arcs[-1][0], arcs[-1][1] + n, point)
        else:
            arcs.append((total, n, point))
        total += n
    table = segments(ring, arcs, capacities(total, shards))
    parts = np.array(sorted(offset), np.int64)
    offsets = np.array([offset[p] for p in parts], np.int64)
    columns = rows.columns
    schema = rows.select("*").schema.add("shard", "integer").add("slot", "long")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy()
            g = offsets[np.searchsorted(parts, at >> _ROW_BITS)] + (at & ((1 << _ROW_BITS) - 1))
            i = np.searchsorted(table[:, 0], g, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(k) for k in range(len(columns))),
                    pa.array(table[i, 1].astype(np.int32)),
                    pa.array(table[i, 2] + g - table[i, 0]),
                ],
                [*columns, "shard", "slot"],
            )

    return placed.drop("_hash").mapInArrow(put, schema)
