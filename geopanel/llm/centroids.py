"""Exact k-means in integers with heap-ordered bounds.

Vectors lie in blocks of ``BLOCK`` rows. In a block, each cluster keeps a heap of
its vectors, ordered by the gap between the distance to the second nearest
centroid and the distance to the nearest one. When centroids move, the gap of a
vector of cluster ``c`` shrinks at most by the drift of ``c`` plus the largest
drift of any other centroid. That sum is accumulated for each cluster, and a
vector enters the heap with its gap plus what is accumulated so far. So one
comparison with the top of a heap tells whether any of its vectors can change
sides; those whose gap has expired are popped and compared with all centroids
exactly, and all others are never looked at.

Components are integers, so distances, sums and means are exact. Gaps are
floating-point numbers and are taken a little smaller than they are, so an
expired gap is never overlooked; ties, and vectors of very large components,
have a gap of 0 and are always rescanned.

Every round writes the blocks with their heaps to the checkpoint folder and
sums what the moved vectors take from one cluster and bring to another. The
driver holds the centroids and those sums, at most k times dimensions.

Cases: vectors of another length, null ones and those with a null or non-finite
component are left out; with fewer vectors than centroids each vector starts
one; components beyond ``NARROW`` are computed in integers of any size, and a
distance or sum beyond 64 bits is given as the largest 64-bit integer; repeated
rows are vectors of their own; null ids are ids like others (hashed as empty
text) and share their hash, ties then go by the vector; other columns are never
read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geopanel.skew import discard, materialize

#: Vectors of a block.
BLOCK = 2_048
#: Components below it make distances that floating-point products give exactly.
NARROW = 1 << 21
#: What a component is multiplied with before it is cut down to an integer.
SCALE = 256
LARGEST = 2**63 - 1
STATE = (
    "ids binary, no_id binary, wide boolean, vectors binary, sizes binary, heap binary, gaps binary, "
    "c array<int>, d array<int>, k array<int>, v array<long>"
)
#: Bits of the parts in which sums travel.
LIMB = 32


def _whole(x: float) -> int:
    """floor(SCALE * x), exactly."""
    return math.floor(SCALE * x) if abs(x) < 2.0**60 else SCALE * int(x)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple]:
    """(ids, no id, vectors) of ``BLOCK`` rows or fewer, from batches (id, vector)."""

    def made(batch: pa.RecordBatch) -> tuple:
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        none = np.asarray(batch.column(0).is_null())
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        if len(x) and np.abs(x).max() * SCALE >= NARROW:
            return ids, none, np.array([[_whole(float(c)) for c in row] for row in x], object)
        return ids, none, np.floor(SCALE * x).astype(np.int64)

    held, rows = [], 0
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK):
            part = batch.slice(first, BLOCK)
            if rows + part.num_rows > BLOCK:
                yield made(pa.concat_batches(held))
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if rows:
        yield made(pa.concat_batches(held))


def distances(vectors: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of every vector to every centroid."""
    if vectors.dtype == object or any(abs(x) >= NARROW for c in centroids for x in c):
        points = np.array(centroids, object)
        return np.stack([((vectors.astype(object) - c) ** 2).sum(1) for c in points], 1)
    v, c = vectors.astype(np.float64), np.array(centroids, np.float64)
    return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)


def scan(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number), its squared distance, and a gap that is never too large."""
    d = distances(vectors, centroids)
    nearest = d.argmin(1)
    one = np.arange(len(d))
    best = d[one, nearest]
    if d.shape[1] == 1:
        return nearest, best, np.full(len(d), np.inf)
    if d.dtype == object:  # too large for roots: rescanned every round
        return nearest, best, np.zeros(len(d))
    rest = d.astype(np.float64)
    rest[one, nearest] = np.inf
    near, far = np.sqrt(best.astype(np.float64)), np.sqrt(rest.min(1))
    # no gap where the numbers cannot tell
    return nearest, best, np.maximum(far - near - 1e-9 * (far + near), 0)


def _moved(old: np.ndarray, new: np.ndarray, vectors: np.ndarray, k: int) -> list[list[int]]:
    """What clusters gain: (cluster, dimension or -1 for the count, part, amount)."""
    at = np.flatnonzero(old != new)
    kind = object if vectors.dtype == object else np.int64
    gain = np.zeros((k, vectors.shape[1]), kind)
    count = np.bincount(new[at], minlength=k)
    np.add.at(gain, new[at], vectors[at])
    left = at[old[at] >= 0]
    np.subtract.at(gain, old[left], vectors[left])
    count = count - np.bincount(old[left], minlength=k)
    out: list[list[int]] = [[], [], [], []]

    def put(c: int, d: int, amount: int) -> None:
        part = 0
        while amount:
            last = -LARGEST <= amount << 8 <= LARGEST
            low = amount if last else amount & (1 << LIMB) - 1
            for column, x in zip(out, (c, d, part, low)):
                column.append(x)
            amount = 0 if last else amount >> LIMB
            part += 1

    for c, d in zip(*np.nonzero(gain)):
        put(int(c), int(d), int(gain[c, d]))
    for c in np.flatnonzero(count):
        put(int(c), -1, int(count[c]))
    return out


def _pack(vectors: np.ndarray) -> bytes:
    if vectors.dtype == object:
        return ",".join(str(x) for x in vectors.ravel()).encode()
    return vectors.astype("<i4").tobytes()


def _unpack(data: bytes, wide: bool, dims: int) -> np.ndarray:
    if wide:
        return np.array([int(x) for x in data.split(b",")], object).reshape(-1, dims)
    return np.frombuffer(data, "<i4").astype(np.int64).reshape(-1, dims)


def _stored(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple]:
    """(ids, no id, vectors, cluster heaps) of written blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, none, wide, vectors, sizes, heap, gaps = (batch.column(k)[i].as_py() for k in range(7))
            edges = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i4"))])
            order = list(zip(np.frombuffer(gaps, "<f8").tolist(), np.frombuffer(heap, "<i4").tolist()))
            heaps = [order[a:b] for a, b in zip(edges[:-1], edges[1:])]
            yield np.frombuffer(ids, "<i8"), np.frombuffer(none, bool), _unpack(vectors, wide, dims), heaps


def _expired(heaps: list[list[tuple[float, int]]], offsets: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Pop the vectors whose gap may have closed: their places and clusters."""
    at, of = [], []
    for c, heap in enumerate(heaps):
        while heap and heap[0][0] <= offsets[c]:
            at.append(heapq.heappop(heap)[1])
            of.append(c)
    return np.array(at, np.int64), np.array(of, np.int64)


def _advance(heaps: list, vectors: np.ndarray, centroids: list[list[int]], offsets: list[float], fresh: bool) -> list[list[int]]:
    """Rescan what has expired (all vectors of a fresh block) and push it back; what clusters gain."""
    at, old = (np.arange(len(vectors)), np.full(len(vectors), -1)) if fresh else _expired(heaps, offsets)
    if not len(at):
        return [[], [], [], []]
    new, _, gap = scan(vectors[at], centroids)
    for place, c, g in zip(at.tolist(), new.tolist(), gap.tolist()):
        heapq.heappush(heaps[c], (g + offsets[c], place))
    return _moved(old, new, vectors[at], len(centroids))


def _round(rows: DataFrame, dims: int, centroids: list[list[int]], offsets: list[float], fresh: bool) -> DataFrame:
    """The blocks after one assignment, written, with what their clusters gain."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, none, vectors, *heaps in _blocks(batches, dims) if fresh else _stored(batches, dims):
            heaps = heaps[0] if heaps else [[] for _ in range(k)]
            gains = _advance(heaps, vectors, centroids, offsets, fresh)
            order = [x for h in heaps for x in h]
            wide = vectors.dtype == object
            values = [
                ids.astype("<i8").tobytes(), none.tobytes(), wide, _pack(vectors),
                np.array([len(h) for h in heaps], "<i4").tobytes(),
                np.array([p for _, p in order], "<i4").tobytes(), np.array([g for g, _ in order], "<f8").tobytes(),
                *gains,
            ]
            types = [pa.binary(), pa.binary(), pa.bool_(), *[pa.binary()] * 4, *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64())]
            names = [f.split(" ")[0] for f in STATE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types)], names)

    return materialize(rows.mapInArrow(run, STATE), "blocks")


def _nearest(rows: DataFrame, dims: int, kind: T.DataType, centroids: list[list[int]], offsets: list[float]) -> DataFrame:
    """(vec_id, cluster, distance) of every vector after the last assignment, written."""
    id_type = pa.int32() if isinstance(kind, T.IntegerType) else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, none, vectors, heaps in _stored(batches, dims):
            _advance(heaps, vectors, centroids, offsets, False)
            cluster = np.empty(len(vectors), np.int32)
            for c, heap in enumerate(heaps):
                cluster[[p for _, p in heap]] = c
            if vectors.dtype == object or any(abs(x) >= NARROW for c in centroids for x in c):
                own = np.array(centroids, object)[cluster]
                d = np.array([min(x, LARGEST) for x in ((vectors.astype(object) - own) ** 2).sum(1)], np.int64)
            else:
                d = ((vectors - np.array(centroids, np.int64)[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=none).cast(id_type), pa.array(cluster), pa.array(d)], ["vec_id", "cluster", "distance"]
            )

    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return materialize(rows.select(*[f.split(" ")[0] for f in STATE.split(", ")][:7]).mapInArrow(run, schema), "nearest")


def _drift(old: list[int], new: list[int]) -> float:
    """How far a centroid has moved, not less."""
    square = sum((a - b) ** 2 for a, b in zip(old, new))
    return math.sqrt(square) * (1 + 1e-9) if square < 2**1000 else math.inf


def _gains(state: DataFrame) -> dict[tuple[int, int], int]:
    """What each cluster gains in each dimension (-1: vectors)."""
    parts = state.select(F.inline(F.arrays_zip("c", "d", "k", "v"))).groupBy("c", "d", "k").agg(F.sum("v").alias("v"))
    out: dict[tuple[int, int], int] = {}
    for row in parts.collect():
        out[row["c"], row["d"]] = out.get((row["c"], row["d"]), 0) + (row["v"] << LIMB * row["k"])
    return out


def kept_vectors(table: DataFrame, dims: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows with ``dims`` finite components."""
    limit = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x < limit) & (x > -limit))
    rows = table.where(F.coalesce((F.size(vector) == dims) & fine, F.lit(False)))
    return rows.select(F.col(id_column).alias("vec_id"), F.col(vector).alias("embedding"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(name.alias("hash"), "embedding").orderBy("hash", "embedding").limit(k).collect()
    return [[_whole(float(x)) for x in r["embedding"]] for r in rows]


def cluster(
    table: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, id_column: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector after ``rounds`` rounds and a last assignment; the centroids."""
    vectors = kept_vectors(table, dims, id_column, vector)
    kind = vectors.schema["vec_id"].dataType
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    offsets = [0.0] * len(centroids)
    sums: dict[tuple[int, int], int] = {}
    state = None
    for number in range(rounds):
        before = state
        state = _round(vectors if before is None else before, dims, centroids, offsets, before is None)
        for key, gain in _gains(state).items():
            sums[key] = sums.get(key, 0) + gain
        if before is not None:
            discard(before)
        moved = [
            [sums.get((c, d), 0) // sums[c, -1] for d in range(dims)] if sums.get((c, -1)) else old
            for c, old in enumerate(centroids)
        ]
        drift = [_drift(x, y) for x, y in zip(centroids, moved)]
        for c in range(len(centroids)):
            offsets[c] += drift[c] + max((p for j, p in enumerate(drift) if j != c), default=0.0)
        centroids = moved
    if state is None:
        state = _round(vectors, dims, centroids, offsets, True)
    found = _nearest(state, dims, kind, centroids, offsets)
    discard(state)
    return found, centroids


def summary(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``found`` with cluster_inertia, inertia and centroid_sha256."""
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    # a row for each centroid
    sums = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(total).collect()}
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in centroids]
    whole = min(sum(sums.values()), LARGEST)
    rows = [(c, min(n, LARGEST), whole, names[c]) for c, n in sums.items()]
    columns = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return found.join(F.broadcast(found.sparkSession.createDataFrame(rows, columns)), "cluster")
