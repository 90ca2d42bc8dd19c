"""Integer k-means against SQL and against a plain version."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np

from geopanel.llm import centroids
from geopanel.llm.queries import ORACLES, QUERIES


def bag(rows):
    return Counter(repr(tuple(r)) for r in rows)


def plain(rows, k, rounds, seed, dims):
    """[(id, cluster, distance)], centroids."""
    use = [
        (i, [math.floor(256 * x) if abs(x) < 2**60 else 256 * int(x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    points = [v for _, v in sorted(use, key=lambda x: (name(x[0]), x[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(points))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in use]
        for j in range(len(points)):
            own = [v for (_, v), c in zip(use, of) if c == j]
            if own:
                points[j] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, nearest(v)[1], min(nearest(v)[0], 2**63 - 1)) for i, v in use], points


def test_query(spark, folder, vectors):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    result = con.sql(ORACLES["op12_heap_centroids"])
    got = QUERIES["op12_heap_centroids"](spark, folder)
    assert bag(got.select(*result.columns).collect()) == bag(result.fetchall())
    want, points = plain([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors], 40, 5, 2, 64)
    assert bag(got.select("vec_id", "cluster", "distance").collect()) == bag(want)
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in points]
    assert {r["centroid_sha256"] for r in got.collect()} == {text[c] for _, c, _ in want}


def test_small_blocks_and_few_vectors(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 3)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 2)]) for i in range(200)]  # ties everywhere
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for k, rounds in ((5, 6), (1, 2), (300, 2), (4, 0)):
        found, points = centroids.cluster(table, k, rounds, 3, 2)
        want, expected = plain(rows, k, rounds, 3, 2)
        assert points == expected and bag(found.collect()) == bag(want)


def test_components_of_any_size(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 10.0 ** rng.integers(0, 40), 3)]) for i in range(60)]
    rows += [(100 + i, [1e300 * (-1) ** i, 2.0, 3.5]) for i in range(4)] + [(200, [1.5, 2.5, -3.25])]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    found, points = centroids.cluster(table, 8, 4, 2, 3)
    want, expected = plain(rows, 8, 4, 2, 3)
    assert points == expected and bag(found.collect()) == bag(want)
    total = centroids.summary(found, points).collect()
    assert len(total) == len(rows) and {r["inertia"] for r in total} == {min(sum(d for *_, d in want), 2**63 - 1)}


def test_few_are_rescanned():
    rng = np.random.default_rng(8)
    places = rng.integers(-4000, 4000, (10, 8))
    vectors = (places[rng.integers(0, 10, 2000)] + rng.integers(-300, 300, (2000, 8))).astype(np.int64)
    points = places.tolist()
    heaps = [[] for _ in points]
    offsets = [0.0] * 10
    centroids._advance(heaps, vectors, points, offsets, True)
    moved = [[x + 5 for x in c] for c in points]
    drift = [math.dist(a, b) for a, b in zip(points, moved)]
    offsets = [2 * max(drift)] * 10
    at, _ = centroids._expired([list(h) for h in heaps], offsets)
    assert len(at) < 50
    # nobody else changed sides
    before, after = (centroids.scan(vectors, p)[0] for p in (points, moved))
    assert set(np.flatnonzero(before != after)) <= set(at.tolist())
