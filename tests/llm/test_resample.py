"""Importance resampling: the query against SQL, hashing and sorting against plain versions."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geopanel.llm import resample
from geopanel.llm.queries import ORACLES, QUERIES


def bag(rows):
    return Counter(repr(tuple(r)) for r in rows)


def test_query(spark, folder):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    result = con.sql(ORACLES["op13_importance_resampling"])
    got = QUERIES["op13_importance_resampling"](spark, folder).select(*result.columns).collect()
    assert bag(got) == bag(result.fetchall())
    drawn = sorted(r["rank"] for r in got if r["rank"])
    assert drawn == list(range(1, len(drawn) + 1)) and len(drawn) > 20


def test_features_are_hashed_as_the_library_does():
    long_ = "w" * 300
    texts = ["One two  three", "", "-- !!", "ÉCOLE école 12a", f"{long_} x {long_}{long_} y", "a" * 64 + " " + "b" * 65, "日本 語,テスト"]
    bucket, owner, words = resample.features(pa.array(texts, pa.large_string()), resample.shift_tables())
    want = Counter()
    for i, t in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        found = "".join(c if c.isdigit() and c < ":" or "a" <= c <= "z" or c > "\x7f" else " " for c in low).split(" ")
        found = [w for w in found if w]
        assert words[i] == len(found)
        for f in [*found, *(f"{a} {b}" for a, b in zip(found, found[1:]))]:
            want[i, zlib.crc32(f.encode()) % 10000] += 1
    assert Counter(zip(owner.tolist(), bucket.tolist())) == want


def test_gains_of_empty_sides():
    empty, some = np.zeros(resample.BUCKETS, np.int64), np.bincount([3, 3, 7], minlength=resample.BUCKETS)
    assert set(resample.gains(empty, empty).tolist()) == {0}
    assert resample.gains(some, some).max() == 0 and resample.gains(empty, some)[3] > 0 > resample.gains(some, empty)[3]


@pytest.mark.parametrize("wide", [False, True])
def test_sort(spark, monkeypatch, wide):
    monkeypatch.setattr(resample, "CHUNKS", 7)
    rng = np.random.default_rng(1)
    ids = rng.integers(-(2**63), 2**63 - 1, 900) if wide else rng.integers(-50, 5000, 900)
    rows = [(int(i), int(s)) for i, s in zip(ids, rng.integers(-3, 4, 900))] + [(None, 0), (None, 9), (None, 9)]
    rows += [(77, 5)] * 400  # a third of all rows
    table = spark.createDataFrame(rows, "doc_id long, score long").repartition(5)
    table = resample.materialize(table.withColumn("place", F.monotonically_increasing_id()), "rows")
    got = resample.radix_sorted(table, resample.key_digits(table, "score", "doc_id")).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(len(rows)))
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    assert [(r["doc_id"], r["score"]) for r in got] == order


def test_sort_is_stable_over_equal_keys(spark):
    table = spark.range(300).selectExpr("id AS doc_id", "5L AS score").repartition(3)
    table = resample.materialize(table.withColumn("place", F.monotonically_increasing_id()), "rows")
    before = [r["doc_id"] for r in table.orderBy("place").collect()]
    after = resample.radix_sorted(table, resample.key_digits(table, "score", "score")).orderBy("place").collect()
    assert [r["doc_id"] for r in after] == before
