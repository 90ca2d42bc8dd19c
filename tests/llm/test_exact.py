"""Exact duplicates: the registered query against SQL, the index against a dictionary."""

import hashlib
from collections import Counter

import duckdb
import numpy as np

from geopanel.llm import exact
from geopanel.llm.queries import ORACLES, QUERIES


def bag(rows):
    return Counter(repr(tuple(r)) for r in rows)


def test_query(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    result = con.sql(ORACLES["op11_cuckoo_dedup"])
    got = QUERIES["op11_cuckoo_dedup"](spark, folder).select(*result.columns).collect()
    assert bag(got) == bag(result.fetchall())
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})


def test_only_a_to_z_are_lowered(spark):
    rows = [(1, "ABC é"), (2, "abc é"), (3, "ABC É"), (4, "K"), (5, "K"), (6, None), (7, "")]
    got = exact.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5, 6: 7, 7: 7}
    assert {r["text_sha256"] for r in got if r["doc_id"] == 3} == {hashlib.sha256("abc É".encode()).hexdigest()}


def test_hot_groups_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT_ROWS", 10)
    monkeypatch.setattr(exact, "COMBINE_ROWS", 7)
    rows = [(i, "copy") for i in range(40)] + [(39, "Copy"), (None, "copy"), (None, "alone"), (None, "ALONE"), (50, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact.deduplicate(docs).collect()
    assert len(got) == len(rows)
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(39, 42), (None, 2), (50, 1)}
    assert sorted((r["keep_id"] or -1, r["doc_id"] or -1) for r in got if r["kept"]) == [(-1, -1), (39, 39), (50, 50)]


def keys_of(numbers):
    return np.array([np.frombuffer(hashlib.sha256(str(n).encode()).digest(), ">u8") for n in numbers]).astype(np.uint64)


def values_of(numbers):
    return np.array([[1, n, n, 1] for n in numbers], np.int64)


def test_filter_against_a_dictionary():
    rng = np.random.default_rng(2)
    index, live = exact.Cuckoo(2), {}
    for step in range(60):
        some = rng.integers(0, 3000, rng.integers(1, 200)).tolist()
        if step % 3 == 2:
            index.delete(keys_of(some))
            for n in some:
                live.pop(n, None)
        else:
            index.add(keys_of(some), values_of(some))
            for n in some:
                live[n] = live.get(n, 0) + 1
        found = index.find(keys_of(range(3000)))
        assert {n for n in range(3000) if found[n] >= 0} == set(live)
        assert {n: index.values[found[n], 3] for n in live} == live
        assert (index.owner >= 0).sum() == len(live)
    # it began with eight slots
    assert index.grown > 5 and (index.table > 0).mean() > 0.2


def test_false_positives_are_checked():
    index = exact.Cuckoo(1 << 10)
    keys = keys_of(range(2000))
    keys[:, 2] = 7 << 50  # one fingerprint for all
    index.add(keys[:1500], values_of(range(1500)))
    found = index.find(keys)
    assert (found[:1500] >= 0).all() and (found[1500:] < 0).all() and index.false > 0


def test_index_takes_later_batches(spark, monkeypatch):
    monkeypatch.setattr(exact, "LEAST_PARTS", 3)

    def table(rows, first):
        made = exact.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        return made.withColumn("row", made["row"] + first)

    one = table([(i, f"text {i % 500}") for i in range(900)], 0)
    two = table([(i, f"text {i % 700}") for i in range(900, 1500)], 1 << 50)
    gone = table([(0, f"text {i}") for i in range(0, 700, 7)] + [(0, "never there")], 0)
    index = exact.build(one)
    index = exact.insert(index, two)
    index = exact.delete(index, gone)
    index = exact.insert(index, table([(5000, "text 7"), (5001, "TEXT 8")], 1 << 52))
    live = {}
    for i, t in [(i, i % 500) for i in range(900)] + [(i, i % 700) for i in range(900, 1500)]:
        live[t] = (i, live.get(t, (0, 0))[1] + 1)
    live = {t: v for t, v in live.items() if t % 7}
    live[7] = (5000, 1)
    live[8] = (5001, live[8][1] + 1)
    names = {hashlib.sha256(f"text {t}".encode()).digest(): t for t in range(700)}
    got = {names[bytes(r["digest"])]: (r["id"], r["copies"]) for r in index.entries.collect()}
    assert got == live
    # each entry lies in a place of its own
    places = [(r["part"], r["bucket"], r["slot"]) for r in index.entries.collect()]
    assert len(set(places)) == len(places)
