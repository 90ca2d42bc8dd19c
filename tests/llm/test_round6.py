"""What a stage of the pipeline holds in a Python worker."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from geopanel.llm import blocks, decontaminate
from tests.llm.conftest import SCHEMA

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unlimited(spark):
    spark.conf.unset(LIMIT)
    yield spark
    spark.conf.unset(LIMIT)


def test_windows_of_a_large_batch_in_little_memory(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = np.array([f"word{i}" for i in range(4000)] + ["Name", "12", "km"] * 300)
    texts = [" ".join(rng.choice(words, 300)) for _ in range(2000)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    bitmap = rng.random(decontaminate.BITS) < 0.01
    docs = spark.createDataFrame([(0, "")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)

    def rows():
        return pa.Table.from_batches(decontaminate.window_rows(docs, ["doc_id"], bitmap)(iter([batch])))

    tracemalloc.start()
    got = rows()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000, peak
    monkeypatch.setattr(decontaminate, "SMALL_BLOCK", 10**9)
    order = [("doc_id", "ascending"), ("place", "ascending"), ("template", "ascending")]
    assert got.num_rows > 1000 and got.sort_by(order).equals(rows().sort_by(order))


def test_stages_hand_small_batches_to_the_workers(unlimited):
    spark = unlimited
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(LIMIT)
        stage(spark, none, "/root/testdata/sf0.001")
        assert spark.conf.get(LIMIT) == blocks.BATCH_BYTES, name

    def seen(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    docs = spark.range(0, 9000, 1, 1).selectExpr("id", "repeat('word ', 200) AS text")
    got = docs.mapInArrow(seen, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 9000 and max(r["bytes"] for r in got) < 3_000_000


def test_a_limit_of_the_session_stays(unlimited):
    unlimited.conf.set(LIMIT, "300k")
    blocks.bound_batches(unlimited)
    assert unlimited.conf.get(LIMIT) == "300k"
