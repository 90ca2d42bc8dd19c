"""Fixed effects by blocks: little is written and shuffled, and the fits stay as they are."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from geopanel.operators import regress
from tests.test_regress import meat, reference


def shuffled(spark):
    """Bytes of files that tasks of this session keep for other tasks."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()))


def written(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path.removeprefix("file:")) for f in names)


def test_rounds_write_no_table(spark, monkeypatch):
    n = 20_000
    cols = ["id % 400 AS user", "CAST(pmod(xxhash64(id, 1), 30) AS INT) AS date", "CAST(pmod(xxhash64(id, 2), 7) AS INT) AS kind"]
    rows = spark.range(n).selectExpr(*cols, *[f"rand({i}) + id % 5 AS x{i}" for i in range(8)])
    paths, plain = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **options):
        plain(self, path, *args, **options)
        paths.append((path, written(path)))

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    times, made = [], []
    for tol in (1e-1, 1e-10):
        paths.clear()
        before = shuffled(spark)
        fit = regress.fe_regression(rows, ["x7"], [f"x{i}" for i in range(7)], ["user", "date", "kind"], cluster=["date"], tol=tol)
        assert fit.n == n
        times.append(fit.rounds)
        made.append(len(paths))
        # the cells, once as they come and once in blocks
        table = n * (8 + 4) * 8
        assert sum(size for _, size in paths) < 2.5 * table
        assert shuffled(spark) - before < 2 * table
        assert not any(written(path) > 1000 for path, _ in paths)
    assert times[1] > times[0] and made[1] == made[0]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 900
    user = np.where(rng.random(n) < 0.2, 0, rng.integers(1, 70, n))
    day, kind, group = rng.integers(0, 25, n), rng.integers(0, 4, n), rng.integers(0, 40, n)
    x, t = rng.normal(size=n) + user * 0.01, rng.normal(size=n) + day * 0.05
    y = 0.5 * x - 0.3 * t + np.sin(day) + user * 0.02 + kind + rng.normal(size=n)
    rows = pd.DataFrame({"user": [f"u{v}" for v in user], "day": day, "kind": kind / 2 - 0.5, "group": group, "x": x, "t": t, "y": y})
    rows["w"] = rng.integers(1, 9, n).astype(float)
    return pd.concat([rows, rows[:50]], ignore_index=True)


def check(spark, data, effects, cluster, weights=None, **limits):
    fit = regress.fe_regression(spark.createDataFrame(data), ["y"], ["x", "t"], effects, cluster=cluster, weights=weights, small_sample=False, **limits)
    beta, resid, swept, w = reference(data, "y", ["x", "t"], effects, weights)
    assert fit.n == len(data) and fit.estimates[:, 0] == pytest.approx(beta, abs=1e-6)
    inv = np.linalg.inv((swept * w[:, None]).T @ swept)
    groups = [data[c].astype(str) for c in cluster]
    v = sum(meat(swept, resid, w, g.to_numpy())[0] for g in groups)
    if len(groups) == 2:
        v = v - meat(swept, resid, w, (groups[0] + "|" + groups[1]).to_numpy())[0]
    assert fit.errors[:, 0] == pytest.approx(np.sqrt(np.diag(inv @ v @ inv)), rel=1e-5)


@pytest.mark.parametrize(
    "effects, cluster, weights",
    [
        (["user", "day", "kind"], ["user", "day"], "w"),  # the effect inside the blocks is a cluster
        (["user", "day", "kind"], ["group"], None),  # so is no effect
        (["user", "day"], ["group", "day"], "w"),
        (["user"], ["user"], None),
        (["kind"], ["group"], None),
    ],
)
@pytest.mark.parametrize("min_rows", [None, 15])
def test_levels_over_many_blocks(spark, data, monkeypatch, effects, cluster, weights, min_rows):
    absorb = regress.absorbed_products.__globals__
    for name, value in {"BLOCK_CELLS": 40, "PART_CELLS": 300, "KEPT_GROUPS": 5}.items():
        monkeypatch.setitem(absorb, name, value)
    check(spark, data, effects, cluster, weights, min_rows=min_rows)


@pytest.mark.parametrize("min_rows", [None, 15])
def test_more_levels_than_the_driver_holds(spark, data, min_rows):
    check(spark, data, ["user", "day", "kind"], ["group", "day"], "w", max_bytes=0, min_rows=min_rows)


def test_both_zeros_are_one_level(spark, data):
    rows = spark.createDataFrame(data).withColumn("kind", F.when((F.col("kind") == 0) & (F.col("day") < 9), F.lit(-0.0)).otherwise(F.col("kind")))
    for limits in ({}, {"max_bytes": 0}):
        fit = regress.fe_regression(rows, ["y"], ["x", "t"], ["user", "kind"], **limits)
        assert fit.estimates[:, 0] == pytest.approx(reference(data, "y", ["x", "t"], ["user", "kind"])[0], abs=1e-6)
