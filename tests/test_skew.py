"""Skew-safe building blocks against brute force, with one key holding most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geopanel import ordered, skew


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    keys = np.where(rng.random(3000) < 0.4, "hot", rng.choice([f"k{i}" for i in range(40)], 3000))
    values = np.round(rng.exponential(10, 3000), 2)
    rows = [(i, None if i % 601 == 0 else str(k), float(v) if i % 17 else None) for i, (k, v) in enumerate(zip(keys, values))]
    return spark.createDataFrame(rows, "id long, key string, value double").cache()


def test_heavy_keys_are_bounded(skewed):
    assert [r["key"] for r in skew.heavy_keys(skewed, ["key"], min_rows=200).collect()] == ["hot"]
    assert skew.heavy_keys(skewed, ["key"], min_rows=1, max_keys=2).count() <= 2


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_salted_join_equals_join(spark, skewed, how, null_safe):
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), (None, 4)], "key string, w int")
    got = skew.salted_join(skewed, dim, ["key"], how, null_safe, min_rows=100, salts=7)
    same = skewed["key"].eqNullSafe(dim["key"]) if null_safe else skewed["key"] == dim["key"]
    want = skewed.join(dim, same, how).drop(dim["key"])
    order = lambda df: sorted(map(tuple, df.select(*got.columns).collect()), key=str)
    assert order(got) == order(want)


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_join_bounded_both_ways(spark, skewed, max_bytes):
    dim = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, w int")
    got = skew.join_bounded(skewed, dim, ["key"], max_bytes=max_bytes, min_rows=100)
    assert got.count() == skewed.join(dim, "key").count()
    assert ("_d_key" not in got.columns) and set(got.columns) == {"id", "key", "value", "w"}


def test_quantiles_of_heavy_and_usual_groups(skewed):
    pdf = skewed.toPandas()
    plain = {"n": F.count(F.lit(1)), "top": F.max("value")}
    wanted = {"q1": ("value", 0.25), "med": ("value", 0.5), "p99": ("value", 0.99)}
    for limit in (1, 300, 10**6):
        got = ordered.aggregate_with_quantiles(skewed, ["key"], plain, wanted, min_rows=limit).toPandas()
        assert len(got) == pdf["key"].nunique() + 1
        for _, row in got.iterrows():
            part = pdf[pdf["key"].isna() if row["key"] is None else pdf["key"] == row["key"]]["value"]
            assert row["n"] == len(part) and row["top"] == part.max()
            for name, (_, p) in wanted.items():
                assert row[name] == pytest.approx(part.quantile(p), abs=1e-12)


def test_quantiles_of_the_whole_table(spark):
    values = [1.0, 2.0, 4.0, 8.0]
    df = spark.createDataFrame([(v, -v) for v in values], "a double, b double")
    got = ordered.aggregate_with_quantiles(
        df, [], {"m": F.avg("a")}, {"q1": ("a", 0.25), "med": ("a", 0.5), "q3": ("a", 0.75), "bmed": ("b", 0.5)}
    ).first()
    assert tuple(got) == (3.75, 1.75, 3.0, 5.0, -3.0)


def test_quantiles_with_far_outliers_and_constants(spark):
    rng = np.random.default_rng(0)
    a = np.concatenate([rng.normal(0, 1e-6, 5000), [1e12, -1e15, 3e300]])
    df = spark.createDataFrame([(float(v), 7.0) for v in a], "a double, c double")
    got = ordered.aggregate_with_quantiles(df, [], {}, {"med": ("a", 0.5), "cm": ("c", 0.3)}).first()
    assert got["med"] == pytest.approx(float(np.median(a)), rel=1e-12) and got["cm"] == 7.0


def test_running_totals_equal_one_window(skewed):
    got = ordered.running_totals(
        skewed, ["key"], ["id"], F.floor(F.col("id") / 100), {"s": F.coalesce("value", F.lit(0.0)), "n": F.lit(1)}
    ).toPandas().sort_values("id")
    pdf = skewed.toPandas().sort_values("id")
    want = pdf.assign(v=pdf["value"].fillna(0)).groupby("key", dropna=False)["v"].cumsum()
    assert np.allclose(got["s"].to_numpy(), want.to_numpy())
    assert (got["n"].to_numpy() == pdf.groupby("key", dropna=False).cumcount().to_numpy() + 1).all()


def test_next_in_key_crosses_slices(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 950, 30), ("b", 5, 40)], "k string, t int, v int")
    got = ordered.next_in_key(df, ["k"], "t", F.floor(F.col("t") / 100), ["v"], "nxt").orderBy("k", "t").collect()
    assert [(r["t"], r["nxt"] and tuple(r["nxt"])) for r in got] == [(1, (2, 20)), (2, (950, 30)), (950, None), (5, None)]


def test_smallest_with_ties(spark):
    df = spark.range(1000).withColumn("h", (F.col("id") * 37 % 50))
    got = {r["id"] for r in ordered.smallest(df, "h", "id", 130).collect()}
    want = {r["id"] for r in df.orderBy("h", "id").limit(130).collect()}
    assert got == want
    assert ordered.smallest(df, "h", "id", 5000).count() == 1000


def test_written_tables_go_to_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert skew.checkpoint_dir(spark) == folder
    kept = skew.materialize(spark.range(5), "x")
    assert kept.count() == 5 and all(f.startswith(f"file://{folder}/x-") for f in kept.inputFiles())
