import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geopanel.operators import bots

SCHEMA = "username string, t double, vader_compound double, label string"


def frame(spark, rows):
    df = spark.createDataFrame([(i, u, float(t), v, label) for i, (u, t, v, label) in enumerate(rows)], f"id int, {SCHEMA}")
    return df.withColumn("timestamp", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))


def test_forward_frame(spark):
    df = frame(spark, [("u", 0, 1.0, "a"), ("u", 0, 3.0, "a"), ("u", 2, None, "a"), ("u", 5, 9.0, "a")])
    got = bots.forward_window_stats(df, 5).orderBy("id").collect()
    assert [(r["posts"], r["mean"]) for r in got] == [(3, 2.0), (3, 2.0), (2, 9.0), (1, 9.0)]


def test_forward_frame_excludes_far_edge(spark):
    df = frame(spark, [("u", 0, 1.0, "a"), ("u", 5, 2.0, "a"), ("u", 4.999999, 4.0, "a")])
    got = {r["t"]: r["posts"] for r in bots.forward_window_stats(df, 5).collect()}
    assert got == {0.0: 2, 4.999999: 2, 5.0: 1}


@pytest.mark.parametrize("slice_seconds", [3, 40, 10_000])
def test_forward_frame_brute_force(spark, slice_seconds):
    rng = np.random.default_rng(1)
    users = np.where(rng.random(400) < 0.5, "hot", rng.choice(list("abc"), 400))
    rows = [(str(u), float(t), float(v), "x") for u, t, v in zip(users, rng.integers(0, 300, 400), rng.random(400))]
    df = frame(spark, rows)
    got = bots.forward_window_stats(df, 25, slice_seconds=slice_seconds).toPandas().sort_values("id")
    pdf = pd.DataFrame(rows, columns=["u", "t", "v", "l"])
    for (_, row), (_, out) in zip(pdf.iterrows(), got.iterrows()):
        inside = pdf[(pdf.u == row.u) & (pdf.t >= row.t) & (pdf.t < row.t + 25)]
        assert out["posts"] == len(inside) and out["mean"] == pytest.approx(inside.v.mean(), abs=1e-11)


BURSTS = [("a", t) for t in (0, 1, 2, 3, 5)] + [("b", t) for t in (6, 7, 8, 9)] + [("c", t) for t in (0, 2, 4, 5, 6)]


@pytest.mark.parametrize("slice_seconds", [1, 4, 3600])
def test_burst_rule(spark, slice_seconds):
    df = frame(spark, [(u, t, 0.0, "x") for u, t in BURSTS])
    assert [r["username"] for r in bots.burst_users(df, 5, 5, slice_seconds=slice_seconds).collect()] == ["a"]


def test_burst_of_equal_instants(spark):
    df = frame(spark, [("a", 7, 0.0, "x")] * 6 + [("b", 7, 0.0, "x")] * 4)
    assert [r["username"] for r in bots.burst_users(df, 5, 5).collect()] == ["a"]


@pytest.mark.parametrize("slice_seconds", [7, 60])
def test_burst_brute_force(spark, slice_seconds):
    rng = np.random.default_rng(5)
    rows = [(str(u), float(t)) for u, t in zip(rng.integers(0, 60, 900), np.round(rng.random(900) * 2000, 3))]
    df = frame(spark, [(u, t, 0.0, "x") for u, t in rows])
    got = {r["username"] for r in bots.burst_users(df, 3, 30, slice_seconds=slice_seconds).collect()}
    pdf = pd.DataFrame(rows, columns=["u", "t"]).sort_values(["u", "t"])
    gap = (pdf.t - pdf.groupby("u").t.shift(2)).round(6)
    assert got == set(pdf.u[gap <= 30]) and 0 < len(got) < 60


def test_daily_limit(spark):
    df = frame(spark, [("a", i, 0.0, "x") for i in range(41)] + [("b", i * 3000, 0.0, "x") for i in range(40)])
    assert [r["username"] for r in bots.high_volume_users(df).collect()] == ["a"]


def test_membership_is_null_safe_and_complete(spark):
    df = frame(spark, [("a", 0, 0.0, "x"), ("b", 1, 0.0, "x"), (None, 2, 0.0, "x")])
    users = spark.createDataFrame([("a",), ("a",), (None,)], "username string")
    kept = [r["id"] for r in bots.keep_users(df, users).collect()]
    rest = [r["id"] for r in bots.drop_users(df, users).collect()]
    assert sorted(kept) == [0, 2] and rest == [1]


def test_top_value_ties(spark):
    df = spark.createDataFrame([("u", "b"), ("u", "a"), ("v", "z"), ("v", "z"), ("v", "a")], "u string, l string")
    assert dict(map(tuple, bots.top_value(df, ["u"], "l").collect())) == {"u": "a", "v": "z"}


def test_sweep_small(spark):
    rows = [("a", 0, 1.0, "x"), ("a", 1, 3.0, "x"), ("b", 0, 5.0, "y"), ("c", 0, None, "z"), ("c", 1, None, "z")]
    got = bots.bot_sweep(frame(spark, rows), windows=[2], thresholds=[1, 2, 3]).orderBy("threshold").collect()
    # the two posts of c have no sentiment at all and drop out
    assert [tuple(r)[1:] for r in got] == [(1, 2, (2.5 + 5) / 2, "x"), (2, 1, 2.0, "x"), (3, 0, None, None)]
