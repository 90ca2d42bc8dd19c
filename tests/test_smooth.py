"""LOESS at vertices against a plain version on single points."""

import numpy as np
import pytest

from geopanel.operators import smooth
from geopanel.operators.smooth import MARGIN


def plain(x, y, span=0.75, cell=0.2):
    """Smoothed values at every point, all points listed singly."""
    order = np.argsort(x, kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    n = len(x)
    most, q = int(n * span * cell + 1e-9), int(n * span + 1e-5)
    wide = MARGIN * max(x[-1] - x[0], max(abs(x[0]), abs(x[-1])) * 1e-3 + 1e-30)
    vertices = [x[0] - wide, x[-1] + wide]

    def halve(first, last):  # 0-based, inclusive
        if last - first + 1 <= most:
            return
        middle = (first + 1 + last + 1) // 2
        places = [r for r in range(first + 1, last + 1) if x[r - 1] != x[r]]
        if places:
            r = min(places, key=lambda r: (abs(r - middle), -r))
            vertices.append((x[r - 1] + x[r]) / 2)
            halve(first, r - 1)
            halve(r, last)

    halve(0, n - 1)
    vertices.sort()
    fits = []
    for v in vertices:
        d = np.abs(x - v)
        h = np.sort(d)[q - 1]
        w = np.where(d < h, (1 - (np.minimum(d, h) / h) ** 3) ** 3, 0)
        if not w.any():
            fits.append((y[d == h].mean(), 0.0))
            continue
        root = np.sqrt(w)[:, None]
        b = np.linalg.lstsq(np.vander((x - v) / h, 3, increasing=True) * root, y * root[:, 0], rcond=1e-6)[0]
        fits.append((b[0], b[1] / h))
    out = {}
    for value in set(x):
        i = int(np.searchsorted(vertices, value, "right")) - 1
        (y0, s0), (y1, s1), w = fits[i], fits[i + 1], vertices[i + 1] - vertices[i]
        c = (y0, s0 * w, 3 * (y1 - y0) - (2 * s0 + s1) * w, 2 * (y0 - y1) + (s0 + s1) * w)
        t = (value - vertices[i]) / w
        out[float(value)] = sum(k * t**p for p, k in enumerate(c))
    return out


def test_vertices_against_plain(spark):
    rng = np.random.default_rng(5)
    groups = {
        "bins": np.arange(15.0),
        "many": rng.normal(size=400).round(2),
        "ties": rng.integers(0, 6, 200).astype(float),
        "heavy": np.r_[np.full(60, 2.0), rng.uniform(0, 9, 90)],
        "far": 1e6 + rng.exponential(50, 120),
        None: rng.uniform(-1, 1, 40),
    }
    rows, want = [], {}
    for g, x in groups.items():
        y = np.sin(x / 3) + rng.normal(size=len(x)) / 5
        rows += [(g, float(a), float(b)) for a, b in zip(x, y)]
        want |= {(g, a): v for a, v in plain(x, y).items()}
    rows += [("bins", None, 1.0), ("bins", 3.0, float("nan")), ("many", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    got = {(r["g"], r["x"]): r["smooth"] for r in smooth.loess_by_vertices(df, ["g"], "x", "y").collect()}
    assert set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-8


def test_vertices_keep_quadratics_and_single_points(spark):
    rows = [("q", float(v), 2.0 + v) for v in range(30)] + [("one", 4.0, 7.0), ("one", 4.0, 9.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = smooth.loess_by_vertices(df, ["g"], "x", "y").collect()
    assert len(got) == 31
    assert all(r["smooth"] == pytest.approx(r["y"], abs=1e-9) for r in got)


def test_vertices_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, x double, y double")
    assert smooth.loess_by_vertices(df, ["g"], "x", "y").collect() == []
