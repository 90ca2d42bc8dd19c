"""Regressions against explicit dummy matrices in numpy."""

import numpy as np
import pandas as pd
import pytest

from geopanel.operators import regress


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 600
    county = np.where(rng.random(n) < 0.35, 0, rng.integers(1, 14, n))
    date = rng.integers(0, 20, n)
    user = rng.integers(0, 60, n)
    x = rng.normal(size=n) + county * 0.1
    t = rng.normal(size=n) + date * 0.05
    y = 0.5 * x - 0.3 * t + 0.1 * t * t + county * 0.2 + np.sin(date) + user * 0.02 + rng.normal(size=n)
    return pd.DataFrame({
        "county": [f"c{v}" for v in county], "date": date, "day": date % 7, "user": user,
        "x": x, "t": t, "y": y, "y2": y * 2 + x, "w": rng.integers(1, 9, n).astype(float),
        "z1": x + rng.normal(size=n), "z2": x - rng.normal(size=n),
    })


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data).cache()


def dummies(data, effects):
    return np.hstack([pd.get_dummies(data[e]).to_numpy(float) for e in effects])


def reference(data, y, xs, effects, w=None):
    """Coefficients, residuals and residualised regressors by brute force."""
    w = np.ones(len(data)) if w is None else data[w].to_numpy()
    root = np.sqrt(w)[:, None]
    d = dummies(data, effects)
    x = data[xs].to_numpy()
    full = np.hstack([x, d])
    beta = np.linalg.lstsq(full * root, data[y].to_numpy() * root[:, 0], rcond=None)[0]
    swept = x - d @ np.linalg.lstsq(d * root, x * root, rcond=None)[0]
    return beta[: len(xs)], data[y].to_numpy() - full @ beta, swept, w


def meat(swept, resid, w, groups):
    scores = pd.DataFrame(swept * (w * resid)[:, None]).groupby(groups).sum().to_numpy()
    return scores.T @ scores, len(scores)


@pytest.mark.parametrize(
    "effects, weights",
    [(["county"], "w"), (["county", "date", "day"], None), (["county", "date", "user"], "w")],
)
def test_coefficients(frame, data, effects, weights):
    fit = regress.fe_regression(frame, ["y", "y2"], ["x", "t"], effects, weights=weights)
    for j, y in enumerate(["y", "y2"]):
        want = reference(data, y, ["x", "t"], effects, weights)[0]
        assert fit.estimates[:, j] == pytest.approx(want, abs=1e-6)


def test_heavy_levels_change_nothing(frame, data):
    fit = regress.fe_regression(frame, ["y"], ["x"], ["county", "date"], min_rows=5)
    assert fit.estimates[:, 0] == pytest.approx(reference(data, "y", ["x"], ["county", "date"])[0], abs=1e-6)


def test_two_way_clusters(frame, data):
    effects = ["county", "date"]
    fit = regress.fe_regression(frame, ["y"], ["x", "t"], effects, cluster=["county", "date"], weights="w")
    beta, resid, swept, w = reference(data, "y", ["x", "t"], effects, "w")
    inv = np.linalg.inv((swept * w[:, None]).T @ swept)
    ma, ga = meat(swept, resid, w, data["county"].to_numpy())
    mb, gb = meat(swept, resid, w, data["date"].to_numpy())
    mc, _ = meat(swept, resid, w, (data["county"] + "|" + data["date"].astype(str)).to_numpy())
    g, n = min(ga, gb), len(data)
    params = 2 + (ga + gb - 1) - (ga - 1) - (gb - 1)
    cov = inv @ (ma + mb - mc) @ inv * g / (g - 1) * (n - 1) / (n - params)
    assert fit.errors[:, 0] == pytest.approx(np.sqrt(np.diag(cov)), rel=1e-5)
    assert fit.dof == g - 1


def test_cluster_outside_the_effects(frame, data):
    fit = regress.fe_regression(frame, ["y"], ["x"], ["date"], cluster=["county"], small_sample=False)
    _, resid, swept, w = reference(data, "y", ["x"], ["date"])
    m, _ = meat(swept, resid, w, data["county"].to_numpy())
    inv = np.linalg.inv(swept.T @ swept)
    assert fit.errors[0, 0] == pytest.approx(np.sqrt((inv @ m @ inv)[0, 0]), rel=1e-6)


def test_collinear_regressor_is_left_out(spark, data):
    rows = data.assign(copy=data["x"] * 2, flat=data["date"] * 1.0)
    fit = regress.fe_regression(spark.createDataFrame(rows), ["y"], ["x", "copy", "flat"], ["county", "date"])
    assert np.isnan(fit.estimates[1, 0]) and np.isnan(fit.estimates[2, 0])
    assert fit.estimates[0, 0] == pytest.approx(reference(data, "y", ["x"], ["county", "date"])[0][0], abs=1e-6)


def test_rows_with_gaps_are_dropped(spark, data):
    rows = data.copy()
    rows.loc[::10, "x"] = np.nan
    fit = regress.fe_regression(spark.createDataFrame(rows), ["y"], ["x"], ["county"])
    kept = rows.dropna()
    assert fit.n == len(kept)
    assert fit.estimates[0, 0] == pytest.approx(reference(kept, "y", ["x"], ["county"])[0][0], abs=1e-8)


def test_ols_with_square(frame, data):
    fit = regress.ols(regress.with_squares(frame, ["t"]), ["y"], ["x", "t", "t_sq"], weights="w")
    design = np.column_stack([np.ones(len(data)), data.x, data.t, data.t**2])
    w = data.w.to_numpy()
    inv = np.linalg.inv((design * w[:, None]).T @ design)
    beta = inv @ (design * w[:, None]).T @ data.y
    resid = data.y - design @ beta
    se = np.sqrt(np.diag(inv) * (w * resid**2).sum() / (len(data) - 4))
    assert fit.estimates[:, 0] == pytest.approx(beta, abs=1e-8)
    assert fit.errors[:, 0] == pytest.approx(se, rel=1e-8)


def test_two_stage(frame, data):
    fit = regress.two_stage_ls(frame, ["y"], ["x"], ["t"], ["z1", "z2"])
    x = np.column_stack([np.ones(len(data)), data.x, data.t])
    z = np.column_stack([np.ones(len(data)), data.t, data.z1, data.z2])
    hat = z @ np.linalg.solve(z.T @ z, z.T @ x)
    beta = np.linalg.solve(hat.T @ x, hat.T @ data.y)
    resid = data.y - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(hat.T @ hat)) * (resid @ resid) / (len(data) - 3))
    assert fit.estimates[:, 0] == pytest.approx(beta, abs=1e-8)
    assert fit.errors[:, 0] == pytest.approx(se, rel=1e-8)


def test_two_stage_by_hand(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0), (2.0, 1.0, 3.0), (4.0, 1.0, 7.0), (5.0, 2.0, 9.0)], "x double, z double, y double")
    assert regress.two_stage_ls(df, ["y"], ["x"], [], ["z"]).estimates[1, 0] == pytest.approx(1.75)


def test_student_quantiles():
    known = {1: 12.7062, 2: 4.3027, 3: 3.1824, 10: 2.2281, 30: 2.0423, 1000: 1.9623, 1e7: 1.95996}
    for dof, t in known.items():
        assert regress.student_quantile(0.975, dof) == pytest.approx(t, abs=1e-3)
    assert regress.student_quantile(0.025, 10) == pytest.approx(-2.2281, abs=1e-3)


def test_bins_and_table(spark, data):
    rows = data.assign(pm=np.where(data.x < -0.5, "[0,5]", np.where(data.x < 1, "(5,10]", "(70,Inf]")))
    df = spark.createDataFrame(rows)
    breaks = [float(v) for v in range(0, 75, 5)] + [float("inf")]
    fit = regress.fe_bins(df, ["y"], "pm", breaks, ["t"], ["county", "date"], cluster=["county"])
    table = regress.coef_table(fit, spark, "pm", breaks).orderBy("position").collect()
    assert [(r["interval"], r["position"]) for r in table] == [("[0,5]", 0), ("(5,10]", 1), ("(70,Inf]", 14)]
    extra = rows.assign(b1=(rows.pm == "(5,10]") * 1.0, b2=(rows.pm == "(70,Inf]") * 1.0)
    want = reference(extra, "y", ["b1", "b2", "t"], ["county", "date"])[0]
    assert [r["estimate"] for r in table] == pytest.approx([0, *want[:2]], abs=1e-6)
    assert all(r["ci_low"] <= r["estimate"] <= r["ci_high"] for r in table)
