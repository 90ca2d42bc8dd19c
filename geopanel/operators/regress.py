"""Regressions from distributed moments.

Spark computes sums; the driver only ever sees matrices whose size is the
number of regressors, and a bounded list of effect levels with a value for each
variable. Fixed effects are absorbed on a table with one row per combination of
effect (and cluster) levels, or on the rows if that table would be larger.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geopanel.functions.bins import bin_labels
from geopanel.operators.absorb import NotConverged, absorbed_products
from geopanel.skew import BROADCAST_BYTES, HEAVY_MIN_ROWS, crowded_keys, discard, materialize, repeated, salted

COEFFICIENTS = T.StructType(
    [
        T.StructField("outcome", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("estimate", T.DoubleType()),
        T.StructField("se", T.DoubleType()),
        T.StructField("ci_low", T.DoubleType()),
        T.StructField("ci_high", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ]
)
INTERCEPT = "(Intercept)"
SMALL = 1e-10
NODES, NODE_WEIGHTS = np.polynomial.legendre.leggauss(200)


@dataclass
class Fit:
    """Coefficients of several outcomes, with their standard errors."""

    terms: list[str]
    outcomes: list[str]
    estimates: np.ndarray  # terms x outcomes
    errors: np.ndarray
    n: int
    dof: float
    rounds: int = 0

    def table(self, spark, level: float = 0.95) -> DataFrame:
        """Tidy table: one row per outcome and term, with confidence limits."""
        t = student_quantile(0.5 + level / 2, self.dof) if self.dof > 0 else math.nan
        rows = []
        for j, outcome in enumerate(self.outcomes):
            for i, term in enumerate(self.terms):
                b, se = float(self.estimates[i, j]), float(self.errors[i, j])
                values = [b, se, b - t * se, b + t * se]
                rows.append((outcome, term, *[None if math.isnan(v) else v for v in values], self.n))
        return spark.createDataFrame(rows, COEFFICIENTS)


def student_cdf(t: float, dof: float) -> float:
    """Student's t distribution function, by its finite-interval integral."""
    # with t = sqrt(dof) * tan(a) the density is proportional to cos(a)**(dof - 1)
    limit = math.atan(abs(t) / math.sqrt(dof))

    def area(b: float) -> float:
        a = (NODES + 1) * b / 2
        return float(np.sum(NODE_WEIGHTS * np.cos(a) ** (dof - 1)) * b / 2)

    # beyond this angle the integrand is below double precision
    edge = min(math.pi / 2, 12 / math.sqrt(max(dof - 1, 1e-9))) if dof > 4 else math.pi / 2
    half = area(min(limit, edge)) / area(edge) / 2
    return 0.5 + math.copysign(half, t)


def student_quantile(p: float, dof: float) -> float:
    """Inverse of :func:`student_cdf` by bisection."""
    low, high = -1.0, 1.0
    while student_cdf(high, dof) < p:
        high *= 2
    while student_cdf(low, dof) > p:
        low *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if student_cdf(mid, dof) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def _solve(gram: np.ndarray, right: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Coefficients and inverse Gram matrix, leaving out collinear columns.

    ``scale`` holds the columns' sums of squares before anything was absorbed;
    a column with next to nothing left of it is not identified.
    """
    kept: list[int] = []
    for j in range(len(gram)):
        rest = gram[j, j]
        if kept:
            block = gram[np.ix_(kept, kept)]
            rest -= gram[j, kept] @ np.linalg.solve(block, gram[kept, j])
        if rest > SMALL * max(scale[j], 1e-300):
            kept.append(j)
    inverse = np.full_like(gram, np.nan)
    beta = np.full((len(gram), right.shape[1]), np.nan)
    if kept:
        block = np.linalg.inv(gram[np.ix_(kept, kept)])
        inverse[np.ix_(kept, kept)] = block
        beta[kept] = block @ right[kept]
    return beta, inverse, kept


def _centred_moments(df: DataFrame, columns: list[str], weights: str | None) -> tuple[float, int, np.ndarray, np.ndarray]:
    """Weight sum, row count, weighted means and centred cross products of ``columns``."""
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    k = len(columns)
    first = df.agg(F.count(F.lit(1)), F.sum(w), *[F.sum(w * F.col(c)) for c in columns]).first()
    n, total = first[0], float(first[1] or 0.0)
    if not n:
        raise ValueError("no complete rows")
    means = np.array([first[2 + i] for i in range(k)]) / total
    spread = [F.col(c) - F.lit(float(means[i])) for i, c in enumerate(columns)]
    sums = df.agg(*[F.sum(w * spread[i] * spread[j]) for i in range(k) for j in range(i, k)]).first()
    cross = np.zeros((k, k))
    at = 0
    for i in range(k):
        for j in range(i, k):
            cross[i, j] = cross[j, i] = sums[at]
            at += 1
    return total, n, means, cross


def with_squares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_sq`` for quadratic terms."""
    return df.withColumns({f"{c}_sq": F.col(c) * F.col(c) for c in columns})


def with_dummies(df: DataFrame, column: str, levels: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """0/1 columns for all but the first level that occurs, named ``<column><level>``.

    Which levels occur is counted by Spark; ``levels`` gives their order.
    """
    seen = df.agg(*[F.max((F.col(column) == level).cast("int")) for level in levels]).first()
    present = [level for level, hit in zip(levels, seen) if hit]
    names = [f"{column}{level}" for level in present[1:]]
    flags = {n: (F.col(column) == level).cast("double") for n, level in zip(names, present[1:])}
    return df.withColumns(flags), names


def ols(df: DataFrame, outcomes: list[str], regressors: list[str], weights: str | None = None) -> Fit:
    """Least squares with an intercept; classical standard errors."""
    columns = [*regressors, *outcomes]
    rows = df.select(*[_q(c) for c in columns], *([weights] if weights else []))
    rows, names = _plain(rows, columns, weights)
    total, n, means, cross = _centred_moments(rows, names, "_w" if weights else None)
    k = len(regressors)
    sxx, sxy = cross[:k, :k], cross[:k, k:]
    beta, inverse, kept = _solve(sxx, sxy, np.diag(sxx))
    dof = n - len(kept) - 1
    b = np.nan_to_num(beta)
    intercept = means[k:] - means[:k] @ b
    rss = np.diag(cross[k:, k:]) - np.sum(b * sxy, axis=0)
    sigma2 = np.maximum(rss, 0) / dof
    slope_se = np.sqrt(np.outer(np.diag(inverse), sigma2))
    mean_part = means[:k] @ np.nan_to_num(inverse) @ means[:k]
    const_se = np.sqrt((1 / total + mean_part) * sigma2)
    return Fit(
        [INTERCEPT, *regressors],
        list(outcomes),
        np.vstack([intercept, beta]),
        np.vstack([const_se, slope_se]),
        n,
        dof,
    )


def two_stage_ls(
    df: DataFrame, outcomes: list[str], endogenous: list[str], exogenous: list[str], instruments: list[str]
) -> Fit:
    """Instrumental variables: ``y ~ endogenous + exogenous | exogenous + instruments``.

    Two passes give all cross moments; the two stages are then matrix algebra
    on them. Classical standard errors from the structural residuals.
    """
    columns = [*endogenous, *exogenous, *instruments, *outcomes]
    rows, names = _plain(df.select(*[_q(c) for c in columns]), columns, None)
    total, n, means, cross = _centred_moments(rows, names, None)
    a, b, c = len(endogenous), len(exogenous), len(instruments)
    x = list(range(a + b))
    z = list(range(a, a + b + c))
    y = list(range(a + b + c, len(columns)))
    szz, szx, szy = cross[np.ix_(z, z)], cross[np.ix_(z, x)], cross[np.ix_(z, y)]
    project = np.linalg.pinv(szz, hermitian=True) @ szx
    gram = szx.T @ project
    beta, inverse, kept = _solve(gram, project.T @ szy, np.diag(cross)[x])
    dof = n - len(kept) - 1
    bb = np.nan_to_num(beta)
    sxx, sxy, syy = cross[np.ix_(x, x)], cross[np.ix_(x, y)], np.diag(cross)[y]
    rss = syy - 2 * np.sum(bb * sxy, axis=0) + np.sum(bb * (sxx @ bb), axis=0)
    sigma2 = np.maximum(rss, 0) / dof
    mx, my = means[x], means[y]
    mean_part = mx @ np.nan_to_num(inverse) @ mx
    return Fit(
        [INTERCEPT, *endogenous, *exogenous],
        list(outcomes),
        np.vstack([my - mx @ bb, beta]),
        np.vstack([np.sqrt((1 / total + mean_part) * sigma2), np.sqrt(np.outer(np.diag(inverse), sigma2))]),
        n,
        dof,
    )


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _plain(df: DataFrame, columns: list[str], weights: str | None) -> tuple[DataFrame, list[str]]:
    """Complete rows with the columns renamed v0, v1, … and cast to double."""
    names = [f"v{i}" for i in range(len(columns))]
    picked = [_q(c).cast("double").alias(n) for c, n in zip(columns, names)]
    if weights:
        picked.append(_q(weights).cast("double").alias("_w"))
    return df.select(*picked).dropna("any"), names


def fe_regression(
    df: DataFrame,
    outcomes: list[str],
    regressors: list[str],
    effects: list[str],
    cluster: list[str] | None = None,
    weights: str | None = None,
    tol: float = 1e-8,
    max_rounds: int = 1000,
    small_sample: bool = True,
    min_rows: int | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> Fit:
    """Weighted least squares with any number of absorbed fixed effects.

    1. Rows are summed up to one row per combination of effect and cluster
       levels: weight, means and within products. If so many combinations
       occur that this table would be larger, the rows are written as they are.
    2. The effects' level means are swept out of all variables on that table,
       to a relative accuracy of ``tol``, as :mod:`geopanel.operators.absorb`
       has it. If the levels of all effects but the largest take more than
       ``max_bytes``, every round sweeps and writes the whole table.
    3. Products of the swept variables are summed up by cluster levels; their
       Gram matrix goes to the driver.

    A fit that has not reached ``tol`` after ``max_rounds``, or whose search
    breaks down, raises :class:`NotConverged`; there are no half-swept results.

    Standard errors are clustered on one or two variables (V_a + V_b - V_ab),
    or classical without ``cluster``. ``small_sample`` applies (n-1)/(n-K), not
    counting effects that equal a cluster variable, and G/(G-1) with the
    smallest number of clusters, which also sets the degrees of freedom.
    """
    cluster = list(cluster or [])
    if len(cluster) > 2:
        raise ValueError("at most two cluster variables")
    k, variables = len(regressors), [*regressors, *outcomes]
    m = len(variables)
    keys = list(dict.fromkeys([*effects, *cluster]))
    at = {key: f"k{i}" for i, key in enumerate(keys)}
    names = [f"v{i}" for i in range(m)]
    weight = _q(weights).cast("double") if weights else F.lit(1.0)
    rows = df.select(
        *[_level(df, key).alias(at[key]) for key in keys],
        weight.alias("_w"),
        *[_q(c).cast("double").alias(v) for c, v in zip(variables, names)],
    ).dropna("any").where(F.col("_w") > 0)

    combinations = F.approx_count_distinct(F.xxhash64(*at.values())) if keys else F.lit(1)
    scale = rows.agg(
        F.sum("_w"),
        *[F.sum(F.col("_w") * F.col(v)) for v in names],
        *[F.stddev_samp(v) for v in names],
        F.count(F.lit(1)),
        combinations,
    ).first()
    if not scale[0]:
        raise ValueError("no complete rows")
    means = [scale[1 + i] / scale[0] for i in range(m)]
    sds = [float(scale[1 + m + i] or 0.0) or 1.0 for i in range(m)]
    rows = rows.withColumns({v: (F.col(v) - means[i]) / sds[i] for i, v in enumerate(names)})

    pairs = [(i, j) for i in range(k) for j in range(i, m)] + [(i, i) for i in range(k, m)]
    # products inside cells make a row of the summed table wider
    summing = scale[2 + 2 * m] * (2 + m + len(pairs)) <= scale[1 + 2 * m] * (2 + m)
    if summing:
        summed = rows.groupBy(*at.values()).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("_w").alias("w"),
            *[F.expr(f"sum(_w * v{i}) AS s{i}") for i in range(m)],
            *[F.expr(f"sum(_w * v{i} * v{j}) AS p{i}_{j}") for i, j in pairs],
        )
        cells = summed.selectExpr(
            *at.values(),
            "n",
            "w",
            *[f"s{i} / w AS d{i}" for i in range(m)],
            *[f"p{i}_{j} - s{i} * s{j} / w AS c{i}_{j}" for i, j in pairs],
        )
    else:
        cells = rows.selectExpr(*at.values(), "1L AS n", "_w AS w", *[f"v{i} AS d{i}" for i in range(m)])
    cells = materialize(cells, "fe-cells")

    sizes = _level_counts(cells, [at[e] for e in effects])
    by = list(dict.fromkeys(at[c] for c in cluster))
    found = None
    if effects:
        found = absorbed_products(
            cells, sizes, by, m, pairs, summing, float(scale[0]), tol, max_rounds, max_bytes, min_rows
        )
    if found is None:
        found = _table_products(cells, sizes, by, m, pairs, summing, tol, max_rounds, min_rows)
    done, rounds = found
    discard(cells)

    sums = done.agg(F.sum("n"), F.sum("w"), *[F.expr(f"sum(m{i}_{j})") for i, j in pairs]).first()
    n = int(sums[0])
    values = {pair: float(sums[2 + s]) for s, pair in enumerate(pairs)}
    gram = np.array([[values[min(i, j), max(i, j)] for j in range(k)] for i in range(k)])
    right = np.array([[values[i, j] for j in range(k, m)] for i in range(k)])
    total = np.array([values[j, j] for j in range(k, m)])
    beta, inverse, kept = _solve(gram, right, np.full(k, float(sums[1])))
    b, inv = np.nan_to_num(beta), np.nan_to_num(inverse)

    absorbed = sum(sizes.values()) - (len(effects) - 1) if effects else 1
    if cluster:
        nested = sum(sizes[at[e]] - 1 for e in effects if e in cluster)
        params = len(kept) + absorbed - nested
        groups = [[at[c]] for c in cluster]
        signs = [1.0] * len(cluster)
        if len(cluster) == 2:
            groups.append([at[c] for c in cluster])
            signs.append(-1.0)
        meats, counts = [], []
        for group in groups:
            meat, count = _meat(done, group, b, k, m)
            meats.append(meat)
            counts.append(count)
        fewest = min(counts[: len(cluster)])
        factor = fewest / (fewest - 1) * (n - 1) / max(n - params, 1) if small_sample else 1.0
        errors = np.full((k, m - k), np.nan)
        for j in range(m - k):
            cov = factor * inv @ sum(s * meat[j] for s, meat in zip(signs, meats)) @ inv
            errors[:, j] = np.sqrt(np.maximum(np.diag(_nearest_covariance(cov)), 0))
        dof = fewest - 1
    else:
        dof = n - len(kept) - absorbed
        rss = np.maximum(total - np.sum(b * right, axis=0), 0)
        errors = np.sqrt(np.outer(np.diag(inv), rss / max(dof, 1)))
    discard(done)
    ratio = np.array([[sds[k + j] / sds[i] for j in range(m - k)] for i in range(k)])
    missing = np.isnan(beta)
    errors = np.where(missing, np.nan, errors) * ratio
    return Fit(list(regressors), list(outcomes), beta * ratio, errors, n, dof, rounds)


def _level(df: DataFrame, key: str) -> Column:
    """The key, with one zero if it is a floating number."""
    floating = isinstance(df.select(_q(key)).schema[0].dataType, T.FloatType | T.DoubleType)
    return _q(key) + F.lit(0.0) if floating else _q(key)


def _table_products(
    cells: DataFrame,
    sizes: dict[str, int],
    by: list[str],
    m: int,
    pairs: list[tuple[int, int]],
    within: bool,
    tol: float,
    max_rounds: int,
    min_rows: int | None,
) -> tuple[DataFrame, int]:
    """As :func:`geopanel.operators.absorb.absorbed_products`, for any number of levels: rounds over the whole table."""
    columns = [f"d{i}" for i in range(m)]
    # the effect with most levels is taken out exactly at the start
    order = sorted(sizes, key=lambda e: -sizes[e])
    keys = list(dict.fromkeys([*sizes, *by]))
    swept, rounds = _absorb(cells.select(*keys, "n", "w", *columns), order, columns, tol, max_rounds, min_rows)
    parts = swept.selectExpr(*by, "n", "w", *[f"w * d{i} * d{j} AS m{i}_{j}" for i, j in pairs])
    if within:
        inside = cells.selectExpr(*by, "0L AS n", "0D AS w", *[f"c{i}_{j} AS m{i}_{j}" for i, j in pairs])
        parts = parts.unionByName(inside)
    sums = [F.sum(c).alias(c) for c in ["n", "w", *[f"m{i}_{j}" for i, j in pairs]]]
    done = materialize(parts.groupBy(*by).agg(*sums), "fe-products")
    if order:
        discard(swept)
    return done, rounds


def _level_counts(cells: DataFrame, effects: list[str]) -> dict[str, int]:
    """Number of levels per effect."""
    counts = None
    for e in effects:
        one = cells.select(e).distinct().agg(F.lit(e).alias("e"), F.count(F.lit(1)).alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    return {r["e"]: int(r["n"]) for r in counts.collect()} if effects else {}


def _nearest_covariance(cov: np.ndarray) -> np.ndarray:
    """Two-way clustering can leave negative eigenvalues; they are set to zero."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    if values.min() >= 0:
        return cov
    return (vectors * np.maximum(values, 0)) @ vectors.T


def _absorb(
    cells: DataFrame, effects: list[str], columns: list[str], tol: float, max_rounds: int, min_rows: int | None
) -> tuple[DataFrame, int]:
    """Take every effect's weighted level means out of ``columns``, all at once.

    One effect needs a single sweep. With more, sweeping in turn converges
    slowly when effects overlap little, so the sweeps are the operator of a
    conjugate-gradient iteration (Hernández-Ramos, Escalante and Raydan 2011):
    with T one forward-and-back sweep, it solves (I - T) f = (I - T) v for the
    effects' part f of v, and v - f remains. Every round is one job on the cell
    table; only its inner products reach the driver.
    """
    if not effects:
        return cells, 0
    cells, heavy = _salt_levels(cells, effects, min_rows)
    first, others = effects[:1], effects[1:]
    keys = [c for c in cells.columns if c not in columns]
    swept = _sweep(cells, first, columns, heavy)
    if not others:
        return materialize(swept, "fe-swept").drop(*_salts(effects)), 1

    back = [*others, *others[-2::-1], *first]
    w = F.col("w")

    def renamed(df: DataFrame, pick: dict[str, Column]) -> DataFrame:
        return df.select(*keys, *[e.alias(n) for n, e in pick.items()])

    # v itself and its image under the sweep give the first residual
    start = renamed(swept, {**{f"x_{c}": F.col(c) for c in columns}, **{f"u_{c}": F.col(c) for c in columns}})
    start = _sweep(start, back, [f"u_{c}" for c in columns], heavy)
    seen = Observation()
    start = start.observe(
        seen,
        F.sum(w).alias("weight"),
        *[F.sum(w * F.pow(F.col(f"x_{c}") - F.col(f"u_{c}"), 2)).alias(f"rr_{c}") for c in columns],
    )
    state = state_file = materialize(start, "fe-round")
    sizes = seen.get
    # the variables came in with unit variance, so the total weight is their size
    limit = {c: tol * tol * sizes["weight"] for c in columns}
    left = {c: sizes[f"rr_{c}"] for c in columns}
    gap = {c: F.col(f"x_{c}") - F.col(f"u_{c}") for c in columns}
    state = renamed(
        state,
        {
            **{f"x_{c}": F.col(f"x_{c}") for c in columns},
            **{f"r_{c}": gap[c] for c in columns},
            **{f"p_{c}": gap[c] for c in columns},
        },
    )
    rounds = 1
    while rounds < max_rounds and any(left[c] > limit[c] for c in columns):
        rounds += 1
        image = state.withColumns({f"u_{c}": F.col(f"p_{c}") for c in columns})
        image = _sweep(image, back, [f"u_{c}" for c in columns], heavy)
        image = image.withColumns({f"u_{c}": F.col(f"p_{c}") - F.col(f"u_{c}") for c in columns})
        seen = Observation()
        products = [("r", "r"), ("p", "u"), ("r", "u"), ("u", "u")]
        image = image.observe(
            seen,
            *[F.expr(f"sum(w * {a}_{c} * {b}_{c}) AS {a}{b}_{c}") for c in columns for a, b in products],
        )
        image = materialize(image, "fe-round")
        discard(state_file)
        state_file = image
        got = seen.get
        pick: dict[str, Column] = {}
        for c in columns:
            rr, pu, ru, uu = (got[f"{a}{b}_{c}"] for a, b in products)
            open_ = left[c] > limit[c]
            if open_ and not pu > 0:
                raise NotConverged(f"the search broke down in round {rounds}: {rr} left, {limit[c]} allowed")
            step = rr / pu if open_ else 0.0
            after = max(rr - 2 * step * ru + step * step * uu, 0.0)
            turn = after / rr if rr > 0 and step else 0.0
            left[c] = after if step else min(left[c], limit[c])
            residual = F.col(f"r_{c}") - F.lit(step) * F.col(f"u_{c}")
            pick[f"x_{c}"] = F.col(f"x_{c}") - F.lit(step) * F.col(f"p_{c}")
            pick[f"r_{c}"] = residual
            pick[f"p_{c}"] = residual + F.lit(turn) * F.col(f"p_{c}")
        state = renamed(image, pick)
    if any(left[c] > limit[c] for c in columns):
        worst = max(left[c] / limit[c] for c in columns)
        raise NotConverged(f"{rounds} rounds left {worst:.3g} times the error allowed")
    out = state.select(*[k for k in keys if k not in _salts(effects)], *[F.col(f"x_{c}").alias(c) for c in columns])
    return out, rounds


def _salts(effects: list[str]) -> list[str]:
    return [f"_salt_{e}" for e in effects]


def _salt_levels(
    cells: DataFrame, effects: list[str], min_rows: int | None
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Salt the cells of levels that hold very many of them.

    Returns the cells and, for the effects that have such levels, their list.
    """
    heavy = {}
    columns = cells.columns
    for e in effects:
        listed = crowded_keys(cells, [e], HEAVY_MIN_ROWS if min_rows is None else min_rows)
        if listed.isEmpty():
            continue
        heavy[e] = listed
        cells = salted(cells, listed, [e], columns, f"_salt_{e}")
    return cells, heavy


def _sweep(df: DataFrame, effects: list[str], columns: list[str], heavy: dict[str, DataFrame]) -> DataFrame:
    """Subtract weighted level means, effect after effect.

    The means of a heavy level are repeated per salt, so that joining them back
    never gathers the level.
    """
    for e in effects:
        mean = [F.expr(f"sum(w * {c}) / sum(w) AS _m_{c}") for c in columns]
        levels, on = df.groupBy(e).agg(*mean), [e]
        if e in heavy:
            levels = repeated(levels, heavy[e], [e], f"_salt_{e}")
            on = [e, f"_salt_{e}"]
        rest = [c for c in df.columns if c not in columns]
        df = df.join(levels, on).selectExpr(*rest, *[f"{c} - _m_{c} AS {c}" for c in columns])
    return df


def _meat(done: DataFrame, group: list[str], b: np.ndarray, k: int, m: int) -> tuple[list[np.ndarray], int]:
    """Sum over clusters of score outer products, per outcome, and the cluster count."""
    triangle = [(a, c) for a in range(k) for c in range(a, k)]
    scores = []
    for j in range(m - k):
        for i in range(k):
            known = " ".join(f"- ({float(b[h, j])!r}D) * m{min(i, h)}_{max(i, h)}" for h in range(k))
            scores.append(F.expr(f"sum(m{i}_{k + j} {known}) AS u{j}_{i}"))
    sums = done.groupBy(*group).agg(*scores)
    outer = [F.expr(f"sum(u{j}_{a} * u{j}_{c})") for j in range(m - k) for a, c in triangle]
    row = sums.agg(F.count(F.lit(1)), *outer).first()
    meats, at = [], 1
    for _ in range(m - k):
        meat = np.zeros((k, k))
        for a, c in triangle:
            meat[a, c] = meat[c, a] = row[at]
            at += 1
        meats.append(meat)
    return meats, int(row[0])


def fe_bins(
    df: DataFrame,
    outcomes: list[str],
    bin_column: str,
    breaks: list[float],
    controls: list[str],
    effects: list[str],
    **fitting,
) -> Fit:
    """Fixed-effects fit with one dummy per occupied bin, the lowest left out."""
    flagged, dummies = with_dummies(df, bin_column, bin_labels(breaks))
    return fe_regression(flagged, outcomes, [*dummies, *controls], effects, **fitting)


def coef_table(fit: Fit, spark, bin_column: str, breaks: list[float]) -> DataFrame:
    """Bin coefficients in interval order, with the reference bin as a zero row.

    Estimates and confidence limits meet on (outcome, term); terms of other
    regressors are left out. Adds the interval label and its position.
    """
    labels = bin_labels(breaks)
    table = fit.table(spark)
    values = table.select("outcome", "term", "estimate", "n")
    limits = table.select("outcome", "term", "se", "ci_low", "ci_high")
    bins = values.join(limits, ["outcome", "term"]).where(F.col("term").startswith(f"{bin_column}"))
    bins = bins.withColumn("interval", F.substring("term", len(bin_column) + 1, 100))
    zero = F.lit(0.0)
    base = table.select("outcome", "n").distinct().select(
        "outcome",
        F.lit(f"{bin_column}{labels[0]}").alias("term"),
        zero.alias("estimate"),
        "n",
        zero.alias("se"),
        zero.alias("ci_low"),
        zero.alias("ci_high"),
        F.lit(labels[0]).alias("interval"),
    )
    place = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("interval")) - 1
    return base.unionByName(bins).withColumn("position", place.cast("long"))


def robustness_suite(
    df: DataFrame,
    subsets: dict[str, Column],
    outcomes: list[str],
    regressors: list[str],
    effects: list[str],
    **fitting,
) -> DataFrame:
    """The same fit on several subsets (bots, fewer regions, one topic), in one table."""
    out = None
    for name, condition in subsets.items():
        fit = fe_regression(df.where(condition), outcomes, regressors, effects, **fitting)
        part = fit.table(df.sparkSession).withColumn("subset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
