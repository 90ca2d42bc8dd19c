"""Local regression of short series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.functions.missing import present
from geopanel.ordered import running_totals
from geopanel.skew import join_bounded, materialize

#: The box around the points is wider than them by this share of its width on each side.
MARGIN = 0.005

def local_quadratic(x: np.ndarray, y: np.ndarray, n: np.ndarray, span: float) -> np.ndarray:
    """LOESS values at ``x``: quadratic fits with tricube weights.

    ``n`` counts the points behind each distinct x. The bandwidth reaches the
    q-th nearest point, q = floor(total * span).
    """
    total = n.sum()
    q = max(int(np.floor(total * span + 1e-5)), 1)
    out = np.full(len(x), np.nan)
    for i, centre in enumerate(x):
        distance = np.abs(x - centre)
        order = np.argsort(distance, kind="stable")
        reach = distance[order][np.searchsorted(np.cumsum(n[order]), q)] * max(span, 1.0)
        ratio = distance / reach if reach > 0 else np.where(distance > 0, 2.0, 0.0)
        weight = np.where(ratio < 1, (1 - np.minimum(ratio, 1) ** 3) ** 3, 0.0) * n
        root = np.sqrt(weight)[:, None]
        design = np.vander(x - centre, 3, increasing=True)
        fitted = np.linalg.lstsq(design * root, y * root[:, 0], rcond=None)[0]
        out[i] = fitted[0]
    return out


def loess_by_group(
    df: DataFrame, keys: list[str], x: str, y: str, span: float = 0.75, name: str = "smooth"
) -> DataFrame:
    """Smooth ``y`` over ``x`` inside every group: (keys, x, y mean, n, smooth).

    Equal x values are averaged first, which leaves the fit unchanged, so a
    group has as many rows as there are distinct x (bins), however many points
    lie behind them.
    """
    means = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias(x)).agg(
        F.avg(y).alias(y), F.count(F.lit(1)).alias("n")
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(x)
        values = local_quadratic(group[x].to_numpy(float), group[y].to_numpy(float), group["n"].to_numpy(float), span)
        return group.assign(**{name: values})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in means.schema.fields) + f", `{name}` double"
    return means.groupBy(*keys).applyInPandas(fit, schema)


def _solve(batches):
    """Value and slope at each vertex from its weighted moments (pseudo-inverse where points are too few)."""
    for b in batches:
        s = b[[f"_s{k}" for k in range(5)]].to_numpy(float)
        t = b[["_t0", "_t1", "_t2"]].to_numpy(float)
        normal = np.stack([s[:, i : i + 3] for i in range(3)], axis=1)
        beta = (np.linalg.pinv(normal, rcond=1e-10, hermitian=True) @ t[:, :, None])[:, :, 0] if len(b) else t
        reach = b["_reach"].to_numpy(float)
        slope = np.divide(beta[:, 1], reach, out=np.zeros(len(b)), where=reach > 0)
        bare = s[:, 0] == 0  # all near points lie on the edge of the window
        edge = np.divide(b["_te"].to_numpy(float), b["_se"].to_numpy(float), out=np.zeros(len(b)), where=bare)
        b["_value"], b["_slope"] = np.where(bare, edge, beta[:, 0]), np.where(bare, 0.0, slope)
        yield b.drop(columns=[c for c in b.columns if c[:2] in ("_s", "_t") and c != "_slope"])


def _cuts(ranked: DataFrame, sizes: DataFrame, keys: list[str], x: str, share: float) -> DataFrame:
    """(keys, _v): where cells of more than ``share`` of the points are halved, level by level.

    A cell is cut between two different x, at the place nearest to its middle
    rank (of two, the upper), half-way between them.
    """
    cells = sizes.select(*keys, F.lit(1).cast("long").alias("_l"), F.col("_n").alias("_u"), F.floor(F.col("_n") * share + 1e-9).alias("_most"))
    found = None
    while True:
        cells = materialize(cells.where(F.col("_u") - F.col("_l") + 1 > F.col("_most")), "loess-cells")
        if cells.isEmpty():
            return found
        inside = join_bounded(
            ranked, cells, keys, null_safe=True, condition=(F.col("_upto") >= F.col("_l")) & (F.col("_upto") <= F.col("_u"))
        )
        middle = F.floor((F.col("_l") + F.col("_u")) / 2)
        after, before = F.col("_upto"), F.col("_upto") - F.col("n")
        place = lambda c: F.struct(F.abs(c - middle).alias("off"), (-c).alias("rank"), F.col(x).alias("x"))
        halves = inside.groupBy(*keys, "_l", "_u", "_most").agg(
            F.min(F.when(after < F.col("_u"), place(after))).alias("_left"),
            F.min(F.when(before >= F.col("_l"), place(before))).alias("_right"),
        )
        halves = materialize(halves.where("_left IS NOT NULL"), "loess-cuts")
        cut = halves.select(*keys, ((F.col("_left.x") + F.col("_right.x")) / 2).alias("_v"))
        found = cut if found is None else found.unionByName(cut)
        rank = -F.col("_left.rank")
        parts = F.array(
            F.struct(F.col("_l").alias("_l"), rank.alias("_u")), F.struct((rank + 1).alias("_l"), F.col("_u").alias("_u"))
        )
        cells = halves.select(*keys, "_most", F.inline(parts))


def loess_by_vertices(
    df: DataFrame, keys: list[str], x: str, y: str, span: float = 0.75, cell: float = 0.2, name: str = "smooth"
) -> DataFrame:
    """Smooth ``y`` over ``x`` by fits at a few vertices and cubic blending: (keys, x, y mean, n, smooth).

    The usual way of LOESS: a group's range, widened by ``MARGIN``, is halved
    until no cell has more than ``span * cell`` of its points; local quadratics
    (tricube weights, reaching the q-th nearest point) give value and slope at
    the ends of the cells, and a cubic through both lies between them.

    Ranks, windows and moments are prefix scans and sums, so no group is held
    in one task, whatever its number of different x; a group has at most some
    4 / (span * cell) vertices. Missing x or y are left out. If all points that
    a vertex reaches lie on the edge of its window, it takes their mean.
    """
    df = df.where(present(x).isNotNull() & present(y).isNotNull())
    means = df.groupBy(*keys, F.col(x).cast("double").alias(x)).agg(F.avg(y).alias(y), F.count(F.lit(1)).alias("n"))
    ranked = materialize(running_totals(means, keys, [x], None, {"_upto": F.col("n")}), "loess-ranks")
    sizes = materialize(ranked.groupBy(*keys).agg(F.sum("n").alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi")), "loess-sizes")
    wide = F.greatest(F.col("_hi") - F.col("_lo"), F.greatest(F.abs("_lo"), F.abs("_hi")) * 1e-3 + 1e-30) * MARGIN
    ends = sizes.select(*keys, F.explode(F.array(F.col("_lo") - wide, F.col("_hi") + wide)).alias("_v"))
    cuts = _cuts(ranked, sizes, keys, x, span * cell)
    vertices = materialize(ends if cuts is None else ends.unionByName(cuts), "loess-vertices")

    distance = F.abs(F.col(x) - F.col("_v"))
    apart = join_bounded(ranked.select(*keys, x, "n"), vertices, keys, null_safe=True)
    counted = running_totals(apart.withColumn("_d", distance), [*keys, "_v"], ["_d"], None, {"_near": F.col("n")})
    counted = join_bounded(counted, sizes.select(*keys, "_n"), keys, null_safe=True)
    nearest = F.greatest(F.floor(F.col("_n") * span + 1e-5), F.lit(1))
    reach = counted.groupBy(*keys, "_v").agg(F.min(F.when(F.col("_near") >= F.least(nearest, F.col("_n")), F.col("_d"))).alias("_reach"))
    reach = materialize(reach.withColumn("_reach", F.col("_reach") * max(span, 1.0)), "loess-reach")

    near = join_bounded(ranked, reach, keys, null_safe=True, condition=distance <= F.col("_reach"))
    u = F.when(F.col("_reach") > 0, (F.col(x) - F.col("_v")) / F.col("_reach")).otherwise(0.0)
    near = near.withColumn("_u", u).withColumn("_w", F.pow(1 - F.pow(F.abs("_u"), 3), 3) * F.col("n"))
    at_edge = F.when(F.abs("_u") == 1, F.col("n")).otherwise(0)
    moments = near.groupBy(*keys, "_v", "_reach").agg(
        *[F.sum(F.col("_w") * F.pow("_u", F.lit(k))).alias(f"_s{k}") for k in range(5)],
        *[F.sum(F.col("_w") * F.pow("_u", F.lit(k)) * F.col(y)).alias(f"_t{k}") for k in range(3)],
        F.sum(at_edge).cast("double").alias("_se"),
        F.sum(at_edge * F.col(y)).cast("double").alias("_te"),
    )
    fields = moments.select(*keys, "_v", "_reach").schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _value double, _slope double"
    fitted = moments.mapInPandas(_solve, schema)
    curve = fitted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_v", "_value", "_slope"))).alias("_curve"))

    placed = join_bounded(ranked.drop("_upto"), materialize(curve, "loess-curves"), keys, null_safe=True)
    placed = placed.withColumn("_a", F.element_at(F.filter("_curve", lambda v: v["_v"] <= F.col(x)), -1))
    placed = placed.withColumn("_b", F.element_at(F.filter("_curve", lambda v: v["_v"] > F.col(x)), 1))
    w = F.col("_b._v") - F.col("_a._v")
    t = (F.col(x) - F.col("_a._v")) / w
    values = (1 - t) * (1 - t) * (1 + 2 * t) * F.col("_a._value") + t * t * (3 - 2 * t) * F.col("_b._value")
    slopes = t * (1 - t) * (1 - t) * F.col("_a._slope") - t * t * (1 - t) * F.col("_b._slope")
    return placed.withColumn(name, values + slopes * w).drop("_curve", "_a", "_b")
