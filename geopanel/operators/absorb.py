"""Fixed effects taken out of a cell table block by block.

The effect with most levels is taken out exactly inside blocks that hold whole
levels of it; its levels of more than a budget of cells count among the levels
of the other effects. What is left is a linear system over those. It is solved
by conjugate gradients: a round reads the blocks' level numbers and weights and
sums up a row for each level. Cells are shuffled and written once, whatever the
number of rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geopanel.skew import crowded_keys, discard, join_bounded, materialize, row_salt, shuffles_dropped

#: Cells of a block and of a level that is kept in one; cells of a shuffle partition; groups kept by a task.
BLOCK_CELLS, PART_CELLS, KEPT_GROUPS = 20_000, 250_000, 50_000
#: Bytes of a row group of the written blocks, which a reader holds at a time.
GROUP_BYTES = 16 << 20

PACKED = {"starts": "i4", "free": "?", "levels": "i4", "at": "i4", "ids": "i8", "n": "i8", "w": "f8", "d": "f8", "c": "f8"}

Batches = Iterator[pa.RecordBatch]


class NotConverged(RuntimeError):
    """The fixed effects could not be swept out to the accuracy asked for."""


@dataclass
class Block:
    """Cells of whole levels, one after another, of the effect taken out inside blocks.

    ``starts`` has the first cell of each level, ``free`` whether its mean stays.
    ``at`` has a row for each other effect: places in ``levels``, the level
    numbers that occur here; -1 is a level without a value.
    """

    starts: np.ndarray
    free: np.ndarray
    levels: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    n: np.ndarray
    w: np.ndarray
    d: np.ndarray
    c: np.ndarray

    def centred(self, values: np.ndarray) -> np.ndarray:
        """``values`` (variables x cells) without the means of the levels that are not free."""
        means = np.add.reduceat(self.w * values, self.starts, axis=1) / np.add.reduceat(self.w, self.starts)
        means[:, self.free] = 0.0
        return values - np.repeat(means, np.diff(self.starts, append=len(self.w)), axis=1)

    def spread(self, per_level: np.ndarray) -> np.ndarray:
        """Sum of the levels' values (levels x variables) in each cell."""
        here = np.ascontiguousarray(per_level[self.levels].T)
        out = np.zeros((len(here), len(self.w)))
        for places in self.at:
            out += here[:, places]
        return out

    def gathered(self, values: np.ndarray) -> np.ndarray:
        """Weighted sums (levels x variables) of ``values`` over the cells of each level."""
        out = np.zeros((len(values), len(self.levels)))
        for places in self.at:
            for row, v in zip(out, self.w * values):
                row += np.bincount(places, v, len(self.levels))
        return out.T


def _blocks(batches: Batches) -> Iterator[Block]:
    """The blocks of written rows; columns that were not read are empty."""
    for batch in batches:
        for row in batch.to_pylist():
            got = {k: np.frombuffer(row.get(k) or b"", kind) for k, kind in PACKED.items()}
            cells = len(got["w"])
            for k in ("at", "ids", "d", "c"):
                got[k] = got[k].reshape(-1, cells)
            yield Block(**got)


def _packed(task: int, codes: int, heavy: bool, ids: list[int | None], m: int, c: int, size: int, batches: Batches) -> Batches:
    """Rows of blocks from sorted cells.

    The columns are: whether a level starts, the number of a crowded level or
    -1, ``codes`` level numbers, the ids in ``ids`` that are None, n, w, ``m``
    variables, ``c`` products. Ids that are not None are the place of a level
    number, or -1 for the level that is kept in the block.
    """
    seen = 0
    kept: list[np.ndarray] | None = None

    def block(rows: list[np.ndarray]) -> pa.RecordBatch:
        nonlocal seen
        start, crowded = rows[0].copy(), rows[1]
        start[0] = True
        starts = np.flatnonzero(start).astype("i4")
        free = crowded[starts] >= 0
        numbers = np.stack([*rows[2 : 2 + codes], *([crowded] if heavy else [])]) if codes or heavy else np.zeros((0, len(start)), "i4")
        levels, at = np.unique(numbers, return_inverse=True)
        own = (task << 40) + seen + np.cumsum(start) - 1
        seen += len(starts)
        given = iter(rows[2 + codes :])
        groups = []
        for i in ids:
            group = next(given) if i is None else np.where(crowded >= 0, -1 - crowded, own) if i < 0 else rows[2 + i]
            groups.append(group.astype("i8"))
        n, w, *values = given
        arrays = {
            "starts": starts, "free": free, "levels": levels, "at": at, "ids": groups, "n": n, "w": w, "d": values[:m], "c": values[m:],
        }
        packed = [pa.array([np.ascontiguousarray(arrays[k], kind).tobytes()], pa.binary()) for k, kind in PACKED.items()]
        return pa.RecordBatch.from_arrays(packed, list(PACKED))

    for batch in batches:
        rows = [col.to_numpy(zero_copy_only=False) for col in batch.columns]
        kept = rows if kept is None else [np.concatenate(pair) for pair in zip(kept, rows)]
        while len(kept[0]) > size:
            # a level that is not crowded stays whole
            cuts = np.flatnonzero(kept[0] | (kept[1] >= 0))
            cuts = cuts[cuts > 0]
            before = cuts[cuts <= size]
            if not len(cuts):
                break
            cut = before[-1] if len(before) else cuts[0]
            yield block([r[:cut] for r in kept])
            kept = [r[cut:] for r in kept]
    if kept is not None and len(kept[0]):
        yield block(kept)


def _level_sums(levels: int, m: int, work: Callable[[Block], np.ndarray], batches: Batches) -> Batches:
    """(level, sums) of ``work`` over the blocks of a task."""
    total, seen = np.zeros((levels + 1, m)), np.zeros(levels + 1, bool)
    for b in _blocks(batches):
        total[b.levels] += work(b)
        seen[b.levels] = True
    # the last place is the level without a value
    found = np.flatnonzero(seen[:-1])
    yield pa.RecordBatch.from_arrays(
        [pa.array(found.astype("i4")), *[pa.array(total[found, i]) for i in range(m)]], ["level", *[f"q{i}" for i in range(m)]]
    )


def _first_sums(b: Block) -> np.ndarray:
    return b.gathered(np.vstack([b.centred(b.d), np.ones(len(b.w))]))


def _image(p: np.ndarray, b: Block) -> np.ndarray:
    return b.gathered(b.centred(b.spread(p)))


def _summed(ids: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of equal ids added up."""
    if not ids.shape[1]:
        return ids, sums
    order = np.lexsort(ids) if len(ids) else np.arange(sums.shape[1])
    ids, sums = ids[:, order], sums[:, order]
    new = np.ones(sums.shape[1], bool)
    new[1:] = (ids[:, 1:] != ids[:, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    return ids[:, first], np.add.reduceat(sums, first, axis=1)


def _products(x: np.ndarray, pairs: list[tuple[int, int]], names: list[str], most: int, batches: Batches) -> Batches:
    """Sums of weights and of products of the swept variables, by group; a task keeps ``most`` groups."""
    ids = sums = None

    def made() -> pa.RecordBatch:
        columns = [*map(pa.array, ids), pa.array(sums[0].astype("i8")), *map(pa.array, sums[1:])]
        return pa.RecordBatch.from_arrays(columns, names)

    for b in _blocks(batches):
        d = b.centred(b.d - b.spread(x))
        products = np.stack([b.n, b.w, *[b.w * d[i] * d[j] for i, j in pairs]])
        if len(b.c):
            products[2:] += b.c
        one = _summed(b.ids, products)
        if ids is not None:
            one = _summed(np.hstack([ids, one[0]]), np.hstack([sums, one[1]]))
        ids, sums = one
        if sums.shape[1] > most:
            yield made()
            ids = sums = None
    if ids is not None:
        yield made()


def _numbered(cells: DataFrame, key: str, name: str, first: int | None = None) -> DataFrame:
    """(key, name) of the levels, written: in a row from ``first``, or only distinct."""
    levels = cells.select(key).distinct()
    if first is None:
        return materialize(levels.select(key, F.monotonically_increasing_id().alias(name)), "fe-levels")
    number = F.monotonically_increasing_id() + first
    return materialize(levels.coalesce(1).select(key, number.cast("int").alias(name)), "fe-levels")


def absorbed_products(
    cells: DataFrame,
    sizes: dict[str, int],
    cluster: list[str],
    m: int,
    pairs: list[tuple[int, int]],
    within: bool,
    weight: float,
    tol: float,
    max_rounds: int,
    max_bytes: int,
    min_rows: int | None = None,
) -> tuple[DataFrame, int] | None:
    """Weight and product sums of the swept variables by cluster levels, written, and the rounds taken.

    ``cells`` has the keys, n, w, the means ``d0``, ``d1``, … and, if
    ``within``, the products inside cells ``c0_1``, …; ``sizes`` has the number
    of levels of each effect. Cluster levels come back as numbers. The result
    is None if the levels' values would take more than ``max_bytes``.
    """
    first, *others = sorted(sizes, key=lambda e: -sizes[e])
    count = sum(sizes[e] for e in others)
    if 8 * m * count > max_bytes:
        return None
    budget = BLOCK_CELLS if min_rows is None else min_rows
    crowded = crowded_keys(cells, [first], budget)
    heavy = crowded.count()
    if 8 * m * (count + heavy) > max_bytes:
        discard(crowded)
        return None
    numbered = materialize(
        crowded.coalesce(1).select(first, "_salts", (F.monotonically_increasing_id() + count).cast("int").alias("_crowded")), "fe-levels"
    )
    lists = [crowded, numbered]

    # level numbers, and the level that stays whole in a block
    coded = cells.join(F.broadcast(numbered), first, "left")
    coded = coded.withColumns({
        "_salt": F.when(F.col("_salts").isNotNull(), row_salt(cells.columns, F.col("_salts"))).otherwise(F.lit(0)),
        "_crowded": F.coalesce("_crowded", F.lit(-1)),
    })
    at = 0
    for e in others:
        lists.append(_numbered(cells, e, f"_code_{e}", at))
        coded = coded.join(F.broadcast(lists[-1]), e)
        at += sizes[e]
    ids: list[int | None] = []
    for c in cluster:
        ids.append(-1 if c == first else others.index(c) if c in others else None)
        if ids[-1] is None:
            lists.append(_numbered(cells, c, f"_id_{c}"))
            coded = join_bounded(coded, lists[-1], [c])
    parts = -(-cells.count() // PART_CELLS) or 1
    level = Window.partitionBy(first, "_salt").orderBy(F.lit(0))
    products = [f"c{i}_{j}" for i, j in pairs] if within else []
    coded = coded.repartition(parts, first, "_salt").select(
        (F.row_number().over(level) == 1).alias("_start"), "_crowded", *[f"_code_{e}" for e in others],
        *[f"_id_{c}" for c, i in zip(cluster, ids) if i is None], "n", "w", *[f"d{i}" for i in range(m)], *products,
    )
    pack = partial(_packed, codes=len(others), heavy=heavy > 0, ids=ids, m=m, c=len(products), size=BLOCK_CELLS)
    packed = coded.mapInArrow(
        lambda batches: pack(TaskContext.get().partitionId(), batches=batches), ", ".join(f"{k} binary" for k in PACKED)
    )
    blocks = materialize(packed, "fe-blocks", **{"parquet.block.size": GROUP_BYTES})
    for used in lists:
        discard(used)

    levels = count + heavy

    def level_sums(width: int, columns: list[str], work: Callable[[Block], np.ndarray]) -> np.ndarray:
        schema = ", ".join(["level int", *[f"q{i} double" for i in range(width)]])
        rows = blocks.select(*columns).mapInArrow(partial(_level_sums, levels, width, work), schema)
        with shuffles_dropped(cells.sparkSession):
            got = rows.groupBy("level").agg(*[F.sum(f"q{i}").alias(f"q{i}") for i in range(width)]).toArrow()
        out = np.zeros((levels, width))
        out[got["level"].to_numpy()] = np.column_stack([got[f"q{i}"].to_numpy() for i in range(width)])
        return out

    x, rounds = np.zeros((levels + 1, m)), 1
    if levels:
        shape = ["starts", "free", "levels", "at", "w"]
        sums = level_sums(m + 1, [*shape, "d"], _first_sums)
        left, sizes_of = sums[:, :m], sums[:, m:]
        move = left / sizes_of
        # the variables came in with unit variance, so the total weight is their size
        limit, size = tol * tol * weight, np.sum(left * move, axis=0)
        p = move
        while rounds < max_rounds and (size > limit).any():
            rounds += 1
            open_ = size > limit
            image = level_sums(m, shape, partial(_image, np.vstack([p, np.zeros(m)])))
            along = np.sum(p * image, axis=0)
            if not (along[open_] > 0).all():
                raise NotConverged(f"the search broke down in round {rounds}: {size[open_].max()} left, {limit} allowed")
            step = np.where(open_, size / np.where(open_, along, 1.0), 0.0)
            x[:-1] += step * p
            left = left - step * image
            move = left / sizes_of
            after = np.where(open_, np.sum(left * move, axis=0), size)
            p = np.where(open_, move + after / np.where(open_, size, 1.0) * p, 0.0)
            size = after
        if (size > limit).any():
            raise NotConverged(f"{rounds} rounds left {(size / limit).max():.3g} times the error allowed")

    names = [*cluster, "n", "w", *[f"m{i}_{j}" for i, j in pairs]]
    schema = ", ".join([*[f"{c} long" for c in cluster], "n long", *[f"{v} double" for v in names[len(cluster) + 1 :]]])
    made = blocks.mapInArrow(partial(_products, x, pairs, names, KEPT_GROUPS), schema)
    done = materialize(made.groupBy(*cluster).agg(*[F.sum(v).alias(v) for v in names[len(cluster) :]]), "fe-products")
    discard(blocks)
    return done, rounds
