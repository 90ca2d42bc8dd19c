"""Order-dependent operators that never hold one key in one task.

Window functions put a whole partition key into one task. The helpers below cut
a key's ordered rows into slices, work inside the slices and carry over only one
summary row per (key, slice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geopanel.functions.missing import present
from geopanel.skew import HEAVY_MAX_KEYS, HEAVY_MIN_ROWS, crowded_keys, match_listed, materialize

QUANTILE_SLICES = 4096
QUANTILE_LEVELS = 3
#: Rows a range partition is meant for.
RANGE_ROWS = 1_000_000


def range_slices(df: DataFrame, keys: list[str], order: list[str], name: str = "_slice") -> DataFrame:
    """``df`` written with the number of its range partition of (keys, order).

    Spark samples the rows for the bounds, so the partitions hold about the
    same number of rows however they are dealt over keys and times; rows that
    agree in ``keys`` and ``order`` share a partition. A key's slices are its
    pieces in consecutive partitions, so their numbers do not fall along its
    order.
    """
    df = materialize(df, "unsliced")
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(width, -(-df.count() // RANGE_ROWS))
    placed = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in [*keys, *order]])
    return materialize(placed.withColumn(name, F.spark_partition_id()), "sliced")


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_on: Column | None,
    totals: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums per ``keys`` in ``order``: the exact prefix scan.

    ``slice_on`` must not decrease along ``order``; without it, the slices are
    range partitions of (keys, order), which have about the same number of rows
    wherever the rows crowd. The running sum inside a (key, slice) is added to
    the sum of all earlier slices of that key; the only window over a whole key
    sees one row per slice.
    """
    sliced = range_slices(df, keys, order) if slice_on is None else df.withColumn("_slice", slice_on)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = sliced.withColumns({name: F.sum(expr).over(inside) for name, expr in totals.items()})

    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(*keys, "_slice").agg(
        *[F.sum(expr).alias(f"_t_{name}") for name, expr in totals.items()]
    )
    offsets = offsets.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.col("_slice").alias("_o_slice"),
        *[F.sum(f"_t_{name}").over(earlier).alias(f"_o_{name}") for name in totals],
    )
    match = F.col("_slice") == F.col("_o_slice")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    joined = scanned.join(offsets, match, "left")
    joined = joined.withColumns(
        {name: F.col(name) + F.coalesce(F.col(f"_o_{name}"), F.lit(0)) for name in totals}
    )
    return joined.drop("_slice", "_o_slice", *[f"_o_{c}" for c in [*keys, *totals]])


def row_positions(
    df: DataFrame, keys: list[str], order: str, slice_width: int, name: str = "position"
) -> DataFrame:
    """1-based row number per key along an integer column, without one task per key."""
    return running_totals(
        df,
        keys,
        [order],
        F.floor(F.col(order) / F.lit(slice_width)),
        {name: F.lit(1).cast("long")},
    )


def next_in_key(
    df: DataFrame, keys: list[str], order: str, slice_on: Column, payload: list[str], name: str
) -> DataFrame:
    """Add ``name``: a struct of ``order`` and ``payload`` of the following row of the key.

    Like ``lead`` over the whole key, except that a key is cut into slices; the
    last row of a slice takes the first row of the key's next non-empty slice.
    """
    item = F.struct(order, *payload)
    sliced = df.withColumn("_slice", slice_on)
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    scanned = sliced.withColumn(name, F.lead(item).over(inside))

    heads = sliced.groupBy(*keys, "_slice").agg(F.min(item).alias("_head"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    heads = heads.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.col("_slice").alias("_o_slice"),
        F.lead("_head").over(across).alias("_next_head"),
    )
    match = F.col("_slice") == F.col("_o_slice")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    joined = scanned.join(heads, match, "left")
    joined = joined.withColumn(name, F.coalesce(F.col(name), F.col("_next_head")))
    return joined.drop("_slice", "_o_slice", "_next_head", *[f"_o_{k}" for k in keys])


def select_ranks(values: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """Exact order statistics by repeated narrowing.

    ``values`` holds (keys, value, copies) with each value once per key.
    ``targets`` holds (keys, probe, rank) with a 0-based rank and must be small
    by construction (a few probes for each of a bounded number of keys).
    Returns (keys, probe, value, below): the value at that rank and the number
    of smaller rows. Each level splits the interval still in question into equal
    parts, counts them with map-side combine and keeps the part that holds the
    rank. The first split is by order of magnitude, so far outliers and infinite
    values do not spoil it; after three levels an interval is about 1e-11 of
    the value wide, and that is all a task ever sorts.
    """
    ids = [*keys, "probe"]
    span = values.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    state = targets.join(F.broadcast(span), keys)
    state = state.withColumn("below", F.lit(0).cast("long"))
    for _ in range(QUANTILE_LEVELS):
        state = _narrow(values, keys, ids, state)
    ordered = Window.partitionBy(*ids).orderBy("value")
    ordered = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = _in_question(values, keys, state)
    rest = rest.withColumn("_cum", F.col("below") + F.sum("copies").over(ordered))
    found = rest.where((F.col("_cum") > F.col("rank")) & (F.col("_cum") - F.col("copies") <= F.col("rank")))
    return found.select(*ids, "value", (F.col("_cum") - F.col("copies")).alias("below"))


def _in_question(values: DataFrame, keys: list[str], state: DataFrame) -> DataFrame:
    inside = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
    return values.join(F.broadcast(state), keys).where(inside)


def _magnitude(value: Column) -> Column:
    """A finite number that never falls as ``value`` rises: its signed order of magnitude."""
    size = F.abs(value.cast("double"))
    top = F.when(size == float("inf"), F.lit(2000.0)).otherwise(F.ln(size) + 750.0)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.signum(value.cast("double")) * top)


def _narrow(values: DataFrame, keys: list[str], ids: list[str], state: DataFrame) -> DataFrame:
    wide = _magnitude(F.col("hi")) - _magnitude(F.col("lo")) > 1

    def scaled(name: str) -> Column:
        return F.when(wide, _magnitude(F.col(name))).otherwise(F.col(name).cast("double"))

    reach = F.nullif(scaled("hi") - scaled("lo"), F.lit(0.0))
    part = F.floor((scaled("value") - scaled("lo")) / reach * F.lit(float(QUANTILE_SLICES)))
    part = F.coalesce(F.least(part, F.lit(QUANTILE_SLICES - 1)), F.lit(0)).cast("int")
    parts = (
        _in_question(values, keys, state)
        .withColumn("_part", part)
        .groupBy(*ids, "rank", "below", "_part")
        .agg(
            F.sum("copies").alias("_copies"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
        )
    )
    upto = Window.partitionBy(*ids).orderBy("_part")
    upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("_cum", F.col("below") + F.sum("_copies").over(upto))
    first = F.col("_cum") - F.col("_copies")
    kept = parts.where((F.col("_cum") > F.col("rank")) & (first <= F.col("rank")))
    return kept.select(*ids, "rank", first.alias("below"), "lo", "hi")


def spread_quantiles(
    df: DataFrame, keys: list[str], columns: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    """Exact quantiles (linear between order statistics) without a per-key buffer.

    Returns (keys, variable, quantiles array). Meant for few keys with many
    rows, including no key at all. The keys travel as one struct, whose equality
    lets NULL match NULL.
    """
    ids = ["_key", "variable"]
    key = F.struct(*(keys or [F.lit(0).alias("_all")])).alias("_key")
    pairs = F.array(
        *[F.struct(F.lit(c).alias("variable"), present(c).cast("double").alias("value")) for c in columns]
    )
    long = df.select(key, F.inline(pairs)).where(F.col("value").isNotNull())
    values = long.groupBy(*ids, "value").agg(F.count(F.lit(1)).alias("copies"))
    sizes = long.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    spots = sizes.select(*ids, "_n", F.inline(wanted))
    spots = spots.withColumn("_pos", (F.col("_n") - 1) * F.col("p"))
    spots = spots.withColumn("_lo", F.floor("_pos")).withColumn("_frac", F.col("_pos") - F.floor("_pos"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("_lo").alias("rank")),
        F.struct(F.lit(1).alias("side"), F.least(F.col("_lo") + 1, F.col("_n") - 1).alias("rank")),
    )
    spots = spots.select(*ids, "q", "_frac", F.inline(sides))
    targets = spots.select(*ids, F.struct("q", "side", "_frac").alias("probe"), "rank")
    found = select_ranks(values, ids, targets)
    weight = F.when(F.col("probe.side") == 0, 1 - F.col("probe._frac")).otherwise(F.col("probe._frac"))
    points = found.groupBy(*ids, F.col("probe.q").alias("q")).agg(F.sum(F.col("value") * weight).alias("v"))
    per_key = points.groupBy(*ids).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("q", "v"))), lambda s: s["v"]).alias("quantiles")
    )
    return per_key.select(*[F.col(f"_key.{k}").alias(k) for k in keys], "variable", "quantiles")


def aggregate_with_quantiles(
    df: DataFrame,
    keys: list[str],
    plain: dict[str, Column],
    quantiles: dict[str, tuple[str, float]],
    min_rows: int = HEAVY_MIN_ROWS,
    max_keys: int = HEAVY_MAX_KEYS,
) -> DataFrame:
    """``groupBy(keys)`` with combinable aggregates and exact quantiles.

    Spark's exact ``percentile`` keeps every distinct value of a group in one
    buffer, which is right for the many ordinary groups. Groups of more than
    ``min_rows`` rows go through :func:`spread_quantiles` instead, so no buffer
    outgrows that limit, whatever the size of the table. With no keys the whole
    table is one group and only the second way is used.
    """
    columns = sorted({column for column, _ in quantiles.values()})
    probs = sorted({p for _, p in quantiles.values()})
    at = {p: i for i, p in enumerate(probs)}

    def picked(source: dict[str, Column]) -> list[Column]:
        return [
            F.element_at(source[column], at[p] + 1).alias(name)
            for name, (column, p) in quantiles.items()
        ]

    def wide(rows: DataFrame) -> DataFrame:
        found = spread_quantiles(rows, keys, columns, probs)
        arrays = [
            F.max(F.when(F.col("variable") == c, F.col("quantiles"))).alias(f"_q_{c}") for c in columns
        ]
        return found.groupBy(*keys).agg(*arrays)

    out = [*keys, *plain, *quantiles]
    if not keys:
        arrays = wide(df).select(F.struct(*[f"_q_{c}" for c in columns])).scalar()
        rest = df.agg(F.count(F.lit(1)).alias("_n"), *[e.alias(n) for n, e in plain.items()])
        rest = rest.withColumn("_q", arrays)
        return rest.select(*plain, *picked({c: F.col(f"_q._q_{c}") for c in columns}))

    exact = F.array(*[F.lit(p) for p in probs])
    heavy_list = crowded_keys(df, keys, min_rows).drop("_salts")
    none = heavy_list.isEmpty()
    usual = (df if none else match_listed(df, heavy_list, keys, "left_anti", max_keys)).groupBy(*keys).agg(
        *[e.alias(n) for n, e in plain.items()],
        *[F.percentile(present(c).cast("double"), exact).alias(f"_q_{c}") for c in columns],
    )
    usual = usual.select(*keys, *plain, *picked({c: F.col(f"_q_{c}") for c in columns}))
    if none:
        return usual.select(*out)
    hot = match_listed(df, heavy_list, keys, "left_semi", max_keys)
    tops = wide(hot).withColumnsRenamed({k: f"_o_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    heavy = hot.groupBy(*keys).agg(*[e.alias(n) for n, e in plain.items()])
    heavy = heavy.join(tops, match, "left")
    heavy = heavy.select(*keys, *plain, *picked({c: F.col(f"_q_{c}") for c in columns}))
    return usual.select(*out).unionByName(heavy.select(*out))


def smallest(df: DataFrame, order: str, tie: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest ``order`` (integer), ties by ``tie``; NULL never counts.

    ``orderBy().limit(n)`` merges the best ``n`` of every partition in one task.
    This finds the cut by counting 16 bits at a time, at most 65,536 numbers
    for the driver in each of four jobs or fewer, and then filters: no row is
    shuffled but those that tie at the cut.
    """
    value = F.col(order).cast("long")
    rows = df.where(value.isNotNull())
    inside, left = F.lit(True), n
    for shift in (48, 32, 16, 0):
        part = F.shiftright(value, shift)
        counts = rows.where(inside).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).collect()
        cut = None
        for digit, size in sorted((r["part"], r["rows"]) for r in counts):
            if size >= left:
                cut = digit
                break
            left -= size
        if cut is None:
            return rows
        if size == left:
            return rows.where(part <= cut)
        inside = part == cut
    ties = rows.where(value == cut).orderBy(tie).limit(left)
    return rows.where(value < cut).unionByName(ties)
