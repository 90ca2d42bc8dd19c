"""Building blocks that keep a plan balanced when one key holds most rows.

A task is meant for a budget of rows. A key with more of them is crowded: it is
dealt into as many salts as its rows fill budgets, so the rows of one salt do
not grow with the data. What is crowded is counted first and written, with the
salts of each key beside it.
"""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAVY_MIN_ROWS = 1_000_000
HEAVY_MAX_KEYS = 10_000
BROADCAST_BYTES = 64 << 20

# folders of local sessions that name none, by application
_local_dirs: dict[str, str] = {}


def heavy_keys(
    df: DataFrame,
    keys: list[str],
    min_rows: int = HEAVY_MIN_ROWS,
    max_keys: int = HEAVY_MAX_KEYS,
) -> DataFrame:
    """Keys that hold more than ``max(min_rows, total / max_keys)`` rows.

    Fewer than ``max_keys`` keys can each hold more than ``1 / max_keys`` of the
    rows, so the result has a size bound that does not grow with the data and
    is safe to broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows").cast("double").alias("_total")).scalar()
    limit = F.greatest(F.lit(float(min_rows)), total / F.lit(float(max_keys)))
    return counts.where(F.col("_rows") > limit).select(*keys)


def crowded_keys(df: DataFrame, keys: list[str], budget: int = HEAVY_MIN_ROWS, salts: int | None = None) -> DataFrame:
    """(keys, _salts) of the keys with more than ``budget`` rows, written.

    ``_salts`` is the number of budgets that the key's rows fill, or ``salts``.
    The list has fewer rows than the table over ``budget``.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    filled = F.lit(salts) if salts else F.ceil(F.col("_rows") / F.lit(budget))
    return materialize(counts.where(F.col("_rows") > budget).select(*keys, filled.cast("int").alias("_salts")), "crowded")


def match_listed(df: DataFrame, listed: DataFrame, keys: list[str], how: str, max_keys: int = HEAVY_MAX_KEYS) -> DataFrame:
    """Join with a written list of keys, NULL matching NULL; broadcast up to ``max_keys`` of them, counted here."""
    right = listed.withColumnsRenamed({k: f"_h_{k}" for k in keys})
    if listed.count() <= max_keys:
        right = F.broadcast(right)
    match = _all([F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    joined = df.join(right, match, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_h_{k}" for k in keys])


def row_salt(columns: list[str], salts: int | Column) -> Column:
    """A salt computed from the row itself, so a retried task repeats it."""
    salts = F.lit(salts) if isinstance(salts, int) else salts
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), salts).cast("int")


def salted(df: DataFrame, crowded: DataFrame, keys: list[str], spread: list[str], name: str, max_keys: int = HEAVY_MAX_KEYS) -> DataFrame:
    """``df`` with a salt for the rows of crowded keys, taken from the columns ``spread``; 0 for the others."""
    marked = match_listed(df, crowded, keys, "left", max_keys)
    salt = F.when(F.col("_salts").isNotNull(), row_salt(spread, F.col("_salts"))).otherwise(F.lit(0))
    return marked.withColumn(name, salt).drop("_salts")


def repeated(df: DataFrame, crowded: DataFrame, keys: list[str], name: str, max_keys: int = HEAVY_MAX_KEYS) -> DataFrame:
    """``df`` with the rows of a crowded key once for each of its salts."""
    marked = match_listed(df, crowded, keys, "left", max_keys)
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    return marked.withColumn(name, F.explode(copies)).drop("_salts")


def salted_join(
    fact: DataFrame,
    dim: DataFrame,
    keys: list[str],
    how: str = "inner",
    null_safe: bool = False,
    spread: list[str] | None = None,
    min_rows: int = HEAVY_MIN_ROWS,
    max_keys: int = HEAVY_MAX_KEYS,
    salts: int | None = None,
    condition: Column | None = None,
) -> DataFrame:
    """Equi-join where only the crowded keys of ``fact`` are salted.

    A key of more than ``min_rows`` rows spreads over one partition for each
    ``min_rows`` of them (or over ``salts``) and only the matching rows of
    ``dim`` are repeated that many times; all other keys join as usual, and
    without crowded keys it is a plain join. ``how`` is inner, left, left_semi
    or left_anti. ``null_safe`` lets NULL match NULL. ``spread`` names the
    columns the salt is taken from; it should tell rows of one key apart
    (default: every column of ``fact``). ``condition`` is a further condition on
    columns of both sides. ``max_keys`` is how long a list of crowded keys may
    be to be broadcast.
    """
    crowded = crowded_keys(fact, keys, min_rows, salts)
    if crowded.isEmpty():
        left, right = fact, dim
    else:
        left = salted(fact, crowded, keys, spread or fact.columns, "_salt", max_keys)
        right = repeated(dim, crowded, keys, "_dsalt", max_keys)
    right = right.withColumnsRenamed({k: f"_d_{k}" for k in keys})
    same = [
        F.col(k).eqNullSafe(F.col(f"_d_{k}")) if null_safe else F.col(k) == F.col(f"_d_{k}")
        for k in keys
    ]
    if left is not fact:
        same.append(F.col("_salt") == F.col("_dsalt"))
    joined = left.join(right, _all(same if condition is None else [*same, condition]), how)
    return joined.drop("_salt", "_dsalt", *[f"_d_{k}" for k in keys])


def measured_bytes(df: DataFrame) -> int:
    """Size of a table as text, measured by one aggregation job."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct("*")))).alias("b")).first()["b"]
    return int(size or 0)


def join_bounded(
    fact: DataFrame,
    dim: DataFrame,
    keys: list[str],
    how: str = "inner",
    null_safe: bool = False,
    max_bytes: int = BROADCAST_BYTES,
    condition: Column | None = None,
    **salting,
) -> DataFrame:
    """Join a reference table: broadcast when its measured size allows it.

    ``dim`` is measured first (one small job); beyond ``max_bytes`` the join
    falls back to :func:`salted_join`. ``condition`` is a further condition on
    columns of both sides.
    """
    if measured_bytes(dim) > max_bytes:
        return salted_join(fact, dim, keys, how, null_safe, condition=condition, **salting)
    right = dim.withColumnsRenamed({k: f"_d_{k}" for k in keys})
    same = [
        F.col(k).eqNullSafe(F.col(f"_d_{k}")) if null_safe else F.col(k) == F.col(f"_d_{k}")
        for k in keys
    ]
    if condition is not None:
        same.append(condition)
    return fact.join(F.broadcast(right), _all(same), how).drop(*[f"_d_{k}" for k in keys])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it uses a folder of its
    own in the warehouse, which goes when the driver ends.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_dirs:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
        _local_dirs[context.applicationId] = f"{warehouse}/geopanel-{context.applicationId}"
        atexit.register(shutil.rmtree, _local_dirs[context.applicationId], ignore_errors=True)
    return _local_dirs[context.applicationId]


def materialize(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage of iterative work and computes ``df`` exactly once; the
    written copy survives the loss of executors. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing reads it any more."""
    spark = written.sparkSession
    files = written.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What results collected in here have shuffled goes from disk with them, not when the driver's memory is next cleaned."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out
