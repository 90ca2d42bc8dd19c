"""Id lists inside zip archives, lookup batches and coverage."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.ordered import row_positions
from geopanel.skew import materialize

IDS_PER_CHUNK = 50_000
BATCH = 100
#: Members that get a task of their own; beyond them several share one.
MEMBER_TASKS = 20_000


def _open(path: str) -> zipfile.ZipFile:
    """An archive by random access: the directory at its end, then what is asked for."""
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
    return zipfile.ZipFile(files.open_input_file(inner))


def _directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The .txt members of every archive, from its central directory."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with _open(path) as archive:
                found = [(path, m.filename, m.file_size) for m in archive.infolist() if m.filename.endswith(".txt")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                ["archive", "file", "bytes"],
            )


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of every member, streamed in chunks."""
    for batch in batches:
        for path, member in zip(batch["archive"], batch["file"]):
            with _open(path) as archive, archive.open(member) as lines:
                chunk: list[str] = []
                first = 0
                for line in lines:
                    chunk.append(line.decode("utf-8", "replace").rstrip())
                    if len(chunk) == IDS_PER_CHUNK:
                        yield _rows(path, member, first, chunk)
                        first += len(chunk)
                        chunk = []
                if chunk:
                    yield _rows(path, member, first, chunk)


def _rows(path: str, member: str, first: int, chunk: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"archive": path, "file": member, "line": range(first, first + len(chunk)), "id": chunk})


def list_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, file, bytes) of all .txt members of all zip archives below ``path``, written.

    Spark lists the archives; of each, only the central directory is read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip")
    archives = listed.load(path).select("path")
    return materialize(archives.mapInArrow(_directory, "archive string, file string, bytes long"), "members")


def read_id_archives(spark: SparkSession, path: str) -> DataFrame:
    """All ids of all zip archives below ``path``: (archive, file, line from 0, id).

    One task reads one member, at its place in the archive and as a stream, so
    neither the size of an archive nor that of a member counts. Archives are
    opened with ``pyarrow.fs`` on the executors.
    """
    members = list_members(spark, path)
    tasks = max(1, min(members.count(), MEMBER_TASKS))
    dealt = members.repartition(tasks, "archive", "file")
    return dealt.mapInPandas(_lines, "archive string, file string, line long, id string")


def batch_ids(
    ids: DataFrame,
    file: str,
    id_column: str,
    size: int = BATCH,
    slice_width: int = 1 << 20,
    line: str | None = None,
) -> DataFrame:
    """Number the lookup batches of every file: ``size`` ids each, in file order or id order.

    With ``line``, the line numbers that :func:`read_id_archives` gives, a
    batch is plain arithmetic. Without it ids are numbered in their own order;
    ``slice_width`` then cuts a file's id range, so that one slice of ids fits
    a task.
    """
    if line:
        return ids.withColumn("batch", F.floor(F.col(line) / F.lit(size)))
    placed = row_positions(ids, [file], id_column, slice_width, "_position")
    batch = F.floor((F.col("_position") - 1) / F.lit(size)).alias("batch")
    return placed.select(*ids.columns, batch)


def coverage_report(ids: DataFrame, posts: DataFrame, file: str, id_column: str) -> DataFrame:
    """Per file: ids found among ``posts``, total ids and their ratio."""
    known = posts.select(F.col(id_column).alias("_found")).distinct()
    joined = ids.join(known, F.col(id_column) == F.col("_found"), "left")
    counts = joined.groupBy(file).agg(
        F.count("_found").alias("found"), F.count(F.lit(1)).alias("total")
    )
    return counts.withColumn("ratio", F.col("found") / F.col("total"))
