"""Token ids as length-delimited binary records with masked checksums.

A file is a sequence of frames: payload length (u64), masked checksum of those
eight bytes (u32), payload, masked checksum of the payload (u32), all
little-endian. The checksum is CRC-32, rotated right by 15 bits plus a
constant, so that checksums of data that holds checksums stay useful. The first
payload is a JSON header that names the id type; every other one is a flag byte
(1: the document has an id), the document id (i64) and its token ids. Beside
each file an ``.index`` file holds the offset of every document's frame (u64),
for reads in any order.

Documents are sorted by id with a range shuffle of the texts, encoded in sorted
order and written by the tasks themselves to the folder given, through
``pyarrow.fs``, so that folder must be one all machines share. A file's name
holds the attempt that wrote it, and the manifest that the tasks return names
the files that count: a lost executor or a repeated task leaves files behind
that nobody reads.

Cases: null texts are empty (the end id alone); null ids sort first; rows with
the same id keep the order of their texts; an empty table gives no file.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocks, raw, text_array
from .pieces import Units

#: Payload bytes after which a task starts another file.
FILE_BYTES = 64_000_000
MASK = 0xA282EAD8
MANIFEST = "part long, file long, path string, docs long, ids long, bytes long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join([size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))])


def payloads(stream) -> Iterator[bytes]:
    """The payloads of a file, every checksum verified."""
    while head := stream.read(12):
        if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("damaged record length")
        size = struct.unpack("<Q", head[:8])[0]
        body = stream.read(size + 4)
        if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
            raise ValueError("damaged record")
        yield body[:size]


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """One record file and its index."""

    def __init__(self, uri: str, dtype: str):
        self.uri, self.dtype = uri, dtype
        self.fs, self.path = _fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path)
        self.at, self.offsets, self.ids = 0, [], 0
        self._put(json.dumps({"ids": dtype}).encode())

    def _put(self, payload: bytes) -> None:
        data = frame(payload)
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self._put(struct.pack("<Bq", doc_id is not None, doc_id or 0) + ids.astype(self.dtype).tobytes())
        self.ids += len(ids)

    def close(self) -> tuple[str, int, int, int]:
        self.out.close()
        with self.fs.open_output_stream(self.path + ".index") as out:
            out.write(np.array(self.offsets, "<u8").tobytes())
        return self.uri, len(self.offsets), self.ids, self.at


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, token ids) in file order."""
    fs, path = _fs(uri)
    with fs.open_input_stream(path, buffer_size=1 << 20) as stream:
        records = payloads(stream)
        dtype = json.loads(next(records))["ids"]
        for body in records:
            known, doc_id = struct.unpack_from("<Bq", body)
            yield doc_id if known else None, np.frombuffer(body, dtype, offset=9)


def read_at(uri: str, row: int) -> tuple[int | None, np.ndarray]:
    """The ``row``-th document of a file, through its index."""
    fs, path = _fs(uri)
    with fs.open_input_file(path + ".index") as index:
        index.seek(8 * row)
        at = struct.unpack("<Q", index.read(8))[0]
    with fs.open_input_file(path) as stream:
        dtype = json.loads(next(payloads(stream)))["ids"]
        stream.seek(at)
        body = next(payloads(stream))
    known, doc_id = struct.unpack_from("<Bq", body)
    return (doc_id if known else None), np.frombuffer(body, dtype, offset=9)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int, pattern: str | None = None) -> list:
    """Encode and write all ``docs`` (doc_id, text); the manifest, in document order.

    ``pattern`` is that of the tokenizer's byte-level pre-tokenizer, if it has one.

    The manifest has one row for each file, so it is bounded by the size of the
    output over ``FILE_BYTES`` plus the number of partitions.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(
        "doc_id", F.xxhash64("text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        units = Units(tokenizer, pattern)
        dtype = "<u2" if units.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        writer, done = None, []

        def close():
            uri, n, ids, size = writer.close()
            done.append((part, len(done), uri, n, ids, size))

        for block in blocks(batches):
            data, at = raw(text_array(block))
            for doc_id, ids in zip(block.column(0).to_pylist(), units.encode_block(data, at)):
                if writer is None:
                    writer = Writer(f"{folder}/part-{part:06d}-{len(done):04d}-{attempt}.rec", dtype)
                writer.add(doc_id, np.append(ids, np.uint32(end_id)))
                if writer.at >= FILE_BYTES:
                    close()
                    writer = None
        if writer is not None:
            close()
        names = ["part", "file", "path", "docs", "ids", "bytes"]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(names, row)) for row in done],
            pa.schema([(n, pa.string() if n == "path" else pa.int64()) for n in names]),
        )

    # sorted here: a sort in Spark would sample its input, and so run the tasks twice
    return sorted(ordered.mapInArrow(encode, MANIFEST).collect(), key=lambda r: (r["part"], r["file"]))


def read(spark: SparkSession, manifest: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, one task for each file."""
    start, files = 0, []
    for row in manifest:
        files.append((row["path"], start))
        start += row["ids"]
    listed = spark.createDataFrame(files or [("", 0)], "path string, start long").where("path <> ''")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out: list[tuple] = []
                for doc_id, ids in read_file(uri):
                    out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], pa.int64()) for i in range(4)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return listed.repartition(max(1, len(files)), "path").mapInArrow(decode, schema)
