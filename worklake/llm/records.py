"""Token ids as length-delimited binary records.

A record is `length (u64) | checksum of the length (u32) | body | checksum of the body (u32)`,
little-endian. Checksums are CRC-32, rotated and shifted by a constant ("masked"), so that a
checksum of data that holds checksums stays sound. The body is `doc_id (i64) | flags (u8: 1 null id,
2 ids of four bytes instead of two) | ids`. Records lie in ascending doc_id order (null first, then
by text for equal ids) within a file and from file to file. A separate index (Parquet) gives file,
offset and sizes of each record, for shuffled reads.

Null text is an empty one: its record holds the end id alone. Repeated rows have a record each. An
empty table gives no files and no rows.

Files are written by the tasks into the shared folder, under a name of their own for each attempt;
the index names those of the attempts that succeeded, so a lost executor leaves unnamed files only.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklake.llm import hashing, tokens
from worklake.llm.tables import checkpoint_dir, materialize

END_ID = 2
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
BODY = struct.Struct("<qB")
TAIL = struct.Struct("<I")
NULL_ID, WIDE = 1, 2

INDEX = "part long, file string, ordinal long, doc_id long, offset long, bytes long, n_tokens long"
ROWS = "part long, doc_id long, before long, n_tokens long, ids_crc32 long"


class Damaged(ValueError):
    """A checksum or length that doesn't fit."""


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    size = struct.pack("<Q", len(body))
    return b"".join((size, TAIL.pack(masked(size)), body, TAIL.pack(masked(body))))


def unframe(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and body of each record of an open file; Damaged where a checksum fails."""
    offset = 0
    while head := stream.read(HEAD.size):
        if len(head) < HEAD.size or masked(head[:8]) != HEAD.unpack(head)[1]:
            raise Damaged(f"length at {offset}")
        size = HEAD.unpack(head)[0]
        body, tail = stream.read(size), stream.read(TAIL.size)
        if len(body) < size or len(tail) < TAIL.size or TAIL.unpack(tail)[0] != masked(body):
            raise Damaged(f"body at {offset}")
        yield offset, body
        offset += HEAD.size + size + TAIL.size


def pack_body(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    flags = (NULL_ID if doc_id is None else 0) | (WIDE if wide else 0)
    return BODY.pack(doc_id or 0, flags) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack_body(body: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = BODY.unpack_from(body)
    ids = np.frombuffer(body, "<u4" if flags & WIDE else "<u2", offset=BODY.size).astype(np.uint32)
    return None if flags & NULL_ID else doc_id, ids


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, vocabulary: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Tokenizes and writes; returns the index, one row a record, as a written table.

    Documents are dealt by ranges of (doc_id, hash of the text), so files follow each other; only the
    range bounds are a sample.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    fields = pa.schema([("part", pa.int64()), ("file", pa.string()), *[(n, pa.int64()) for n in ("ordinal", "doc_id", "offset", "bytes", "n_tokens")]])

    def write_part(batches):
        from pyspark import TaskContext

        encode = tokens.encoder(vocabulary).rows
        part, stream, name, offset, ordinal = TaskContext.get().partitionId(), None, "", 0, 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            raw, at = hashing.utf8(batch.column("text"))
            rows = []
            if stream is None and len(ids_of):
                store, where = _store(folder)
                store.create_dir(where, recursive=True)
                name = f"{part:06d}-{uuid.uuid4().hex}.records"
                stream = store.open_output_stream(f"{where}/{name}")
            for doc_id, ids in zip(ids_of, encode(raw, at), strict=True):
                record = frame(pack_body(doc_id, np.concatenate((ids, end))))
                stream.write(record)
                rows.append((part, name, ordinal, doc_id, offset, len(record), len(ids) + 1))
                offset, ordinal = offset + len(record), ordinal + 1
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], schema=fields)
        if stream is not None:
            stream.close()

    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("__x", F.xxhash64("text"))
        .repartitionByRange("doc_id", "__x")
        .sortWithinPartitions("doc_id", "__x")
        .select("doc_id", "text")
    )
    index = materialize(dealt.mapInArrow(write_part, INDEX), "record-index")
    return index.withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))


def read(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Every record of the index's files, checked: part, doc_id, ids before it in its file, count, checksum."""
    fields = pa.schema([(n, pa.int64()) for n in ("part", "doc_id", "before", "n_tokens", "ids_crc32")])

    def read_files(batches):
        for batch in batches:
            for part, file in zip(batch.column("part").to_pylist(), batch.column("file").to_pylist(), strict=True):
                store, where = _store(file)
                before, rows = 0, []
                with store.open_input_file(where) as raw:
                    for _, body in unframe(io.BufferedReader(raw, 1 << 20)):
                        doc_id, ids = unpack_body(body)
                        rows.append((part, doc_id, before, len(ids), tokens.crc32(ids)))
                        before += len(ids)
                        if len(rows) == 4096:
                            yield _rows(rows, fields)
                            rows = []
                if rows:
                    yield _rows(rows, fields)

    files = index.select("part", "file").distinct()
    n = files.count()
    return files.repartition(max(1, n)).mapInArrow(read_files, ROWS)


def _rows(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


def read_at(picked: DataFrame) -> DataFrame:
    """Records of the picked index rows by their offsets (a shuffled read): doc_id and ids."""

    def fetch(batches):
        fields = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
        streams: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] not in streams:
                    streams = {}  # rows come file by file
                    store, where = _store(row["file"])
                    streams[row["file"]] = store.open_input_file(where)
                raw = streams[row["file"]]
                raw.seek(row["offset"])
                _, body = next(unframe(io.BytesIO(raw.read(row["bytes"]))))
                doc_id, ids = unpack_body(body)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], schema=fields)

    return picked.sortWithinPartitions("file", "offset").mapInArrow(fetch, "doc_id long, ids array<long>")


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document, from the files: ids of all documents before it, its own count and checksum."""
    spark = docs.sparkSession
    index = write(docs, vocabulary)
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (
        read(spark, index)
        .join(base, "part")
        .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )
