"""Operator 10: token ids as length-delimited binary records.

A record is the payload's length (8 bytes), the masked checksum of these, the payload, and its masked checksum. A
payload is the document's id (8 bytes), a flag byte (1: the id is null), the bytes per token (1) and the token ids.
Integers are little-endian. Checksums are CRC-32 as in zlib, masked as record files do (rotated by 15, plus a
constant), so that checksums of data that hold checksums stay good. Beside each record file lies its offset index:
16 bytes a record (offset, whole length), for reads in any order.

Null and empty texts give records without tokens, so that every row of the table has one record. Repeated rows give
repeated records. Columns besides doc_id and text are ignored, whatever their names. An empty table gives no files and an
empty manifest. Each task writes files under names of its own and moves them into place when they are whole; only files of the attempt
that Spark accepts are in the manifest, and thus a lost executor costs no more than its tasks; ``sweep`` deletes the
files that such attempts left.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, pieces, plain, release, to_arrow
from .tokens import VOCABULARY, RunEncoder

MANIFEST = "doc_id bigint, file string, ordinal bigint, record_offset bigint, record_length bigint, n_tokens bigint, checksum bigint"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one whole record; ValueError if it is damaged."""
    if len(data) < 16:
        raise ValueError("record is cut short")
    head = data[:8]
    (length,), (check,) = struct.unpack("<Q", head), struct.unpack("<I", data[8:12])
    if check != masked(head) or len(data) != length + 16:
        raise ValueError("record length is damaged")
    payload = data[12:-4]
    if struct.unpack("<I", data[-4:])[0] != masked(payload):
        raise ValueError("record payload is damaged")
    return payload


def pack(doc_id: int | None, tokens: bytes, width: int) -> bytes:
    return struct.pack("<qBB", doc_id or 0, doc_id is None, width) + tokens


def unpack(payload: bytes) -> tuple[int | None, list[int]]:
    import numpy as np

    doc_id, null, width = struct.unpack("<qBB", payload[:10])
    return None if null else doc_id, np.frombuffer(payload[10:], dtype=f"<u{width}").tolist()


def write_records(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, file_bytes: int = 256 << 20) -> DataFrame:
    """Writes record and index files under ``path`` (a new one in the shared folder by default) and returns the manifest, itself a table there."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "records")
    kind = to_arrow(T.StructType.fromDDL(MANIFEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RunEncoder(vocabulary)
        width = encoder.dtype.itemsize
        system, folder = pafs.FileSystem.from_uri(path)
        out, rows, offsets, at, name = None, [], [], 0, ""

        def close() -> pa.RecordBatch:
            out.close()
            with system.open_output_stream(f"{folder}/_{name}.idx") as index:
                index.write(b"".join(offsets))
            system.move(f"{folder}/_{name}.idx", f"{folder}/{name}.idx")
            system.move(f"{folder}/_{name}.rec", f"{folder}/{name}.rec")
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for f, c in zip(kind, columns, strict=True)], schema=kind)

        for batch in batches:
            for part in pieces(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if out is None:
                        name, at = uuid.uuid4().hex, 0
                        system.create_dir(folder, recursive=True)
                        out = system.open_output_stream(f"{folder}/_{name}.rec", buffer_size=1 << 20)
                    tokens = encoder.encode(text or "")
                    payload = pack(doc_id, tokens, width)
                    record = frame(payload)
                    out.write(record)
                    offsets.append(struct.pack("<QQ", at, len(record)))
                    rows.append((doc_id, f"{name}.rec", len(rows), at, len(record), len(tokens) // width, masked(payload)))
                    at += len(record)
                    if at >= file_bytes or len(rows) >= 100_000:
                        yield close()
                        out, rows, offsets = None, [], []
        if out is not None:
            yield close()
        del encoder
        release()

    manifest = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, T.StructType.fromDDL(MANIFEST))
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").withColumn("file", F.concat(F.lit(path + "/"), "file"))


def read_records(manifest: DataFrame) -> DataFrame:
    """Reads the records that a manifest lists, in any order, through their offsets; checks lengths and checksums."""
    fields = T.StructType.fromDDL("doc_id bigint, tokens array<int>")
    kind = to_arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, files = [], {}
            for name, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name not in files:
                    system, inner = pafs.FileSystem.from_uri(name)
                    files[name] = system.open_input_file(inner)
                rows.append(unpack(unframe(files[name].read_at(length, at))))
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind[0].type), pa.array([r[1] for r in rows], kind[1].type)], schema=kind)

    return manifest.select("file", "record_offset", "record_length").mapInArrow(run, fields)


def read_index(path: str) -> list[tuple[int, int]]:
    """(offset, length) of each record of a file, from the index beside it; path ends in .rec."""
    system, inner = pafs.FileSystem.from_uri(path.removesuffix(".rec") + ".idx")
    with system.open_input_stream(inner) as data:
        raw = data.read()
    return list(struct.iter_unpack("<QQ", raw))



def sweep(manifest: DataFrame, path: str) -> int:
    """Deletes the files under ``path`` that the manifest doesn't list, and returns how many; to be called when no write runs."""
    system, folder = pafs.FileSystem.from_uri(path)
    listed = {r[0].rpartition("/")[2].removesuffix(".rec") for r in manifest.select("file").distinct().toLocalIterator()}
    gone = [f.path for f in system.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.extension in ("rec", "idx") and f.base_name.rpartition(".")[0] not in listed]
    for name in gone:
        system.delete_file(name)
    return len(gone)
