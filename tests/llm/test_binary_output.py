"""Exact round trips, damage, indexes, and files that no attempt owns."""

import random
import struct

import pyarrow.fs as pafs
import pytest

from loamstack.llm import binary_output as B
from loamstack.llm import tokens

KIND = "`a.b` int, doc_id bigint, text string, Text int, file int"


def texts():
    rng = random.Random(1)
    words = ["word", " ", "  ", "\n", "é", "漢字", "1234", "don't", "", " "]
    odd = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "no id"), (-7, "low"), (5, "w " * 400_000)]
    return odd + [(100 + i, "".join(rng.choices(words, k=rng.randint(0, 80)))) for i in range(200)]


def test_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(0, i, t, 1, 2) for i, t in texts()], KIND).repartition(3)
    manifest = B.write_records(docs, f"file://{tmp_path}/records", file_bytes=20_000)
    back = sorted(((str(r["doc_id"]), r["tokens"]) for r in B.read_records(manifest).collect()), key=str)
    plain = tokens.encoding(tokens.VOCABULARY)
    assert back == sorted(((str(i), plain.encode_ordinary(t or "")) for i, t in texts()), key=str)
    rows = manifest.collect()
    assert len({r["file"] for r in rows}) > 1
    for name in {r["file"] for r in rows}:
        own = sorted((r["ordinal"], r["record_offset"], r["record_length"]) for r in rows if r["file"] == name)
        assert B.read_index(name) == [(at, length) for _, at, length in own]
        assert [k for k, *_ in own] == list(range(len(own)))
    for r in rows:
        assert r["n_tokens"] == (r["record_length"] - 26) // 2


def test_damage_is_found():
    record = B.frame(B.pack(5, struct.pack("<3H", 1, 2, 50_000), 2))
    assert B.unpack(B.unframe(record)) == (5, [1, 2, 50_000])
    assert B.unpack(B.unframe(B.frame(B.pack(None, b"", 2)))) == (None, [])
    for at in range(len(record)):
        for bit in (1, 128):
            broken = record[:at] + bytes([record[at] ^ bit]) + record[at + 1 :]
            with pytest.raises(ValueError):
                B.unframe(broken)
    for broken in (b"", record[:-1], record + b"x", record[:11]):
        with pytest.raises(ValueError):
            B.unframe(broken)


def test_damaged_file_is_not_read(spark, tmp_path):
    docs = spark.createDataFrame([(0, 1, "some text", 1, 2)], KIND)
    manifest = B.write_records(docs, f"file://{tmp_path}/records")
    (name,) = (tmp_path / "records").glob("*.rec")
    data = bytearray(name.read_bytes())
    data[20] ^= 1
    name.write_bytes(data)
    with pytest.raises(Exception, match="payload is damaged"):
        B.read_records(manifest).collect()


def test_empty_table_and_orphans(spark, tmp_path):
    empty = B.write_records(spark.createDataFrame([], KIND), f"file://{tmp_path}/none")
    assert empty.count() == 0 and B.read_records(empty).count() == 0
    path = f"file://{tmp_path}/records"
    manifest = B.write_records(spark.createDataFrame([(0, 1, "a b", 1, 2)], KIND), path)
    for name in ("lost.rec", "lost.idx", "_half.rec"):
        (tmp_path / "records" / name).write_bytes(b"x")
    assert B.sweep(manifest, path) == 3
    assert B.read_records(manifest).count() == 1
    assert isinstance(pafs.FileSystem.from_uri(path)[0], pafs.LocalFileSystem)
