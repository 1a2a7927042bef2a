import gzip
import hashlib
import io
import os
import random

import pytest
from conftest import table
from pyspark.sql import functions as F

from postlane.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def pages(spark, payloads):
    return table(spark, [(k, f"http://x/{k}", p) for k, p in enumerate(payloads)], SCHEMA)


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_chunks_and_running_digests(spark, size):
    payloads = ["", "é", "abcdefg", "x" * 14, "a" * 100, None]
    rows = warc.chunk_table(pages(spark, payloads), size).orderBy("record_id", "chunk_no").collect()
    for k, p in enumerate(payloads):
        mine = [r for r in rows if r["record_id"] == k]
        if p is None:
            assert not mine
            continue
        raw = p.encode()
        assert b"".join(bytes(r["payload"]) for r in mine) == raw
        assert len(mine) == max(1, -(-len(raw) // size))
        for j, r in enumerate(mine):
            assert (r["chunk_no"], r["begin"], r["n_bytes"]) == (j, j * size, len(r["payload"]))
            assert r["sha1"] == hashlib.sha1(raw[: r["begin"] + r["n_bytes"]]).hexdigest()
            assert r["last"] == (j == len(mine) - 1)


def test_verification(spark):
    chunks = warc.chunk_table(pages(spark, ["abcdefghij", "0123456789", "klmnopqrst", "uv", ""]), 4)
    assert all(r["whole"] for r in warc.verify(chunks).collect())
    spoiled = chunks.where("NOT (record_id = 0 AND chunk_no = 1) AND NOT (record_id = 1 AND last)")
    spoiled = spoiled.withColumn("payload", F.when(F.col("record_id") == 2, F.lit(b"none").cast("binary")).otherwise(F.col("payload")))
    spoiled = spoiled.union(chunks.where("record_id = 3"))
    assert {r["record_id"]: r["whole"] for r in warc.verify(spoiled).collect()} == {0: False, 1: False, 2: False, 3: False, 4: True}
    assert {r["record_id"]: (r["n_chunks"], r["n_bytes"]) for r in warc.verify(chunks).collect()} == {0: (3, 10), 1: (3, 10), 2: (3, 10), 3: (1, 2), 4: (1, 0)}


@pytest.mark.parametrize("packed", [False, True])
def test_round_trip_through_a_file(spark, tmp_path, packed):
    r = random.Random(0)
    payloads = [b"", b"\r\n\r\nWARC/1.1\r\n", bytes(r.randrange(256) for _ in range(200_000)), b"tail"]
    path = tmp_path / ("x.warc.gz" if packed else "x.warc")
    whole = [warc.warc_bytes(k, f"http://x/{k}", p) for k, p in enumerate(payloads)]
    path.write_bytes(b"".join(map(gzip.compress, whole)) if packed else b"".join(whole))
    rows = warc.read_warc(spark, [str(path)], 5000).orderBy("record_id", "chunk_no").collect()
    for k, p in enumerate(payloads):
        mine = [x for x in rows if x["record_id"] == k]
        assert b"".join(bytes(x["payload"]) for x in mine) == p
        assert mine[-1]["last"] and mine[-1]["sha1"] == hashlib.sha1(p).hexdigest() and mine[0]["uri"] == f"http://x/{k}" and mine[0]["warc_type"] == "resource"
    assert all(x["whole"] for x in warc.verify(warc.read_warc(spark, [str(path)], 5000)).collect())
    assert warc.read_warc(spark, []).collect() == []


class _Counted(io.BytesIO):
    most = 0

    def read(self, n=-1):
        self.most = max(self.most, n)
        assert n >= 0
        return super().read(n)

    read1 = read


def test_no_more_than_a_chunk_is_held():
    stream = _Counted(warc.warc_bytes(1, None, b"z" * 3_000_000))
    parts = list(warc.records_of(stream, 1000))
    assert len(parts) == 3000 and stream.most <= 65536
    cut = list(warc.records_of(io.BytesIO(warc.warc_bytes(1, None, b"z" * 3000)[:1500]), 1000))
    assert not cut[-1][4] and cut[-1][6] == "cut short"


def test_what_is_malformed_is_a_row_and_the_rest_is_read():
    good = [warc.warc_bytes(k, None, bytes([65 + k]) * 10) for k in range(4)]
    no_length, odd_length = (b"WARC/1.1\r\nWARC-Type: resource\r\n" + x + b"\r\nlost\r\n" for x in (b"", b"Content-Length: ten\r\n"))
    raw = good[0] + b"HTTP/1.1 200\r\nx: y\r\n\r\n" + good[1] + no_length + good[2] + odd_length + b"q" * 200_000 + b"\n" + good[3]
    found = list(warc.records_of(io.BytesIO(raw), 100))
    assert [bytes(x[3]) for x in found if x[4]] == [bytes([65 + k]) * 10 for k in range(4)]
    assert [x[6] is None for x in found] == [True, False, True, False, True, False, True]
    assert list(warc.records_of(io.BytesIO(b""))) == [] == list(warc.records_of(io.BytesIO(b"\r\n\n")))
    spoiled = gzip.compress(good[0]) + gzip.compress(warc.warc_bytes(9, None, random.Random(1).randbytes(5000)))[:3000]
    found = list(warc.records_of(gzip.GzipFile(fileobj=io.BytesIO(spoiled)), 100_000))
    assert found[0][4] and not found[-1][4] and found[-1][6].startswith("can't be read")


def test_records_of_two_files_are_told_apart(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.warc").write_bytes(b"".join(warc.warc_bytes(k, f"http://{name}/{k}", name.encode() * 30) for k in range(3)) + (b"junk\n" if name == "b" else b""))
    rows = warc.read_warc(spark, [str(tmp_path / f"{x}.warc") for x in "ab"], 20)
    assert {(r["path"][-6], r["record"]) for r in rows.collect()} == {*((x, f"<urn:record:{k}>") for x in "ab" for k in range(3)), ("b", None)}
    got = {(r["path"][-6], r["record_id"]): (r["n_chunks"], r["n_bytes"], r["whole"]) for r in warc.verify(rows).collect()}
    assert got == {**{(x, k): (2, 30, True) for x in "ab" for k in range(3)}, ("b", 3): (1, 0, False)}


def test_pages_to_files_and_back(spark, tmp_path):
    rows = [(1, "u", "aa"), (1, "u", "aa"), (None, None, "b"), (2, None, None), (3, "v\nw", "é" * 300_000), (4, "u", "")]
    odd = table(spark, [(*r, "z") for r in rows], SCHEMA + ", record string").repartition(3)
    paths = warc.write_warc(odd, f"file://{tmp_path}/out")
    got = warc.read_warc(spark, paths, 100_000)
    whole = {}
    for r in got.orderBy("path", "record_id", "chunk_no").collect():
        key = r["path"], r["record_id"]
        whole[key] = (r["record"], r["uri"], whole.get(key, ("", "", b""))[2] + bytes(r["payload"]))
    want = [(f"<urn:record:{'' if k is None else k}>", u and u.replace("\n", "%0A"), p.encode()) for k, u, p in rows if p is not None]
    assert sorted(whole.values(), key=repr) == sorted(want, key=repr)
    assert sorted(os.listdir(tmp_path / "out")) == [p.rpartition("/")[2] for p in paths]
    assert warc.write_warc(pages(spark, []), f"file://{tmp_path}/none") == []


def test_odd_tables(spark):
    rows = [(1, "u", "aa"), (1, "u", "aa"), (None, None, "b"), (2, None, None), (3, "u", "x" * 300_000)]
    odd = table(spark, [(*r, "z", 5) for r in rows], SCHEMA + ", payload string, chunk_no int")
    got = warc.chunk_table(odd).collect()
    assert sorted(str(r["record_id"]) for r in got) == ["1", "1", *["3"] * 37, "None"]
    assert {r["record_id"]: r["whole"] for r in warc.verify(warc.chunk_table(odd)).collect()} == {1: False, 3: True}
    assert warc.chunk_table(pages(spark, [])).collect() == []
    assert warc.verify(warc.chunk_table(pages(spark, []))).collect() == []
    with pytest.raises(ValueError):
        warc.chunk_table(odd, 0)
