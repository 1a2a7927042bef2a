"""WARC payloads as a table of chunks, read, written and checked without holding a whole record."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from postlane.llm.common import file_system, shared_folder

#: Bytes of a chunk, and rows that a batch holds before it is passed on.
CHUNK_BYTES, BATCH_BYTES = 8192, 4 << 20
#: Bytes that are read at a time, and of a line without an end that are taken for one.
LINE_BYTES = 65536

SCHEMA = "record_id bigint, uri string, chunk_no int, begin bigint, n_bytes int, last boolean, payload binary, sha1 string"
_NAMES = ["record_id", "uri", "chunk_no", "begin", "n_bytes", "last", "payload", "sha1"]
_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]


class _Rows:
    """Rows of chunks, handed on as soon as they come to BATCH_BYTES."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, *row: object) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += row[4] + 100
        if self.size >= BATCH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*self.rows), _TYPES)], _NAMES)
        self.rows, self.size = [], 0


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, record_id: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """(record_id, uri, chunk_no, begin, n_bytes, last, payload, sha1): payloads cut into chunks of chunk_bytes, the last as long as what is left.

    sha1 is the digest of the payload up to the chunk's end, carried from chunk to chunk, so that the last one is the
    record's and a reader can check as it goes. Chunks are views of the column's buffer. A null payload has no chunks;
    an empty one has a single empty chunk, so that it isn't lost. Repeated rows each give their chunks; a null
    record_id or uri stays null. Other columns are left out.
    """
    if chunk_bytes < 1:
        raise ValueError("chunk_bytes must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for b in batches:
            ids, uris = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in range(b.num_rows):
                if not b.column(2)[k].is_valid:
                    continue
                view = memoryview(b.column(2)[k].as_buffer())
                digest = hashlib.sha1()
                for no, at in enumerate(range(0, max(1, len(view)), chunk_bytes)):
                    part = view[at : at + chunk_bytes]
                    digest.update(part)
                    yield from rows.add(ids[k], uris[k], no, at, len(part), at + len(part) == len(view), bytes(part), digest.copy().hexdigest())
        yield from rows.flush()

    one = pages.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(uri).cast("string").alias("uri"), F.col(payload).cast("binary").alias("payload"))
    return one.mapInArrow(run, SCHEMA)


def verify(chunks: DataFrame) -> DataFrame:
    """([path,] record_id, n_chunks, n_bytes, whole): whether each record's chunks are all there and their digests hold.

    Chunks that read_warc() made are told apart by path and record_id, others by record_id alone. Each record's chunks
    stream by in order; one digest and one chunk are held at a time. Chunks without a record_id aren't counted; rows
    that repeat a chunk of a record make it unsound, as does an error in reading it.
    """
    by = ["path", "record_id"] if "path" in chunks.columns else ["record_id"]
    kinds = [pa.string(), pa.int64()][-len(by) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list = []

        def close() -> None:
            if state:
                key, _, n, size, sound, last = state
                done.append((*key, n, size, sound and last))

        def flush() -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), [*kinds, pa.int64(), pa.int64(), pa.bool_()])], [*by, "n_chunks", "n_bytes", "whole"])
                done.clear()

        for b in batches:
            for *key, no, begin, last, payload, sha1 in zip(*b.columns):
                key = [k.as_py() for k in key]
                if not state or state[0] != key:
                    close()
                    state[:] = [key, hashlib.sha1(), 0, 0, True, False]
                part = memoryview(payload.as_buffer()) if payload.is_valid else b""
                state[4] &= no.as_py() == state[2] and begin.as_py() == state[3] and not state[5]
                state[1].update(part)
                state[4] &= state[1].hexdigest() == sha1.as_py()
                state[2] += 1
                state[3] += len(part)
                state[5] = bool(last.as_py())
            yield from flush()
        close()
        yield from flush()

    ordered = chunks.where("record_id IS NOT NULL").select(*by, "chunk_no", "begin", "last", "payload", "sha1")
    ordered = ordered.repartition(*by).sortWithinPartitions(*by, "chunk_no")
    return ordered.mapInArrow(run, ("path string, " if len(by) > 1 else "") + "record_id bigint, n_chunks bigint, n_bytes bigint, whole boolean")


def _open(path: str) -> BinaryIO:
    system, inner = file_system(path)
    raw = system.open_input_stream(inner, compression=None)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw


def _line(stream: BinaryIO, held: bytearray) -> bytes | None:
    """The next line with its end, or as much of it as LINE_BYTES; None at the end."""
    while (at := held.find(b"\n")) < 0 and len(held) < LINE_BYTES:
        more = stream.read1(LINE_BYTES)
        if not more:
            at = len(held) - 1
            break
        held += more
    line = bytes(held[: at + 1 if at >= 0 else LINE_BYTES])
    del held[: len(line)]
    return line or None


Chunk = tuple[dict[str, str], int, int, bytes, bool, str, str | None]


def records_of(stream: BinaryIO, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """(headers, chunk number, begin, payload, last, sha1 so far, error) of a WARC stream, never more than a chunk of a record at a time.

    Blank lines between records are passed over. What isn't a record, or has no Content-Length that is a number, comes
    as one empty chunk with an error that isn't the last, and reading goes on at the next line that begins a record. A
    record cut short, or whose compressed bytes can't be read on, ends with a chunk that isn't the last. read1() gives
    what has come so far, so that nothing before such a place is lost.
    """
    held = bytearray()
    empty = hashlib.sha1().hexdigest()
    headers: dict[str, str] = {}
    no, at, digest = 0, 0, hashlib.sha1()
    try:
        line = _line(stream, held)
        while line is not None:
            if not line.strip():
                line = _line(stream, held)
                continue
            headers, no, at, digest, error = {}, 0, 0, hashlib.sha1(), None
            if line.startswith(b"WARC/"):
                while (line := _line(stream, held)) is not None and line.strip():
                    name, _, value = line.decode("utf8", "replace").partition(":")
                    headers[name.strip().lower()] = value.strip()
                if not (headers.get("content-length") or "").isdecimal():
                    error = f"no length: {headers.get('content-length')!r}"
            else:
                error = f"no record: {line[:40]!r}"
            if error:
                yield headers, 0, 0, b"", False, empty, error
                while line is not None and not line.startswith(b"WARC/"):
                    line = _line(stream, held)
                continue
            left = int(headers["content-length"])
            while True:
                want = min(chunk_bytes, left - at)
                while len(held) < want and (more := stream.read1(max(LINE_BYTES, want - len(held)))):
                    held += more
                part = bytes(held[:want])
                del held[:want]
                digest.update(part)
                short = len(part) < want
                yield headers, no, at, part, not short and at + len(part) == left, digest.hexdigest(), "cut short" if short else None
                at += len(part)
                no += 1
                if at >= left or short:
                    break
            line = _line(stream, held)
    except (EOFError, gzip.BadGzipFile, zlib.error) as e:
        yield headers, no, at, b"", False, digest.hexdigest(), f"can't be read: {e}"


def read_warc(spark: SparkSession, paths: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of WARC files, .gz ones too, a task to a file.

    Columns: path, record (the WARC-Record-ID), warc_type, those of chunk_table() and error; record_id is the record's
    number in its file, from 0. What can't be read is a row with an error, see records_of(), and fails nothing else; a
    file that isn't there does. The files must be where all executors can read them; a path given twice is read twice.
    """
    schema = f"path string, record string, warc_type string, {SCHEMA}, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, heads, number = _Rows(), [], -1
                with _open(path) as stream:
                    for headers, no, at, part, last, sha1, error in records_of(stream, chunk_bytes):
                        number += no == 0
                        heads.append((path, headers.get("warc-record-id"), headers.get("warc-type"), error))
                        for out in rows.add(number, headers.get("warc-target-uri"), no, at, len(part), last, part, sha1):
                            yield _with(heads, out)
                    for out in rows.flush():
                        yield _with(heads, out)

    def _with(heads: list[tuple], out: pa.RecordBatch) -> pa.RecordBatch:
        path, record, kind, error = (pa.array(x, pa.string()) for x in zip(*heads))
        heads.clear()
        return pa.RecordBatch.from_arrays([path, record, kind, *out.columns, error], ["path", "record", "warc_type", *_NAMES, "error"])

    if not paths:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(run, schema)


def _head(record_id: int | None, uri: str | None, size: int) -> bytes:
    uri = uri and uri.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:record:{'' if record_id is None else record_id}>", *([f"WARC-Target-URI: {uri}"] if uri else []), f"Content-Length: {size}"]
    return "\r\n".join([*lines, "", ""]).encode()


def warc_bytes(record_id: int | None, uri: str | None, payload: bytes) -> bytes:
    """One record of type resource."""
    return _head(record_id, uri, len(payload)) + payload + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, record_id: str = "page_id", uri: str = "url", payload: str = "html") -> list[str]:
    """Write a record for each page that has a payload, a file for each partition, and give the files' paths.

    A payload is written from the column's buffer in pieces. A file gets its name once it is whole, so a task that runs
    again, or twice at once, leaves one file of the same bytes; partitions without a record leave none. An id or
    address that is null is left empty or out.
    """
    system, inner = file_system(folder)
    system.create_dir(inner, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}.warc"
        own, final = file_system(name)
        part, stream = f"{final}.{task.taskAttemptId()}", None
        for b in batches:
            ids, uris = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in range(b.num_rows):
                if b.column(2)[k].is_valid:
                    stream = stream or own.open_output_stream(part)
                    view = memoryview(b.column(2)[k].as_buffer())
                    stream.write(_head(ids[k], uris[k], len(view)))
                    for at in range(0, len(view), 1 << 20):
                        stream.write(view[at : at + (1 << 20)])
                    stream.write(b"\r\n\r\n")
        if stream:
            stream.close()
            own.move(part, final)
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["path"])

    one = pages.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(uri).cast("string").alias("uri"), F.col(payload).cast("binary").alias("payload"))
    return sorted(r[0] for r in one.mapInArrow(run, "path string").collect())


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC files in the shared folder, those read in a stream as chunks; payloads in base64. A page's id is in its record's."""
    paths = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    chunks = read_warc(spark, paths).withColumn("record_id", F.regexp_extract("record", r"^<urn:record:(-?\d+)>$", 1).try_cast("bigint"))
    return chunks.select(*_NAMES).withColumn("payload", F.translate(F.base64("payload"), "\r\n", ""))


OP7_SQL = f"""
WITH p AS (SELECT page_id::BIGINT AS record_id, url AS uri, encode(html) AS b FROM pages WHERE html IS NOT NULL),
c AS (SELECT *, octet_length(b) AS n, unnest(range(0, greatest(octet_length(b), 1), {CHUNK_BYTES})) AS begin FROM p)
SELECT record_id, uri, (begin // {CHUNK_BYTES})::INTEGER AS chunk_no, begin::BIGINT AS begin, (least(begin + {CHUNK_BYTES}, n) - begin)::INTEGER AS n_bytes,
  begin + {CHUNK_BYTES} >= n AS last, base64(b[begin + 1 : begin + {CHUNK_BYTES}]) AS payload, sha1(b[1 : begin + {CHUNK_BYTES}]) AS sha1
FROM c
"""
