"""Corpora in the formats that search collections come in."""

from __future__ import annotations

import codecs
import gzip
import json
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of a JSON file that are read at a time, and bytes of rows that are handed on together.
_READ, _BATCH = 1 << 20, 4 << 20


def tsv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Tab-separated rows without a header or quoting, every column a string; doc_id is hashed from the row unless `columns` has it."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).csv(path, sep="\t", quote="", header=False)
    return rows if "doc_id" in columns else rows.withColumn("doc_id", F.xxhash64(*columns))


def members(stream: BinaryIO) -> Iterator[tuple[str, object]]:
    """(key, value) of one JSON object, read piece by piece: a member at a time is held, however large the file."""
    decode, parse = codecs.getincrementaldecoder("utf-8-sig")(), json.JSONDecoder()
    held, at, done = "", 0, False

    def more() -> None:
        nonlocal held, at, done
        piece = stream.read(max(_READ, len(held) - at))  # as much again as a member that isn't whole yet has
        done = not piece
        held, at = held[at:] + decode.decode(piece, done), 0

    def mark() -> str:
        nonlocal at
        while True:
            while at < len(held) and held[at] in " \t\r\n":
                at += 1
            if at < len(held) or done:
                return held[at : at + 1]
            more()

    def value() -> object:
        nonlocal at
        mark()
        while True:
            try:
                found, end = parse.raw_decode(held, at)
                if end < len(held) or done:  # a number may go on in the next piece
                    at = end
                    return found
            except ValueError:
                if done:
                    raise
            more()

    def expect(wanted: str) -> str:
        nonlocal at
        c = mark()
        if not c or c not in wanted:
            raise ValueError(f"one of {wanted!r} is expected, not {c!r}")
        at += 1
        return c

    expect("{")
    if mark() == "}":
        return
    while True:
        key = value()
        expect(":")
        yield key, value()
        if expect(",}") == "}":
            return


def json_map(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """JSON objects of id to record, gzipped or not: a row (doc_id, *fields) for each record, what is missing as ''.

    A file is a task, and is read as a stream. Values that aren't strings are given as JSON.
    """
    names = ["doc_id", *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)
        plain = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v)
        for b in batches:
            for name in b.column(0).to_pylist():
                system, inner = (pafs.LocalFileSystem(), name.removeprefix("file:")) if "://" not in name else pafs.FileSystem.from_uri(name)
                rows, size = [], 0
                with system.open_input_stream(inner, compression=None) as raw, gzip.GzipFile(fileobj=raw) if inner.endswith(".gz") else raw as stream:
                    for key, record in members(stream):
                        record = record if isinstance(record, dict) else {}
                        rows.append((key, *(plain(record.get(f)) for f in fields)))
                        size += sum(map(len, rows[-1]))
                        if size >= _BATCH:
                            yield flush(rows)
                            rows, size = [], 0
                if rows:
                    yield flush(rows)

    files = spark.read.format("binaryFile").load(path).select("path")  # contents aren't read here
    return files.repartition("path").mapInArrow(run, ", ".join(f"`{n}` string" for n in names))


def parquet(spark: SparkSession, path: str, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text): only these two columns are read."""
    return spark.read.parquet(path).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
