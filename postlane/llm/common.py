"""What the training-data operators share: shared-folder tables, blocks of text, stable random numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlane.operators.shared import folder as shared_folder, settle

#: Bytes of text that the numpy kernels work on at a time; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Numbers that one array holds where rows are numbered.
ARRAY = 10_000


def drop_table(*tables: DataFrame) -> None:
    """Remove the files of tables that settle() wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """(the file system of a path or URI, the path there)."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def kept(result: DataFrame, name: str, *spent: DataFrame) -> DataFrame:
    """result as a table, and the tables that it was made from removed."""
    out = settle(result, name)
    drop_table(*spent)
    return out


def numbers(n: Column, name: str) -> tuple[Column, Callable[[DataFrame], DataFrame]]:
    """A column of arrays and a step after its explosion as `name`, that together number 1 to n; no later array is longer than ARRAY."""
    part = F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / ARRAY))
    return part, lambda df: df.withColumn(name, F.explode(F.sequence(F.col(name) * ARRAY + 1, F.least(n, (F.col(name) + 1) * ARRAY))))


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns of df, like those given but none that df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the types that the kernels expect, whatever other columns docs has."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def blocks(text: pa.Array, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about `most` bytes, or BLOCK_BYTES; a null is an empty text."""
    most = most or BLOCK_BYTES
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits (the splitmix64 finaliser)."""
    x = np.asarray(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(*words: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the words alone, so that a task run again draws the same."""
    x = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for w in words:
            x = mix(np.asarray(w).astype(np.int64).view(np.uint64) + x * np.uint64(0x9E3779B97F4A7C15))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pick_rows(docs: DataFrame, most: int, label: str, least: int, *, salt: int = 0) -> DataFrame:
    """(doc_id, label, text) of about `most` labelled rows: of each label its share of them, but `least` at any rate, or all that there are.

    doc_ids are counted by label, then picked by least hash of doc_id, so the same rows whatever the partitioning; of
    rows that repeat a doc_id the one with the least hash of the text. Texts that aren't picked don't move, and there
    are at most most + least * labels of those that are. Rows with a null in one of the three don't count. A doc_id with
    several labels counts for each, and is given with the least.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("string").alias("label"), F.col("text").cast("string").alias("text"))
    sound = rows.where("doc_id IS NOT NULL AND label IS NOT NULL AND text IS NOT NULL")
    ids = sound.select("doc_id", "label").distinct()
    counts = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
    whole = sum(counts.values())
    want = {x: min(n, max(least, round(most * n / whole))) for x, n in counts.items()}
    share = {x: 1.0 if want[x] == n else min(1.0, (want[x] + 8 * want[x] ** 0.5 + 20) / n) for x, n in counts.items()}  # a few more than wanted, to rank
    if not counts:
        return sound.select("doc_id", "label", "text")
    few = docs.sparkSession.createDataFrame([(x, int(share[x] * (1 << 62)), want[x]) for x in sorted(counts)], "label string, below bigint, want bigint")
    key = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(salt)), 2)
    near = ids.withColumn("key", key).join(F.broadcast(few), "label").where("key <= below")  # a row for each label
    turn = F.row_number().over(Window.partitionBy("label").orderBy("key", "doc_id"))
    chosen = near.withColumn("turn", turn).where("turn <= want").select("doc_id", "label")
    picked = sound.where(F.col("doc_id").isin([r["doc_id"] for r in chosen.collect()]))
    one = picked.groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("doc_id", "label", "text")
