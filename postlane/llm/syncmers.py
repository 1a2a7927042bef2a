"""Document fingerprints by closed syncmers: anchors that depend on the words under them alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from postlane.llm.common import blocks, texts_of
from postlane.llm.words import ALNUM, Hasher, grams, lower, sliding_min, spans

#: Words in a k-mer and in the inner s-mers whose least one must lie at an edge: 2 / (K - S + 1) of the places are taken.
K, S = 12, 4


def anchors(text: pa.Array, k: int = K, s: int = S, hasher: Hasher | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word place, hash of the k-mer, words of each row) for a column of texts."""
    hasher = hasher or Hasher()
    rows, places, hashes, sizes = [], [], [], np.zeros(len(text), np.int32)
    for first, last, raw, offsets in blocks(text):
        low = lower(raw)
        starts, ends, of = spans(low, offsets, ALNUM)
        n = np.bincount(of, minlength=last - first)
        sizes[first:last] = n
        if len(starts) < k:
            continue
        h = hasher(low, starts, ends)
        inner = grams(h, s)
        least = sliding_min(inner, k - s + 1)
        m = len(least)
        edge = ((least == inner[:m]) | (least == inner[k - s : k - s + m])) & (of[:m] == of[k - 1 : k - 1 + m])
        at = np.flatnonzero(edge)
        rows.append(first + of[at])
        places.append(at - (np.cumsum(n) - n)[of[at]])
        hashes.append(grams(h, k)[at])
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return join(rows, np.int64), join(places, np.int32), join(hashes, np.uint64), sizes


def _fingerprint(k: int, s: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            row, place, h, n = anchors(b.column(1), k, s, hasher)
            at = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.ListArray.from_arrays(at, pa.array(place)), pa.ListArray.from_arrays(at, pa.array(h.view(np.int64)))],
                ["doc_id", "n_words", "places", "hashes"],
            )

    return run


def syncmers(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, n_words, places, hashes): each document's closed syncmers, by the place of their first word.

    A k-mer of words is chosen when the least hash of its inner s-mers is that of the first or of the last; ties count
    for whichever lies at an edge, so the choice depends on the k words alone, and two texts that share a run of words
    choose the same places inside it. Words are in lower case, without punctuation. Texts that are null, empty or of
    fewer than k words have no anchors and keep their row with empty lists; rows that repeat each give a row; a null
    doc_id stays null. Texts are used whole. Other columns of docs are left out.
    """
    if not 0 < s <= k:
        raise ValueError("0 < s <= k is needed")
    return texts_of(docs).mapInArrow(_fingerprint(k, s), "doc_id bigint, n_words int, places array<int>, hashes array<bigint>")


def positional_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, shift, anchors): for each document of left and each of right, the shared anchors by the shift between their places.

    left must be a stated set of queries, as an anchor that many documents have meets all of its queries; equal places
    of a passage give one row a pair of documents. Texts without anchors, of fewer than k words, meet nothing.
    """
    flat = lambda d, x: d.where("doc_id IS NOT NULL").select(F.col("doc_id").alias(x), F.explode(F.arrays_zip("places", "hashes")).alias("z")).select(x, F.col("z.places").alias(f"{x}_place"), F.col("z.hashes").alias("hash"))
    both = flat(left, "a").join(flat(right, "b"), "hash")
    return both.groupBy("a", "b", (F.col("b_place") - F.col("a_place")).alias("shift")).agg(F.count("*").alias("anchors"))


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers(spark.read.parquet(f"{sf_dir}/documents.parquet"))
