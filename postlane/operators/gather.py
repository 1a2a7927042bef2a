"""A document's words gathered into its postings before anything moves: an Arrow kernel that holds one stretch of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

#: Words that are gathered at a time; a longer document is a stretch of its own.
WORDS = 1 << 20


def stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbours (from, to) whose sizes sum up to `most` or less; a larger one stands alone."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start = stop


def _ranks(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the order of the values, each one's rank in it)."""
    order = pc.array_sort_indices(values).to_numpy(zero_copy_only=False).astype(np.int64)
    ranks = np.empty_like(order)
    ranks[order] = np.arange(len(order))
    return order, ranks


def _postings(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(term, doc_id, tf, posns, doc_len) of documents (doc_id, doc_len, texts); a place is that of a word in its own text.

    In order of term and doc_id: sorting what many stretches give merges runs, which is less than sorting rows.
    """
    ids, lengths, texts = (batch.column(k) for k in range(3))
    by_id, id_rank = _ranks(ids)
    of_texts, doc_of_text = pc.list_flatten(texts), id_rank[pc.list_parent_indices(texts).to_numpy(zero_copy_only=False).astype(np.int64)]
    text = pc.list_parent_indices(of_texts).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.list_flatten(of_texts).dictionary_encode(null_encoding="encode")
    by_term, term_rank = _ranks(words.dictionary)
    n = len(text)
    place = np.arange(n, dtype=np.int64) - np.searchsorted(text, np.arange(len(of_texts)))[text]
    # term, document and place in one number: far below 2^63, as a stretch has few words and documents
    docs, places = len(ids), int(place.max(initial=0)) + 1
    keys = np.sort((term_rank[words.indices.to_numpy(zero_copy_only=False)] * docs + doc_of_text[text]) * places + place)
    pairs = keys // places
    starts = np.flatnonzero(np.concatenate([[True] if n else [], pairs[1:] != pairs[:-1]]).astype(bool))
    offsets = np.append(starts, n).astype(np.int32)
    which = pa.array(by_id[pairs[starts] % docs])
    term = words.dictionary.take(pa.array(by_term[pairs[starts] // docs]))
    posns = pa.ListArray.from_arrays(pa.array(offsets), pa.array((keys % places).astype(np.int32)))
    return pa.RecordBatch.from_arrays([term, ids.take(which), pa.array(np.diff(offsets)), posns, lengths.take(which)], names=["term", "doc_id", "tf", "posns", "doc_len"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
        for start, stop in stretches(sizes, WORDS):
            yield _postings(batch.slice(start, stop - start))


def gathered(documents: DataFrame, texts: Column) -> DataFrame:
    """(term, doc_id, tf, posns, doc_len) of documents that have a row each, with doc_id, doc_len and an array of their texts' words. Nothing is shuffled."""
    size = F.aggregate(texts, F.lit(0), lambda n, t: n + F.coalesce(F.size(t), F.lit(0)))
    kind = next(f.dataType for f in documents.schema if f.name == "doc_id")
    schema = StructType().add("term", "string").add("doc_id", kind).add("tf", IntegerType()).add("posns", ArrayType(IntegerType())).add("doc_len", IntegerType())
    return documents.select("doc_id", "doc_len", texts.alias("texts"), size.alias("size")).mapInArrow(_gather, schema)
