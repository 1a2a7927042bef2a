"""Documents of an index as rows: look-up, equality, counting, grouping and order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from postlane.operators.index import SearchIndex, as_terms
from postlane.operators.shared import settle


def term_sets(index: SearchIndex) -> DataFrame:
    """(doc_id, terms, doc_len): each document's distinct terms in order; none where it has no words.

    Of the words that an index of texts keeps by document, without a shuffle; from postings where there are none.
    """
    if index.rows is not None:
        return index.rows.select("doc_id", F.sort_array(F.array_distinct("words")).alias("terms"), "doc_len")
    sets = index.postings.groupBy("doc_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    return index.docs.join(sets, "doc_id", "left").select("doc_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), "doc_len")


def _same(doc_len: Column | str = "doc_len") -> Column:
    """A digest of the terms and the length: 32 bytes move in place of a document."""
    return F.unhex(F.sha2(F.concat(F.to_json("terms"), F.col(doc_len).cast("string")), 256))


def _bag(words: DataFrame) -> DataFrame:
    return words.select("doc_id", F.posexplode("words").alias("pos", "term")).groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("posns")).select("term", F.size("posns").alias("tf"), "posns")


def document(index: SearchIndex, doc_id: int) -> DataFrame:
    """(term, tf, posns) of one document; IndexError where there is no such document."""
    if index.docs.where(F.col("doc_id") == doc_id).isEmpty():
        raise IndexError(doc_id)
    if index.rows is not None:
        return _bag(index.rows.where(F.col("doc_id") == doc_id))
    return index.postings.where(F.col("doc_id") == doc_id).select("term", "tf", "posns")


@dataclass(frozen=True)
class Terms:
    """One document on the driver: its terms' frequencies and places, and how many words it has."""

    postings: dict[str, int]
    posns: dict[str, list[int]]
    doc_len: int

    @classmethod
    def of(cls, index: SearchIndex, doc_id: int) -> Terms:
        rows = document(index, doc_id).collect()
        length = index.docs.where(F.col("doc_id") == doc_id).first()["doc_len"]
        return cls({r["term"]: r["tf"] for r in rows}, {r["term"]: list(r["posns"]) for r in rows}, length)

    def termfreq(self, term: str) -> int:
        return self.postings[term]

    def terms(self) -> list[tuple[str, int]]:
        return sorted(self.postings.items())

    def positions(self, term: str | None = None) -> list:
        """The places of a term, or (term, places) of all."""
        return sorted(self.posns.items()) if term is None else self.posns[term]

    def raw_positions(self, numbers: dict[str, int], term: str | None = None) -> list[tuple[int, list[int]]]:
        """(number, places) by the numbers that terms are given."""
        return [(numbers[t], self.posns[t]) for t in (sorted(self.posns) if term is None else [term])]

    def tf_to_dense(self, numbers: dict[str, int]) -> list[int]:
        """Frequencies at the terms' numbers."""
        out = [0] * len(numbers)
        for t, f in self.postings.items():
            out[numbers[t]] = f
        return out

    def __len__(self) -> int:
        return len(self.postings)


def each(index: SearchIndex) -> Iterator[Row]:
    """(doc_id, terms, doc_len) of each document in turn, a partition at a time on the driver."""
    return term_sets(index).toLocalIterator()


def take(index: SearchIndex, wanted: DataFrame) -> DataFrame:
    """(ord, doc_id, terms, doc_len) for each row of wanted (ord, doc_id); a doc_id that isn't there gives an empty document."""
    ids = wanted.select("doc_id").distinct()
    some = index._only(ids, "left_semi")
    found = wanted.select("ord", "doc_id").join(term_sets(some), "doc_id", "left")
    return found.select("ord", "doc_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("doc_len", F.lit(0)).alias("doc_len"))


def equal(left: SearchIndex, right: SearchIndex) -> DataFrame:
    """(doc_id, equal) for documents of either: whether both have the same set of terms and as many words."""
    a, b = (term_sets(x).select("doc_id", _same().alias(n)) for x, n in ((left, "a"), (right, "b")))
    return a.join(b, "doc_id", "full").select("doc_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("equal"))


def is_missing(index: SearchIndex) -> DataFrame:
    """(doc_id, missing): whether the document has no words."""
    return index.docs.select("doc_id", (F.col("doc_len") == 0).alias("missing"))


def value_counts(index: SearchIndex, dropna: bool = True) -> DataFrame:
    """(terms, doc_len, n): how many documents are equal, those without words left out unless dropna is false."""
    rows = term_sets(index)
    return (rows.where("doc_len > 0") if dropna else rows).groupBy("terms", "doc_len").agg(F.count("*").alias("n"))


def unique(index: SearchIndex) -> DataFrame:
    """(terms, doc_len): each of the documents that differ once."""
    return term_sets(index).select("terms", "doc_len").distinct()


def factorize(index: SearchIndex) -> DataFrame:
    """(doc_id, code, n): equal documents have the same code, the least doc_id among them; -1 without words."""
    rows = term_sets(index).select("doc_id", F.when(F.col("doc_len") > 0, _same()).alias("same"))
    code = rows.where("same IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("code"), F.count("*").alias("n"))
    return rows.join(code, "same", "left").select("doc_id", F.coalesce("code", F.lit(-1)).alias("code"), F.coalesce("n", F.lit(0)).alias("n"))


def sort_documents(index: SearchIndex) -> DataFrame:
    """(doc_id, rank): documents in order, compared as sparse vectors of frequencies over the terms in order.

    At the first term whose frequency differs the lower one comes first, a term that is absent having 0: so a document
    that lacks a term sorts before one that has it. Equal ones are ordered by doc_id. That is the order of the arrays
    of all words, sorted, with each word's bytes turned round and closed by a mark above them all; the longer of two
    that agree so far comes later. Documents are sorted in ranges, which are written, and each range's ranks begin
    after those of the ranges before: no task sees more than a range.
    """
    if index.rows is not None:
        words = index.rows.select("doc_id", F.sort_array("words").alias("words"))
    else:
        every = F.sort_array(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf")))))
        words = index.docs.select("doc_id").join(index.postings.groupBy("doc_id").agg(every.alias("words")), "doc_id", "left")
    back = lambda t: F.concat(F.translate(F.hex(F.encode(t, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    keyed = words.select("doc_id", F.transform(F.coalesce("words", F.array().cast("array<string>")), back).alias("key"))
    ranges = int(index.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(ranges, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    placed = settle(ordered.select("doc_id", F.monotonically_increasing_id().alias("place")), "order")
    placed = placed.select("doc_id", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("place"))
    sizes = placed.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))  # a row for each range, as many as shuffle partitions
    return placed.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("place") + 1).cast("int").alias("rank"))


def term_frequencies(index: SearchIndex, terms: list[str]) -> DataFrame:
    """(doc_id, tf_0, tf_1, ...): a dense column for each of the terms."""
    terms = as_terms(terms)
    rows = index.postings.where(F.col("term").isin(terms))
    wide = rows.groupBy("doc_id").agg(*(F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf_{k}") for k, t in enumerate(terms)))
    return index.docs.select("doc_id").join(wide, "doc_id", "left").fillna(0)
