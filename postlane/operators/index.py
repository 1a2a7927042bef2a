"""A positional inverted index over a text column, as lazy DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from postlane.functions.similarity import Similarity, default_bm25
from postlane.functions.tokenizers import NAMED, Tokenizer, resolve
from postlane.operators import phrases
from postlane.operators.gather import gathered

#: Words of a document that have a place, and the step that bounds of places must keep to.
MAX_PLACES, STEP = (1 << 18) - 1, 18
#: Bytes that a saved index's own counts must bound a table by for it to be broadcast.
BROADCAST_BYTES = 8 << 20


class TermMissingError(KeyError):
    """No document has the term."""


@dataclass(frozen=True)
class SearchIndex:
    """postings (term, doc_id, tf, posns, doc_len), docs (doc_id, doc_len), stats (n_docs, avg_doc_len; one row), the tokenizer.

    stats are those of the documents that the index was built of: a filtered index keeps them, while document
    frequencies are counted among the documents that are left. rows (doc_id, doc_len, words) are the documents as they
    were cut, where the index was made of texts. A saved index has terms (term, df, cf) too: plans are made with the
    counts of the query's terms, looked up once and kept.
    """

    postings: DataFrame
    docs: DataFrame
    stats: DataFrame
    tokenizer: Tokenizer
    rows: DataFrame | None = None
    terms: DataFrame | None = None
    max_places: int = MAX_PLACES
    known: dict = field(default_factory=dict, compare=False, repr=False)

    # building

    @classmethod
    def build(cls, df: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: Tokenizer | Callable[[str], Sequence[str]] | str | None = None, truncate: bool = False, max_places: int = MAX_PLACES) -> SearchIndex:
        """Index df[text] by df[doc_id], which tells documents apart. A longer document than max_places is an error when the index is read, or is cut with truncate. Nulls are documents without words."""
        if not isinstance(df, DataFrame):
            raise TypeError("a DataFrame is needed")
        kind = dict(df.dtypes)[text]
        if kind not in ("string", "void"):
            raise TypeError(f"{text} is {kind}, not string")
        cut = resolve(tokenizer)
        return cls.of_tokens(token_table(spread(df.select(doc_id, text)), text, doc_id, cut, truncate, max_places), cut, max_places)

    @classmethod
    def of_tokens(cls, tokens: DataFrame, tokenizer: Tokenizer, max_places: int = MAX_PLACES) -> SearchIndex:
        """From (doc_id, tokens)."""
        rows = tokens.select("doc_id", F.size("tokens").alias("doc_len"), F.col("tokens").alias("words"))
        docs = rows.select("doc_id", "doc_len")
        return cls(postings_of(rows, max_places), docs, stats_of(docs), tokenizer, rows, max_places=max_places)

    @classmethod
    def from_counts(cls, df: DataFrame, counts: str = "counts", doc_id: str = "doc_id") -> SearchIndex:
        """From a map<string, int> of term frequencies: no places, and a document is as long as it has terms."""
        if not dict(df.dtypes)[counts].startswith("map<string"):
            raise TypeError(f"{counts} must be a map of terms to frequencies")
        rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(counts).cast("map<string,int>"), F.create_map().cast("map<string,int>")).alias("m"))
        docs = rows.select("doc_id", F.cardinality("m").alias("doc_len"))
        postings = rows.select("doc_id", F.cardinality("m").alias("doc_len"), F.explode("m").alias("term", "tf")).select("term", "doc_id", "tf", F.array().cast("array<int>").alias("posns"), "doc_len")
        return cls(postings, docs, stats_of(docs), resolve(None))

    def save(self, path: str, files: int | None = None) -> None:
        """Write the index: postings sorted by term over ranges of (term, doc_id), so that reading a term skips the rest.

        Texts are cut once, as the documents are written; places are taken from there, and a document's words are
        gathered into its postings before they move.
        """
        spark = self.postings.sparkSession
        n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
        write = lambda df, x: df.write.mode("overwrite").parquet(f"{path}/{x}")
        write(self.docs if self.rows is None else self.rows, "docs")
        docs = spark.read.parquet(f"{path}/docs")
        if self.rows is not None:
            postings = postings_of(docs, self.max_places, once=docs.groupBy("doc_id").count().where("count > 1").isEmpty())
        else:
            postings = self.postings
        write(postings.repartitionByRange(n, "term", "doc_id").sortWithinPartitions("term", "doc_id"), "postings")
        write(counts_of(spark.read.parquet(f"{path}/postings")).repartitionByRange(n, "term").sortWithinPartitions("term"), "terms")
        write(self.stats if self.rows is None else stats_of(docs), "stats")
        spark.createDataFrame([(json.dumps({"tokenizer": self.tokenizer.name}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str, tokenizer: Tokenizer | None = None) -> SearchIndex:
        """Read a saved index. A tokenizer that isn't one of NAMED must be given again."""
        name = json.loads(spark.read.text(f"{path}/about").first()[0])["tokenizer"]
        if tokenizer is None and name not in NAMED:
            raise ValueError(f"the tokenizer {name!r} must be given")
        read = lambda x: spark.read.parquet(f"{path}/{x}")
        docs = read("docs")
        return cls(read("postings"), docs.select("doc_id", "doc_len"), read("stats"), tokenizer or NAMED[name], docs if "words" in docs.columns else None, read("terms"))

    def union(self, other: SearchIndex) -> SearchIndex:
        """The documents of both, whose ids must differ; statistics are counted again."""
        docs = self.docs.unionByName(other.docs)
        rows = None if self.rows is None or other.rows is None else self.rows.unionByName(other.rows)
        return SearchIndex(self.postings.unionByName(other.postings), docs, stats_of(docs), self.tokenizer, rows)

    def upsert(self, other: SearchIndex) -> SearchIndex:
        """The documents of other in place of those with the same id, or beside them."""
        return self._only(other.docs.select("doc_id"), "left_anti").union(other)

    def filter(self, keep: Column | DataFrame) -> SearchIndex:
        """Documents that a condition on doc_id and doc_len, or a table of doc_id, picks; n_docs and avg_doc_len stay those of all."""
        if isinstance(keep, DataFrame):
            return self._only(keep.select("doc_id").distinct(), "left_semi")
        # postings and rows have both columns that a condition may name
        return replace(self, postings=self.postings.where(keep), docs=self.docs.where(keep), rows=None if self.rows is None else self.rows.where(keep), terms=None, known={})

    def _only(self, ids: DataFrame, how: str) -> SearchIndex:
        some = lambda df: df.join(ids, "doc_id", how).select(*df.columns)
        return replace(self, postings=some(self.postings), docs=some(self.docs), rows=None if self.rows is None else some(self.rows), terms=None, known={})

    def __len__(self) -> int:
        return self.docs.count()

    # statistics

    def _counts(self, terms: Sequence[str]) -> dict[str, tuple[int, int]]:
        """{term: (df, cf)} of a saved index: a row for each of the query's terms, read by a filter on sorted files, and kept."""
        unknown = [t for t in dict.fromkeys(terms) if t not in self.known]
        if unknown:
            found = {r["term"]: (r["df"], r["cf"]) for r in self.terms.where(F.col("term").isin(unknown)).collect()}
            self.known.update({t: found.get(t, (0, 0)) for t in unknown})
        return {t: self.known[t] for t in terms}

    def with_numbers(self, rows: DataFrame, terms: Sequence[str]) -> tuple[DataFrame, list[Column], Column, Column]:
        """(rows, df of each term, avg_doc_len, n_docs): literals where the index is saved, else columns added to rows."""
        if self.terms is not None:
            counts = self._counts(terms)
            if None not in self.known:
                self.known[None] = tuple(self.stats.first())
            n, avg = self.known[None]
            return rows, [F.lit(counts[t][0]).cast("bigint") for t in terms], F.lit(avg), F.lit(n).cast("bigint")
        distinct = list(dict.fromkeys(terms))
        rows = rows.crossJoin(F.broadcast(self.stats)).crossJoin(F.broadcast(self._dfs(distinct)))  # a row each
        return rows, [F.col(f"df{distinct.index(t)}") for t in terms], F.col("avg_doc_len"), F.col("n_docs")

    def term_stats(self) -> DataFrame:
        """(term, df, cf): documents that have it, and occurrences."""
        return counts_of(self.postings) if self.terms is None else self.terms

    def docfreq(self, term: str) -> DataFrame:
        """One row: (term, df)."""
        if not isinstance(term, str):
            raise TypeError("a term is a string")
        if self.terms is not None:
            return self.terms.where(F.col("term") == term).agg(F.coalesce(F.max("df"), F.lit(0)).alias("df")).select(F.lit(term).alias("term"), "df")
        return self.postings.where(F.col("term") == term).agg(F.count("*").alias("df")).select(F.lit(term).alias("term"), "df")

    def doc_lengths(self) -> DataFrame:
        return self.docs

    def top_terms(self, n: int = 10) -> DataFrame:
        """(term, n_bytes, running_bytes): the n terms whose postings take most room (8 bytes for a document, 4 for a place)."""
        size = self._bytes()
        top = size.orderBy(F.desc("n_bytes"), "term").limit(n)
        w = Window.orderBy(F.desc("n_bytes"), "term").rowsBetween(Window.unboundedPreceding, 0)
        return top.withColumn("running_bytes", F.sum("n_bytes").over(w))

    def _bytes(self) -> DataFrame:
        if self.terms is not None and self.rows is not None:
            return self.terms.select("term", (8 * F.col("df") + 4 * F.col("cf")).alias("n_bytes"))
        return self.postings.groupBy("term").agg(F.sum(8 + 4 * F.size("posns")).cast("bigint").alias("n_bytes"))

    def memory_usage(self) -> DataFrame:
        """One row: (n_bytes) that postings take, counted as in top_terms(), with 4 more for each document's length."""
        size = self._bytes().agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("p"))
        return size.crossJoin(F.broadcast(self.docs.agg(F.count("*").alias("n")))).select((F.col("p") + 4 * F.col("n")).cast("bigint").alias("n_bytes"))  # a row each

    # matching

    def _places(self, terms: Sequence[str], min_posn: int | None, max_posn: int | None) -> tuple[DataFrame, list[Column]]:
        """A row for each document that has every term, with doc_len and a column of places for each.

        In a saved index the most frequent term's postings are streamed past those of the others, the rarest first.
        Another term's postings are broadcast where their counts bound them; where only the rarest's do, the others
        are cut to its documents first. Beyond that it is a join like any other, by doc_id.
        """
        distinct = list(dict.fromkeys(terms))

        def one(t: str, *more: str) -> DataFrame:
            places, name = F.col("posns"), f"p{distinct.index(t)}"
            if min_posn is not None or max_posn is not None:
                inside = lambda p: (p >= (min_posn or 0)) & (p <= (max_posn if max_posn is not None else 2**31 - 1))
                places = F.filter(places, inside)
            return self.postings.where(F.col("term") == t).select("doc_id", *more, places.alias(name)).where(F.size(name) > 0)

        if self.terms is None:
            wide = one(distinct[0], "doc_len")
            for t in distinct[1:]:
                wide = wide.join(one(t), "doc_id")
        else:
            counts = self._counts(distinct)
            order = sorted(distinct, key=lambda t: counts[t])
            rarest, small = order[0], lambda df, cf: 48 * df + 4 * cf <= BROADCAST_BYTES
            wide = one(order[-1], "doc_len")
            if not counts[rarest][0]:
                wide = wide.where(F.lit(False)).select("*", *(F.array().cast("array<int>").alias(f"p{distinct.index(t)}") for t in order[:-1]))
                order = order[:1]
            for t in order[:-1]:
                side = one(t)
                if small(*counts[t]):
                    side = F.broadcast(side)
                elif small(counts[rarest][0], 0):
                    side = side.join(F.broadcast(one(rarest).select("doc_id")), "doc_id", "left_semi")
                    side = F.broadcast(side) if small(counts[rarest][0], counts[t][1]) else side
                wide = wide.join(side, "doc_id")
        return wide, [F.col(f"p{distinct.index(t)}") for t in terms]

    def _hits(self, terms: Sequence[str], slop: int, min_posn: int | None, max_posn: int | None) -> DataFrame:
        """(doc_id, tf, doc_len) of the documents that have the term or the phrase."""
        check_places(min_posn, max_posn)
        if len(terms) == 1:
            if min_posn is None and max_posn is None:
                return self.postings.where(F.col("term") == terms[0]).select("doc_id", "tf", "doc_len")
            wide, (p,) = self._places(terms, min_posn, max_posn)
            return wide.select("doc_id", F.size(p).alias("tf"), "doc_len")
        wide, places = self._places(terms, min_posn, max_posn)
        tf = phrases.near(places, terms, slop) if slop else phrases.exact(places, terms[0] == terms[1])
        return wide.select("doc_id", tf.cast("int").alias("tf"), "doc_len").where("tf > 0")

    def matches(self, token: str | Sequence[str], slop: int = 0, min_posn: int | None = None, max_posn: int | None = None) -> DataFrame:
        """(doc_id, tf) of the documents that have the term or the phrase."""
        return self._hits(as_terms(token), slop, min_posn, max_posn).select("doc_id", "tf")

    def _few(self, terms: Sequence[str], row_bytes: int) -> bool:
        """Whether the counts of a saved index bound the documents that have every term to BROADCAST_BYTES."""
        return self.terms is not None and min(df for df, _ in self._counts(terms).values()) * row_bytes <= BROADCAST_BYTES

    def _dense(self, sparse: DataFrame, column: str, zero: Column, few: bool) -> DataFrame:
        return self.docs.select("doc_id").join(F.broadcast(sparse) if few else sparse, "doc_id", "left").select("doc_id", F.coalesce(column, zero).alias(column))

    def termfreqs(self, token: str | Sequence[str], slop: int = 0, min_posn: int | None = None, max_posn: int | None = None) -> DataFrame:
        """(doc_id, tf) of every document, 0 where there is none."""
        terms = as_terms(token)
        return self._dense(self.matches(token, slop, min_posn, max_posn), "tf", F.lit(0), self._few(terms, 32))

    def positions(self, term: str, check: bool = False) -> DataFrame:
        """(doc_id, posns) of every document; with check, TermMissingError where no document has the term."""
        hits = self.postings.where(F.col("term") == term).select("doc_id", "posns")
        if check and (hits.isEmpty() if self.terms is None else not self._counts([term])[term][0]):
            raise TermMissingError(term)
        few = self.terms is not None and 32 * self._counts([term])[term][0] + 4 * self._counts([term])[term][1] <= BROADCAST_BYTES
        return self._dense(hits, "posns", F.array().cast("array<int>"), few)

    def _dfs(self, terms: Sequence[str]) -> DataFrame:
        distinct = list(dict.fromkeys(terms))
        return self.postings.where(F.col("term").isin(distinct)).agg(*(F.count(F.when(F.col("term") == t, 1)).alias(f"df{k}") for k, t in enumerate(distinct)))

    def score(self, token: str | Sequence[str], similarity: Similarity = default_bm25, slop: int = 0, min_posn: int | None = None, max_posn: int | None = None, sparse: bool = False) -> DataFrame:
        """(doc_id, score) of every document, or with sparse of those that match. Document frequencies count whole documents, whatever the bounds of places."""
        terms = as_terms(token)
        rows, dfs, avg, n = self.with_numbers(self._hits(terms, slop, min_posn, max_posn), terms)
        scored = rows.select("doc_id", similarity(F.col("tf"), dfs, F.col("doc_len"), avg, n).cast("double").alias("score"))
        return scored if sparse else self._dense(scored, "score", F.lit(0.0), self._few(terms, 32))

    def top(self, token: str | Sequence[str], n: int, similarity: Similarity = default_bm25, slop: int = 0, min_posn: int | None = None, max_posn: int | None = None) -> DataFrame:
        """The n best (doc_id, score) of every document, ties by doc_id.

        Only matches are scored: beside the n best of them the n first of the other documents, which score 0, can be
        among the best, and they are looked for only where fewer than n score above 0. That is known for a term of a
        saved index that n documents have; else one job over the matches runs, which collects n rows.
        """
        terms, order = as_terms(token), [F.desc("score"), F.asc("doc_id")]
        hits = self.score(token, similarity, slop, min_posn, max_posn, sparse=True)
        best = hits.orderBy(*order).limit(n)
        if self.terms is not None and len(terms) == 1 and min_posn is None and max_posn is None and getattr(similarity, "positive", False) and self._counts(terms)[terms[0]][0] >= n:
            return best
        found = best.collect()
        if len(found) < n or not found[-1]["score"] > 0:
            rest = self.docs.select("doc_id").join(hits.select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(n)
            return best.unionByName(rest.withColumn("score", F.lit(0.0))).orderBy(*order).limit(n)
        return self.docs.sparkSession.createDataFrame(found, best.schema).orderBy(*order)

    # boolean queries

    def all_of(self, terms: Sequence[str]) -> DataFrame:
        """doc_id of the documents that have every term."""
        return self.at_least(terms, len(set(terms)))

    def at_least(self, terms: Sequence[str], least: int = 1) -> DataFrame:
        """doc_id of the documents that have `least` of the terms."""
        rows = self.postings.where(F.col("term").isin(list(dict.fromkeys(terms))))
        return rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("doc_id")


def as_terms(token: str | Sequence[str]) -> list[str]:
    if isinstance(token, str):
        return [token]
    if not isinstance(token, list) or not all(isinstance(t, str) for t in token):
        raise TypeError("a term is a string, a phrase a list of strings")
    if not token:
        raise ValueError("a phrase has at least one term")
    return token


def check_places(min_posn: int | None, max_posn: int | None) -> None:
    if min_posn is not None and min_posn % STEP:
        raise ValueError(f"min_posn must be a multiple of {STEP}")
    if max_posn is not None and max_posn % STEP != STEP - 1:
        raise ValueError(f"max_posn must be one less than a multiple of {STEP}")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where a small file would leave most of them idle; else df."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() < cores else df


def token_table(df: DataFrame, text: str, doc_id: str, tokenizer: Tokenizer, truncate: bool = False, max_places: int = MAX_PLACES) -> DataFrame:
    """(doc_id, tokens)."""
    rows = df.select(F.col(doc_id).alias("doc_id"), tokenizer.column(F.col(text)).alias("tokens"))
    if truncate:
        return rows.withColumn("tokens", F.slice("tokens", 1, max_places))
    return rows


def triples(rows: DataFrame, max_places: int = MAX_PLACES) -> DataFrame:
    """(doc_id, doc_len, pos, term) of (doc_id, doc_len, words). The outer form keeps the optimizer from asking for the words' number first, which would cut every text twice."""
    flat = rows.select("doc_id", "doc_len", F.posexplode_outer("words").alias("pos", "term")).where("pos IS NOT NULL")
    too_long = F.raise_error(F.lit(f"a document has more words than {max_places}")).cast("string")
    return flat.withColumn("term", F.when(F.col("pos") >= max_places, too_long).otherwise(F.col("term")))


def postings_of(rows: DataFrame, max_places: int = MAX_PLACES, once: bool = False) -> DataFrame:
    """(term, doc_id, tf, posns, doc_len) of (doc_id, doc_len, words). Rows that share a doc_id are one document's texts, which are brought together first; with once no two do, and nothing moves."""
    too_long = F.raise_error(F.lit(f"a document has more words than {max_places}")).cast("array<string>")
    whole = rows.select("doc_id", "doc_len", F.when(F.size("words") > max_places, too_long).otherwise(F.col("words")).alias("words"))
    if once:
        return gathered(whole, F.array("words"))
    return gathered(whole.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"), F.collect_list("words").alias("texts")), F.col("texts"))


def counts_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("cf"))


def stats_of(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_doc_len"))
