"""The search queries by name: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlane.functions import similarity as sim, tokenizers as tok
from postlane.functions.query_syntax import minimum_should_match
from postlane.operators import documents as docs_ops, sets
from postlane.operators.edismax import edismax, read_query
from postlane.operators.index import SearchIndex, token_table, triples
from postlane.operators.results import Results
from postlane.operators.shared import folder
from postlane.plans.corpora import documents, index, table, tokenizer_of
from postlane.sources import readers
from postlane.streaming import append

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TERM, OTHER = "the", "of"
PHRASES = {"phrase_2": ["of", "the"], "phrase_3": ["The", "and", "attion"], "phrase_5": ["attion", "to", "thanedble", "the,", "anea."], "phrase_same_term": ["the", "the"], "phrase_missing": ["the", "no-such-word"]}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", F.round("score", 6).alias("score"))


def _tokenized(name: str, tokenizer: tok.Tokenizer) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tokens = documents(spark, sf_dir).select("doc_id", tokenizer.column(F.col("text")).alias("t"))
        return tokens.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("joined"))

    QUERIES[name] = run


for _name, _tokenizer in {
    "tokenize_ws": tok.whitespace, "tokenize_lower": tok.lowercase, "tokenize_ws_punc": tok.stripped, "tokenize_fold": tok.folded,
    "tokenize_keyword": tok.keyword, "tokenize_constant": tok.constant, "tokenize_udf": tok.from_callable(lambda t: t.lower().split(), "python"),
}.items():
    _tokenized(_name, _tokenizer)


# building


@query
def token_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_table(documents(spark, sf_dir), "text", "doc_id", tok.whitespace).select("doc_id", F.size("tokens").alias("doc_len"), F.col("tokens").alias("words"))
    return triples(rows).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "term")


@query
def build_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SearchIndex.build(documents(spark, sf_dir)).postings.select("term", "doc_id", F.col("tf").cast("bigint").alias("tf"), F.array_join("posns", " ").alias("places"))


@query
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SearchIndex.build(documents(spark, sf_dir)).doc_lengths().select("doc_id", F.col("doc_len").cast("bigint").alias("doc_len"))


@query
def index_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = SearchIndex.build(documents(spark, sf_dir), truncate=True)
    return cut.term_stats().select("term", "df", "cf")


@query
def index_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "documents")
    both = SearchIndex.build(every.where("lang = 'en'")).union(SearchIndex.build(every.where("NOT lang <=> 'en'")))
    return both.term_stats().crossJoin(both.stats).select("term", "df", "cf", "n_docs", F.round("avg_doc_len", 6).alias("avg_doc_len"))


@query
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in French are replaced by their titles."""
    body = index(spark, sf_dir)
    new = index(spark, sf_dir, "title").filter(table(spark, sf_dir, "documents").where("lang = 'fr'"))
    both = body.upsert(new)
    return both.term_stats().crossJoin(both.stats).select("term", "df", "cf", "n_docs", F.round("avg_doc_len", 6).alias("avg_doc_len"))


@query
def index_from_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = index(spark, sf_dir).postings.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("counts"))
    return _rounded(SearchIndex.from_counts(documents(spark, sf_dir).select("doc_id").join(tf, "doc_id", "left")).score(TERM))


@query
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/roundtrip-{uuid.uuid4().hex}"
    SearchIndex.build(documents(spark, sf_dir)).save(path)
    return SearchIndex.load(spark, path).postings.select("term", "doc_id", F.col("tf").cast("bigint").alias("tf"))


# statistics


@query
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).term_stats()


@query
def docfreq(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = index(spark, sf_dir)
    return body.docfreq(TERM).union(body.docfreq(OTHER)).union(body.docfreq("no-such-word"))


@query
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).stats.select("n_docs", F.round("avg_doc_len", 6).alias("avg_doc_len"))


@query
def memory_report_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).top_terms(10)


@query
def memory_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).memory_usage()


# matching


@query
def termfreqs_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).termfreqs(TERM).select("doc_id", F.col("tf").cast("bigint").alias("tf"))


def _phrase(name: str, words: list[str], **more: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return index(spark, sf_dir).termfreqs(words, **more).select("doc_id", F.col("tf").cast("bigint").alias("tf"))

    QUERIES[name] = run


for _name, _words in PHRASES.items():
    _phrase(_name, _words)
_phrase("termfreqs_posn_range", [TERM], min_posn=18, max_posn=89)
_phrase("phrase_posn_range", PHRASES["phrase_2"], min_posn=0, max_posn=89)
_phrase("phrase_slop_freqs", ["of", "the", "to"], slop=3)


@query
def phrase_slop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).matches(["of", "the", "to"], slop=3).select("doc_id")


@query
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).positions(TERM).select("doc_id", F.explode("posns").alias("pos")).select("doc_id", F.col("pos").cast("bigint").alias("pos"))


@query
def and_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).all_of([TERM, OTHER, "to"])


@query
def or_query_mm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).at_least([TERM, OTHER, "to", "que", "der"], 2)


# scoring


def steep(tf: Column, dfs: list[Column], dl: Column, avgdl: Column, n: Column) -> Column:
    """A similarity of one's own: the root of the frequency over the logarithm of the length."""
    return F.sqrt(tf.cast("double")) / F.log(dl + 2.0)


def _scored(name: str, words: str | list[str], similarity: sim.Similarity = sim.default_bm25, **more: int) -> None:
    QUERIES[name] = lambda spark, sf_dir: _rounded(index(spark, sf_dir).score(words, similarity, **more))


_scored("score_bm25_term", TERM)
_scored("score_bm25_phrase", PHRASES["phrase_3"])
_scored("score_bm25_repeated", PHRASES["phrase_same_term"])
_scored("score_bm25_impact", TERM, sim.bm25_impact())
_scored("score_bm25_legacy", TERM, sim.bm25_legacy())
_scored("score_bm25_tuned", TERM, sim.bm25(10, 0.01))
_scored("score_classic", TERM, sim.classic())
_scored("score_custom_sim", TERM, steep)
_scored("score_posn_range", TERM, min_posn=18)


# several fields


def _fields(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, SearchIndex]:
    return {n: index(spark, sf_dir, n) for n in names}


EDISMAX: dict[str, dict] = {
    "edismax_term_centric": dict(qf=["title", "body"]),
    "edismax_tie": dict(qf=["title", "body"], tie=0.3),
    "edismax_mm": dict(qf=["title", "body"], mm="2<-25%", q="of the to and"),
    "edismax_boost": dict(qf=["title^2", "body^0.5"], tie=0.1),
    "edismax_and": dict(qf=["title", "body"], q_op="AND"),
    "edismax_field_centric": dict(qf=["exact_title^3", "body"], tie=0.2, mm=2),
    "edismax_pf": dict(qf=["title", "body"], pf=["title^2", "body"], mm=2),
    "edismax_pf2": dict(qf=["title", "body"], pf2=["body^3"], q="of the to"),
    "edismax_pf3": dict(qf=["title", "body"], pf3=["body"], q="The and attion to"),
    "edismax_full": dict(qf=["title^2", "body"], pf=["body"], pf2=["title", "body^0.5"], pf3=["body^2"], tie=0.3, mm="60%", q="The and attion to"),
}


def _edismax(name: str, parameters: dict) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = {"q": "of the", **parameters}
        names = [x.partition("^")[0] for x in p["qf"]]
        return _rounded(edismax(_fields(spark, sf_dir, *names), **p)[0])

    QUERIES[name] = run


for _name, _parameters in EDISMAX.items():
    _edismax(_name, _parameters)


@query
def edismax_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each multi-field query is read: by the fields' tokenizers alone, so that no index is built."""
    at = {f: tokenizer_of(f) for f in ("body", "title", "exact_title")}

    def read(parameters: dict) -> str:
        p = {"q": "of the", **parameters}
        p.pop("tie", None)  # weighs scores
        return read_query(at, **p).explain

    return spark.createDataFrame([(name, read(p)) for name, p in EDISMAX.items()], "name string, explained string")


MM_SPECS = ("2", "-1", "75%", "-25%", "2<-25%", "3<90%", "2<-1 5<80%")


@query
def mm_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of 1 to 12 terms each specification demands."""
    return spark.createDataFrame([(spec, n, minimum_should_match(n, spec)) for spec in MM_SPECS for n in range(1, 13)], "spec string, clauses bigint, least bigint")


# sources


def _one_line(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\t\n\r]", " ")


@query
def read_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as tab-separated text and back."""
    path = f"{folder(spark)}/tsv-{uuid.uuid4().hex}"
    documents(spark, sf_dir).select(F.concat_ws("\t", F.col("doc_id").cast("string"), _one_line(F.col("text")))).write.text(path)
    rows = readers.tsv(spark, path, ["doc_id", "text"])
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


@query
def read_json_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as JSON objects of id to record, one for each partition, and back."""

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = "{"
        for f in frames:
            for key, value in zip(f["key"], f["value"]):
                yield pd.DataFrame({"line": [f"{mark}{json.dumps(key)}: {value}"]})
                mark = ","
        yield pd.DataFrame({"line": ["{}" if mark == "{" else "}"]})

    path = f"{folder(spark)}/json-{uuid.uuid4().hex}"
    record = F.to_json(F.struct(F.lit("t").alias("title"), F.col("text").alias("body")))
    documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("key"), record.alias("value")).mapInPandas(lines, "line string").write.text(path)
    rows = readers.json_map(spark, path, ["title", "body", "none"])
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "title", "body", "none")


@query
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a stream into an index, its batches compacted, and a term's frequencies in it."""
    at, path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet"), f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    reader = spark.readStream.schema("doc_id bigint, text string")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        reader, at = reader.option("pathGlobFilter", at.getName()), at.getParent()
    append.append_stream(reader.parquet(at.toString()), f"{path}/batches", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    whole = append.compact(spark, f"{path}/batches", f"{path}/whole")
    return whole.termfreqs(TERM).select("doc_id", F.col("tf").cast("bigint").alias("tf"))


# results


@query
def topk_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(index(spark, sf_dir).top(TERM, 10))


@query
def topk_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    body, found = index(spark, sf_dir), Results(5, table(spark, sf_dir, "documents"), ["lang", "source"])
    for word in (TERM, OTHER, "que"):
        found.search(body, word, word)
    return found.all().select("query", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", 6).alias("score"), "lang", "source")


# documents as rows


@query
def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_ops.document(index(spark, sf_dir), 7).select("term", F.col("tf").cast("bigint").alias("tf"), F.array_join("posns", " ").alias("places"))


@query
def slice_then_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return _rounded(index(spark, sf_dir).filter(chosen).score(TERM))


@query
def take_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame(list(enumerate([5, 3, 3, -1, 8])), "ord bigint, doc_id bigint")
    rows = docs_ops.take(index(spark, sf_dir), wanted)
    return rows.select("ord", "doc_id", F.array_join("terms", " ").alias("terms"), F.col("doc_len").cast("bigint").alias("doc_len"))


@query
def row_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document is no more than its title."""
    return docs_ops.equal(index(spark, sf_dir), index(spark, sf_dir, "title"))


@query
def isna_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the texts in Spanish taken away."""
    blank = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "es", F.col("text")).alias("text"))
    return docs_ops.is_missing(SearchIndex.build(blank))


@query
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_ops.value_counts(index(spark, sf_dir))
    return rows.select(F.array_join("terms", " ").alias("terms"), F.col("doc_len").cast("bigint").alias("doc_len"), "n")


@query
def unique_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_ops.unique(index(spark, sf_dir)).select(F.array_join("terms", " ").alias("terms"), F.col("doc_len").cast("bigint").alias("doc_len"))


@query
def factorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_ops.factorize(index(spark, sf_dir))


@query
def sort_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_ops.sort_documents(index(spark, sf_dir))


@query
def dense_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_ops.term_frequencies(index(spark, sf_dir), [TERM, OTHER])
    return rows.select("doc_id", F.col("tf_0").cast("bigint").alias("tf_0"), F.col("tf_1").cast("bigint").alias("tf_1"))


# sets of keys


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = index(spark, sf_dir).postings
    flat = lambda t: rows.where(F.col("term") == t).select("doc_id", F.explode("posns").alias("pos"))
    return flat(OTHER), flat(TERM)


@query
def keys_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.intersect(*_two(spark, sf_dir), "doc_id")


@query
def keys_rows_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.rows_in(*_two(spark, sf_dir), "doc_id").select("doc_id", F.col("pos").cast("bigint").alias("pos"))


@query
def keys_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.adjacent(*_two(spark, sf_dir), "doc_id", "pos").select("doc_id", F.col("pos").cast("bigint").alias("pos"))


@query
def keys_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return sets.merge(a.select("doc_id"), b.select("doc_id"), distinct=True)


@query
def keys_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (x.groupBy("doc_id").count() for x in _two(spark, sf_dir))
    return sets.merge_counts(a, b, "doc_id", "count").withColumnRenamed("count", "n")


@query
def keys_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", sets.bits_set(F.col("doc_id")).cast("bigint").alias("bits"))


@query
def part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another corpus: the words of parts' names."""
    return index(spark, sf_dir, "part").term_stats()


__all__ = ["EDISMAX", "PHRASES", "QUERIES"]
