"""Index a stream of documents: each micro-batch adds its postings, and the latest text of a doc_id counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from postlane.functions.tokenizers import Tokenizer, whitespace
from postlane.operators.index import SearchIndex, postings_of, stats_of

_POSTINGS = "term string, doc_id bigint, tf int, posns array<int>, doc_len int"
_DOCS = "doc_id bigint, doc_len int, words array<string>"


def append_stream(docs: DataFrame, path: str, checkpoint: str, text: str = "text", doc_id: str = "doc_id", tokenizer: Tokenizer = whitespace) -> DataStreamWriter:
    """A writer that indexes each batch into path/<table>/batch=<n>. A batch that is run again overwrites what it wrote, so each counts once. Within a batch a doc_id must occur once."""

    def write(batch: DataFrame, number: int) -> None:
        SearchIndex.build(batch, text, doc_id, tokenizer).rows.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        rows = batch.sparkSession.read.schema(_DOCS).parquet(f"{path}/docs/batch={number}")
        postings_of(rows).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def load(spark: SparkSession, path: str, tokenizer: Tokenizer = whitespace) -> SearchIndex:
    """The index over all batches so far: of a doc_id that several batches have, the last one's. Statistics are counted as it is read."""
    read = lambda name, schema: spark.read.schema(f"{schema}, batch int").parquet(f"{path}/{name}")
    last = read("docs", _DOCS).groupBy("doc_id").agg(F.max("batch").alias("batch"))
    rows, postings = (read(n, s).join(last, ["doc_id", "batch"], "left_semi").drop("batch") for n, s in (("docs", _DOCS), ("postings", _POSTINGS)))
    docs = rows.select("doc_id", "doc_len")
    return SearchIndex(postings.select("term", "doc_id", "tf", "posns", "doc_len"), docs, stats_of(docs), tokenizer, rows.select("doc_id", "doc_len", "words"))


def compact(spark: SparkSession, path: str, out: str, tokenizer: Tokenizer = whitespace) -> SearchIndex:
    """Write the batches so far as one saved index in `out`, sorted by term, that SearchIndex.load() reads."""
    load(spark, path, tokenizer).save(out)
    return SearchIndex.load(spark, out, tokenizer)
