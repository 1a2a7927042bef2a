"""From raw documents to packed bins: five stages, each over all that the one before kept.

language ID -> SimHash near-dedup -> secret scan -> source mixing -> best-fit packing
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from postlane.llm import language, mixing, near_duplicates, packing, secrets
from postlane.llm.common import drop_table, settle

#: Rows that an executor hands to Python at once. Texts are held several times on the way, by Spark outside its heap and by
#: Python, for each core: at Spark's 10,000 rows that alone is hundreds of MB.
BATCH, _ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go; the model learns from the labels in docs.lang."""
    return language.keep_identified(docs.select(*COLUMNS), language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least doc_id."""
    return near_duplicates.keep_first(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask, and n_chars is counted again where that changed the text."""
    return secrets.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources are repeated until the sources' shares are the target ones; none goes."""
    return mixing.repeat(docs.select(*COLUMNS), mixing.mix(docs))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each piece of each document. A copy's turn tells it from the others of its doc_id."""
    return packing.pack(packing.word_counts(docs))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage, with the session set to BATCH rows at a time for Python; it stays set, as the stage's plan runs later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_ROWS)) <= BATCH:
            spark.conf.set(_ROWS, str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("language_id", in_small_batches(identify_language)),
    ("near_dedup", in_small_batches(drop_near_duplicates)),
    ("secret_scan", in_small_batches(redact_secrets)),
    ("source_mixing", in_small_batches(mix_sources)),
    ("packing", in_small_batches(pack_documents)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again by the next, after which it goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the first two stages, or the draws of the mixing; tests/llm holds each stage against brute force.
ORACLE_SQL = None
