"""The tables that the queries run on, and their indexes, each built once for a session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlane.functions.tokenizers import NAMED, Tokenizer, keyword, whitespace
from postlane.operators.index import SearchIndex
from postlane.operators.shared import folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title): the first eight words of each text."""
    return documents(spark, sf_dir).select("doc_id", F.array_join(F.slice(whitespace.column(F.col("text")), 1, 8), " ").alias("title"))


def tokenizer_of(field: str) -> Tokenizer:
    return keyword if field == "exact_title" else whitespace


def _built(spark: SparkSession, sf_dir: str, field: str) -> SearchIndex:
    if field == "body":
        return SearchIndex.build(documents(spark, sf_dir))
    if field == "title":
        return SearchIndex.build(titled(spark, sf_dir), text="title")
    if field == "exact_title":
        return SearchIndex.build(titled(spark, sf_dir), text="title", tokenizer=tokenizer_of(field))
    if field == "part":
        return SearchIndex.build(table(spark, sf_dir, "part"), text="p_name", doc_id="p_partkey")
    raise KeyError(field)


def index(spark: SparkSession, sf_dir: str, field: str = "body") -> SearchIndex:
    """The saved index of a field, built the first time that this session asks for it."""
    known = spark.__dict__.setdefault("_postlane_known", {})
    if (sf_dir, field) not in known:
        path = f"{folder(spark)}/index-{field}-{uuid.uuid4().hex}"
        _built(spark, sf_dir, field).save(path)
        known[sf_dir, field] = SearchIndex.load(spark, path, NAMED["keyword"] if field == "exact_title" else None)
    return known[sf_dir, field]
