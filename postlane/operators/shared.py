"""Tables in the folder that all executors share: what cuts lineage, and indexes built for a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one on a local master; on a cluster an error, as its machines share no local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_postlane_folder", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        path = spark._postlane_folder = "file://" + tempfile.mkdtemp(prefix="postlane-")
    return path.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it from there."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
