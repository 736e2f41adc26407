"""The tables of a folder, and views that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import windows_of_words


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(spark: SparkSession, folder: str, size: int = 120, overlap: int = 20) -> DataFrame:
    """(doc_id, source, chunk, text): documents in overlapping runs of words."""
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", "source", F.posexplode(windows_of_words(F.col("text"), size, overlap)).alias("chunk", "text"))
