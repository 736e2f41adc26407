"""A training corpus from the documents table: reject low quality, drop repeated lines, near duplicates and benchmark leaks, mix sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table, written
from quillspark.llm.decontaminate import decontaminate
from quillspark.llm.line_dedup import dedup_lines
from quillspark.llm.mixing import fitted, mix
from quillspark.llm.quality import classify
from quillspark.llm.simhash import cluster

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; n_chars is of the new text."""
    return dedup_lines(docs.select(*COLUMNS)).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component; documents without an id stay."""
    first = cluster(docs).where("doc_id = component_id").select("doc_id").distinct().withColumn("first", F.lit(True))
    return docs.select(*COLUMNS).join(first, "doc_id", "left").where("first or doc_id is null").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, weighed by what labels say of quality."""
    return mix(docs, weigh=fitted(docs, table(spark, sf_dir, "labels")))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("mixing to target weights", mixture)]

#: The classifier, fingerprints and sampling keys have no SQL form; tests compare with plain definitions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
