"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.coalesce(remainder(doc_id, mod) == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, per_class: int) -> DataFrame:
    """(text, y): documents whose label may be learnt from, at most `per_class` of either label, the first by a hash of their id.

    Ids labelled both ways, null labels and held-out ids are left out; of an id with several rows one is taken, the first by a hash of its
    text. The ids are at most 2 * per_class rows, so sending them to all tasks is safe at any size of the tables.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), mod, rest))
    known = known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("most")).where("y = most")
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = reduce(DataFrame.unionAll, first).select(F.col("doc_id").alias("known_id"), F.col("y").cast("int").alias("y"))
    docs = docs.select("doc_id", "text")
    found = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("known_id")).select("known_id", F.struct("text").alias("row"), "y")
    return found.groupBy("known_id", "y").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.text", "y")
