"""What the corpus operators share: the folder all executors see, written intermediate tables, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators import network
from ..sources.files import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, see scratch()."""
    return f"{scratch(spark)}-{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and no lost executor loses rows."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(docs: DataFrame, own: list[str], *columns: Column) -> DataFrame:
    """The columns, and docs' columns `own` in a struct named own: so no name of theirs meets one of an operator's."""
    return docs.select(*columns, F.struct(*([F.col(f"`{c}`") for c in own] or [F.lit(True)])).alias("own"))


def with_own(df: DataFrame, schema: str) -> StructType:
    """The schema of df's column own and those of the given one."""
    return StructType([df.schema["own"], *_parse_datatype_string(schema).fields])


def unpacked(df: DataFrame, own: list[str], *columns: str) -> DataFrame:
    """The columns of own, and the others named."""
    return df.select(*[F.col("own").getField(c).alias(c) for c in own], *columns)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, batches) of runs of the first column, which is sorted."""
    key, held = None, []
    for batch in batches:
        col = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(col[1:] != col[:-1]) + 1).tolist(), len(col)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                if held and col[a] != key:
                    yield key, held
                    held = []
                key = int(col[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield key, held


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a long, b long): one row per node on an edge between two different nodes; root is the smallest node that can be reached."""
    found = network.components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return found.select("node", F.col("component").alias("root"))
