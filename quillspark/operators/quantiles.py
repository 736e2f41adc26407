"""Exact order statistics of groups of any size: counts by intervals, and again within the interval that holds the place asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .network import kept

PARTS = 1024


def at_places(rows: DataFrame, key: str, value: str, places: DataFrame, few: int = 10_000) -> DataFrame:
    """(key, place, value): the value at each of places (key, place), from 0, among a key's non-null values in order.

    An interval of values is cut in PARTS, its values counted by part, and the part that holds the place is next; so a round moves counts only,
    however many rows a key has. At most `few` distinct values of an interval are ranked."""
    rows = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).cast("double").alias("v"))
    ends = rows.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    asked = places.select(F.col(key).alias("key"), "place").distinct()
    todo = kept(asked.join(ends, "key").where((F.col("place") >= 0) & (F.col("place") < F.col("n"))).select("key", "place", "lo", "hi", F.col("place").alias("rest")))
    found = []
    while True:
        found.append(todo.where("lo = hi").select("key", "place", F.col("lo").alias("v")))
        todo = todo.where("lo < hi")
        inside = rows.join(todo, "key").where("v between lo and hi")
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1))
        parts = kept(inside.groupBy("key", "place", "rest", part.alias("part")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")))
        if parts.isEmpty():
            break
        before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most PARTS rows
        held = parts.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
        held = kept(held.select("key", "place", "lo", "hi", (F.col("rest") - F.col("before")).alias("rest"), "n"))
        small = held.where((F.col("n") <= few) & (F.col("lo") < F.col("hi")))
        ranks = rows.join(small, "key").where("v between lo and hi").groupBy("key", "place", "rest", "v").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("key", "place").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        found.append(kept(ranks.withColumn("upto", upto).where(F.col("upto") > F.col("rest")).groupBy("key", "place").agg(F.min("v").alias("v"))))
        todo = held.where((F.col("n") > few) | (F.col("lo") == F.col("hi"))).drop("n")
    return reduce(DataFrame.unionByName, found).select(F.col("key").alias(key), "place", F.col("v").alias(value))


def quantiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], few: int = 10_000) -> DataFrame:
    """(key, a column a share): quantiles between the two values that enclose them, by distance."""
    n = kept(rows.where(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")))
    at = {name: (F.col("n") - 1) * F.lit(share) for name, share in shares.items()}
    want = reduce(DataFrame.union, [n.select(key, f(x).cast("long").alias("place")) for x in at.values() for f in (F.floor, F.ceil)])
    found = kept(at_places(rows, key, value, want, few))
    every = n
    for name, x in at.items():
        side = lambda f: F.max(F.when(F.col("place") == f(x).cast("long"), F.col(value)))  # noqa: B023, E731
        low, high = side(F.floor), side(F.ceil)
        one = n.join(found, key).groupBy(key).agg((low + (high - low) * (F.first(x) - F.floor(F.first(x)))).alias(name))
        every = every.join(one, key)
    return every.drop("n")
