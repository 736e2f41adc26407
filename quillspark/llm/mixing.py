"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source's weight gives it a share of the budget; shares stop at `most` times the source's size, and what is over
goes to the others by weight. Caps sorted by cap/weight make the capped sources a prefix, so one running sum finds the
common level. A source takes all its documents once for each complete epoch its target holds; the rest of the target is
drawn by weighted sampling without replacement: every document has the key -ln(u) / quality, with u from a hash of its
id, and documents are taken in key order until their sizes fill the rest. The last one is cut at the budget.

No source is sorted as a whole: keys fall in fine buckets of ln(key), sizes are summed by bucket first, and only the
one bucket of each source in which the budget ends is put in order; other rows are dealt evenly.

Defined results: null texts have size 0 and take 0; sources of size 0 have target 0; a null source is a source of its own,
last; rows that agree in doc_id and text share a key, and their order among themselves does not matter; an empty
table gives an empty result. Runs on the same rows agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written
from .labelled import sample
from .quality import MOD, REST

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST = 2.0
SPACES = r"[\x20\x09-\x0D]+"
STEPS = 1000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Weight in (0, 1]: falls with the number of symbols a word. For sources without labels; see fitted()."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[!#$%&*+/<=>@\\^_`{|}~]")), F.lit(0))
    return F.greatest(F.lit(0.05), (size + 1) / (size + 1 + symbols))


#: Characters that are counted in a text, a word, and how finely the logarithm of each count is cut.
COUNTED = {"symbols": ("#$%&*+/<=>@\\^_`{|}~", 4.0), "marks": ("!?", 8.0), "digits": ("0123456789", 4.0), "capitals": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4.0), "stops": (".,;:", 8.0)}
BINS, LEAST_WEIGHT = 10, 0.05


def binned(text: Column, size: Column) -> dict[str, Column]:
    """The bin, from 0, of each count a word of the text. Characters are counted by what a text loses without them, which is cheaper than a pattern."""
    words = F.greatest(size, F.lit(1))
    rate = lambda chars: F.coalesce(F.length(text) - F.length(F.translate(text, chars, "")), F.lit(0)) / words
    return {name: F.least(F.floor(F.log2(1 + rate(chars) * scale) * 2), F.lit(BINS - 1)).cast("int") for name, (chars, scale) in COUNTED.items()}


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Callable[[Column, Column], Column]:
    """A weight in (0, 1] of (text, size): the chance that a text is good by the log odds of its counts' bins among a bounded sample of texts labelled for
    quality, as the classifier's. The bins of all counts are len(COUNTED) * BINS rows, which go into the expression. Without both labels all texts weigh 1."""
    rows = sample(docs, labels, "quality", MOD, REST, per_class)
    at = F.array(*[F.struct(F.lit(name).alias("name"), bin.alias("bin")) for name, bin in binned(F.col("text"), n_words(F.col("text"))).items()])
    got = rows.select("y", F.explode(at).alias("x")).groupBy("x.name", "x.bin").agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect()
    good, every = (sum(r[c] for r in got) / len(COUNTED) for c in ("good", "n"))
    if not 0 < good < every:
        return lambda text, size: F.lit(1.0)
    odds = {(r["name"], r["bin"]): math.log((r["good"] + 1) / (good + BINS)) - math.log((r["n"] - r["good"] + 1) / (every - good + BINS)) for r in got}

    def weight(text: Column, size: Column) -> Column:
        total = F.lit(0.0)
        for name, bin in binned(text, size).items():
            total = total + F.element_at(F.array(*[F.lit(odds.get((name, b), 0.0)) for b in range(BINS)]), bin + 1)
        return F.greatest(F.lit(LEAST_WEIGHT), 1 / (1 + F.exp(-total)))

    return weight


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with target. One row a source; the windows run over that small table only."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(every) * F.lit(budget))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    free = F.col("cap") > F.col("level") * F.col("weight")
    s = s.withColumn("common", F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every))
    target = F.coalesce(F.least("cap", F.col("common.level") * F.col("weight")), F.col("cap"))
    return s.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = 7, weigh: Callable[[Column, Column], Column] = quality) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs; weigh gives a document's weight from its text and size."""
    size = n_words(F.col("text"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = docs.select("doc_id", "source", "text", size.alias("size")).withColumn("key", -F.log(u) / weigh(F.col("text"), F.col("size")))
    rows = written(rows.select("doc_id", "source", "size", "key", F.floor(F.log("key") * STEPS).alias("bucket")), "keys")

    sums = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))

    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sums.withColumn("upto", F.sum("words").over(up_to)).select(F.col("source").alias("edge_source"), "bucket", "words", "upto")
    edge = running.join(goal, F.col("source").eqNullSafe(F.col("edge_source"))).where(F.col("upto") >= F.col("rest")).groupBy("edge_source")
    edge = edge.agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
    edge = edge.select("edge_source", F.col("edge.bucket").alias("edge_bucket"), "edge.before")
    plan = goal.join(edge, F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source")
    plan = written(plan.withColumnRenamed("source", "plan_source"), "plan")

    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    at_edge = F.coalesce(F.col("bucket") == F.col("edge_bucket"), F.lit(False))
    dealt = dealt.withColumn("at_edge", at_edge).withColumn("deal", F.when(at_edge, F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", "key"), F.lit(4096))))
    earlier = Window.partitionBy("source", "at_edge", "deal").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(earlier), F.lit(0))
    drawn = F.when(F.col("at_edge"), F.greatest(F.lit(0), F.least(room, F.col("size")))).otherwise(
        F.when(F.col("bucket") < F.col("edge_bucket"), F.col("size")).otherwise(0)
    )
    return dealt.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + drawn).cast("long").alias("taken"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, weigh=fitted(docs, table(spark, sf_dir, "labels"))).select("doc_id", "size", "source_size", "target", "taken")
