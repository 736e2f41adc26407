"""Citation and co-occurrence graphs as edge tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.named import named
from ..sources.files import removed, scratch
from ..sources.tables import table
from .network import kept, kept_at


@named("graph_most_cited", "select l_partkey, count(distinct l_orderkey) as cited from lineitem group by 1 order by cited desc, l_partkey limit 20")
def graph_most_cited(spark, folder):
    """A top-20 report."""
    return table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("cited")).orderBy(F.desc("cited"), "l_partkey").limit(20)


@named("graph_shared_orders", "with s as (select distinct l_orderkey, l_suppkey from lineitem) select a.l_suppkey as a, b.l_suppkey as b, count(*) as n from s a join s b on a.l_orderkey = b.l_orderkey and a.l_suppkey < b.l_suppkey group by all")
def graph_shared_orders(spark, folder):
    """Supplier pairs by shared orders. An order holds at most seven lines, so a key's pairs are few."""
    return shared(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("x")))


def shared(rows: DataFrame, lines: int = 250_000) -> DataFrame:
    """(a, b, n): pairs a < b of x in rows (key, x) by how many keys have both. Keys and pairs are dealt to as many parts as have about so many lines each, so a task's
    memory doesn't grow with the table."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // lines))
    s = rows.repartition(parts, "key").distinct()
    a, b = s.withColumnRenamed("x", "a"), s.withColumnRenamed("x", "b")
    return a.join(b.hint("merge"), "key").where("a < b").repartition(parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


@named("graph_degrees", "with e as (select distinct l_suppkey as s, l_partkey as p from lineitem) select s, count(*) as out_degree from e group by s")
def graph_degrees(spark, folder):
    return table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("s"), "l_partkey").distinct().groupBy("s").agg(F.count("*").alias("out_degree"))


@named("graph_rank", """with recursive l as (select distinct 's' || l_suppkey as u, 'p' || l_partkey as v from lineitem), b as (select u as src, v as dst from l union all select v, u from l),
    e as (select src, dst, 1.0::double / count(*) over (partition by src) as w from b), n as (select count(distinct src) as n from e),
    r(i, id, v) as (select distinct 0, src, 1.0::double / n from e, n union all select any_value(i) + 1, e.dst, 0.15 / any_value(n) + 0.85 * sum(r.v * e.w) from r join e on e.src = r.id, n where i < 50 group by e.dst)
    select id, round(v, 10) as rank from r where i = 50""")
def graph_rank(spark, folder, rounds: int = 50, damping: float = 0.85):
    """PageRank of all suppliers ("s" and number) and parts ("p" and number); a line links its supplier and part both ways."""
    link = table(spark, folder, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")).distinct()
    both = link.union(link.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return page_rank(both, rounds, damping).select("id", F.round("v", 10).alias("rank"))


def page_rank(link: DataFrame, rounds: int = 50, damping: float = 0.85, tolerance: float = 1e-12, deal: int = 100_000, every: int = 5, bucket: int = 65_536) -> DataFrame:
    """(id, v): ranks over (src, dst) without redistribution of dangling weight; links of a node to itself don't count.

    Nodes are dealt to buckets of about `bucket` and numbered there, so the ranks of a bucket are a vector. Links become blocks between two buckets, of about `deal`
    links at most, and are dealt to tasks by their source's bucket once: a round shuffles vectors, summed by target in each task first, and no links or names. Each
    round is written, so plans stay short. Stops after so many rounds, or when of the last `every` no rank moved by more than the tolerance times itself."""
    spark = link.sparkSession
    link = kept(link.where("src <> dst").distinct())
    out = link.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    names = kept(link.select(F.col("src").alias("id")).union(link.select("dst")).distinct().join(out, "id", "left").fillna(0, ["n"]))
    n = names.count()
    names = names.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // bucket)))).cast("int"))
    nodes = kept(names.withColumn("i", F.row_number().over(Window.partitionBy("b").orderBy("id")) - 1))
    end = lambda side: nodes.select(F.col("id").alias(side), F.col("b").alias(f"{side}_b"), F.col("i").alias(f"{side}_i"))
    ends = kept(link.join(end("src"), "src").join(end("dst"), "dst").drop("src", "dst"))
    deals = ends.groupBy("src_b", "dst_b").agg(F.ceil(F.count("*") / deal).alias("deals"))
    dealt = ends.join(deals, ["src_b", "dst_b"]).withColumn("deal", F.pmod(F.xxhash64("src_i", "dst_i"), F.col("deals")))
    blocks = dealt.groupBy("src_b", "dst_b", "deal").applyInArrow(_block, "src_b int, dst_b int, src_i binary, dst_i binary")
    parts, name, at = int(spark.conf.get("spark.sql.shuffle.partitions")), f"links_{uuid.uuid4().hex}", scratch(spark)
    blocks.repartition(parts, "src_b").write.option("path", at).bucketBy(parts, "src_b").saveAsTable(name)
    edges = spark.table(name)
    rank, at = kept_at(nodes.groupBy("b").applyInArrow(_first(1.0 / max(1, n)), _RANKS))
    follow = _follow((1 - damping) / max(1, n), damping)
    for turn in range(rounds):
        given = rank.select(F.col("b").alias("src_b"), "given")
        got = edges.join(given, "src_b").select("dst_b", "src_i", "dst_i", "given").mapInArrow(_handed, "b int, got binary")
        new, new_at = kept_at(rank.groupBy("b").cogroup(got.groupBy("b")).applyInArrow(follow, _RANKS))
        still = turn % every == every - 1 and (new.agg(F.max("moved")).first()[0] or 0.0) <= tolerance
        removed(spark, at)
        rank, at = new, new_at
        if still:
            break
    spark.sql(f"drop table {name}")
    return rank.select("b", "v").mapInArrow(_each, "b int, i int, v double").join(nodes, ["b", "i"]).select("id", "v")


#: A bucket's ranks, one over each node's links, their product, and by how much of itself a rank moved at most.
_RANKS = "b int, v binary, share binary, given binary, moved double"


def _row(b: int, v: np.ndarray, share: np.ndarray, moved: float) -> pa.Table:
    return pa.table({"b": pa.array([b], pa.int32()), "v": [v.tobytes()], "share": [share.tobytes()], "given": [(v * share).tobytes()], "moved": [moved]})


def _block(links: pa.Table) -> pa.Table:
    """The links of a block as two vectors."""
    end = lambda c: [np.asarray(links.column(c)).astype(np.int32).tobytes()]
    return pa.table({"src_b": links.column("src_b")[:1], "dst_b": links.column("dst_b")[:1], "src_i": end("src_i"), "dst_i": end("dst_i")})


def _first(value: float) -> Callable[[pa.Table], pa.Table]:
    def ranks(nodes: pa.Table) -> pa.Table:
        links = np.zeros(len(nodes))
        links[np.asarray(nodes.column("i"))] = np.asarray(nodes.column("n"))
        return _row(nodes.column("b")[0].as_py(), np.full(len(nodes), value), np.divide(1.0, links, out=np.zeros(len(nodes)), where=links > 0), 1.0)

    return ranks


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two vectors, the shorter filled up with zeros; the longer is overwritten."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    a[: len(b)] += b
    return a


def _handed(batches: Iterator[pa.RecordBatch], most: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """What blocks hand on to each target's bucket, summed until the sums hold `most` bytes."""
    sums: dict[int, np.ndarray] = {}
    out = lambda: pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["b", "got"])
    for batch in batches:
        target, src, dst, given = batch.columns
        for r in range(len(batch)):
            i, j, v = (np.frombuffer(c[r].as_buffer(), t) for c, t in ((src, np.int32), (dst, np.int32), (given, np.float64)))
            b, got = target[r].as_py(), np.bincount(j, v[i])
            sums[b] = _added(sums[b], got) if b in sums else got
        if sum(v.nbytes for v in sums.values()) > most:
            yield out()
            sums.clear()
    if sums:
        yield out()


def _follow(base: float, damping: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def ranks(old: pa.Table, got: pa.Table) -> pa.Table:
        before, share = (np.frombuffer(old.column(c)[0].as_buffer(), np.float64) for c in ("v", "share"))
        total = np.zeros(len(before))
        for one in got.column("got"):
            total = _added(total, np.frombuffer(one.as_buffer(), np.float64))
        v = base + damping * total
        return _row(old.column("b")[0].as_py(), v, share, float((np.abs(v - before) / v).max()))

    return ranks


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(len(batch)):
            v = np.frombuffer(batch.column(1)[r].as_buffer(), np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), batch.column(0)[r].as_py(), np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["b", "i", "v"])


@named("graph_two_hops", """with e as (select l_suppkey as a, l_partkey as b from lineitem group by all having avg(l_discount) > 0.06), f as (select a as s, b as t from e union select b + 1000000000, a from e where false)
    select x.a as start, count(distinct y.a) as reached from e x join e y on x.b = y.b and x.a <> y.a group by x.a""")
def graph_two_hops(spark, folder):
    """Suppliers reached from each supplier over shared parts, edges of weight over 0.06 only."""
    e = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.avg("l_discount").alias("w")).where("w > 0.06")
    x, y = e.select(F.col("l_suppkey").alias("start"), "l_partkey"), e.select(F.col("l_suppkey").alias("other"), "l_partkey")
    return x.join(y, "l_partkey").where("start <> other").groupBy("start").agg(F.countDistinct("other").alias("reached"))
