"""Prefix trie of conversations by the Euler-tour technique.

A node of depth d is a distinct sequence of the first d turns (role and text) of some conversation; the root has none. Turns become
SHA-256 digests at the scan, so no text is shuffled. A prefix is known by sums over its turns of hashes of place and digest, 128 bits
in all, which windows add up; its node is one group of rows. Siblings are linked within salted groups and then from group to group, so a parent
with very many children is never one task's.

The tour has an arc into and an arc out of each node. It is ranked as a linked list: in every round the arcs whose hash is above both
neighbours' are taken out, about a third of them, and their neighbours joined; when at most `REST` arcs are left one task
walks them, and the rounds are undone in reverse, each arc placed behind the one before it. Rounds grow with the logarithm of
the nodes, what they move with the nodes. Over arcs in tour order, running sums, block by block, give any subtree's total: the sum at
its arc out less that at its arc in. No loop follows depths, so a chain as deep as the table costs no more.

Defined results: rows without a conv_id are left out; null roles and texts are empty; turns come first if null, and ties of a turn go by
the digest of role and text (equal rows are separate turns); an empty table gives an empty trie, without a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, table, written

BLOCK = 4096
REST = 1 << 14
SALTS = 64
IDS_A_ROW = 4096
FORK, HEADS = 5, 9


def digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, size): the role's length keeps role and text apart in the digest; size is the text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))


def in_order(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns, sorted over the whole table and cut in parts, with `part` and `at`; and (conv_id, part, first, before): a part's first `at` of
    a conversation, and how many of its turns earlier parts hold. So a conversation longer than a task is no task's whole."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    cut = turns.repartitionByRange(shuffle_parts(turns.sparkSession), *order).sortWithinPartitions(*order)
    cut = written(cut.select("conv_id", "digest", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "sorted")
    pieces = cut.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return cut, written(pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "pieces")


def _start(info: DataFrame) -> DataFrame:
    """Every conversation's row of depth 0, by which it is a member of the root."""
    return info.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("size"), "length")


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, size, length): the turns of each conversation numbered from 1, and a row of depth 0; length is its number of turns."""
    cut, pieces = in_order(written(digests(conversations), "turns"))
    info = pieces.groupBy("conv_id").agg(F.sum("n").alias("length"))
    own = cut.join(pieces.join(info, "conv_id"), ["conv_id", "part"])
    rows = own.select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("depth"), "digest", "size", "length")
    return written(rows.unionByName(_start(info)), "paths")


def forked(conversations: DataFrame, every: int = FORK, heads: int = HEADS) -> DataFrame:
    """paths() of conversations that share heads: c starts with the first h turns of conversation c - c % every, h being crc32 of c's decimal
    digits modulo `heads`, and goes on with its own turns after its first h."""
    cut, pieces = in_order(written(digests(conversations), "turns"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    info = pieces.groupBy("conv_id").agg(F.sum("n").alias("n_own")).select("conv_id", "n_own", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    base = info.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    info = info.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    info = written(info.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length")), "forks")
    place = F.col("at") - F.col("first") + F.col("before") + 1
    tails = cut.join(pieces.join(info, "conv_id"), ["conv_id", "part"]).where(place > F.col("h"))
    tails = tails.select("conv_id", (place - F.col("h") + F.col("taken")).alias("depth"), "digest", "size", "length")
    first = cut.join(pieces.where(F.col("before") < heads), ["conv_id", "part"]).where(place < heads)
    first = first.select(F.col("conv_id").alias("base"), place.alias("depth"), "digest", "size")
    shared = info.join(first, "base").where("depth <= h").select("conv_id", "depth", "digest", "size", "length")
    return written(tails.unionByName(shared).unionByName(_start(info)), "paths")


def running(rows: DataFrame, key: list[str], at: str, values: list[str]) -> DataFrame:
    """rows with running sums `sum_<value>` over the dense numbers `at` of each key: within blocks, over blocks' totals, and so on up."""
    block = f"{at}_block"
    rows = rows.withColumn(block, F.floor(F.col(at) / BLOCK))
    up_to = Window.partitionBy(*key, block).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.select("*", *[F.sum(v).over(up_to).alias(f"sum_{v}") for v in values])
    totals = written(rows.groupBy(*key, block).agg(*[F.sum(v).alias(v) for v in values]), "totals")
    last = totals.agg(F.max(block)).first()[0]
    if not last:
        return inside.drop(block)
    if key:
        totals = totals.join(totals.where(F.col(block) > 0).select(*key).distinct(), key)
    if last >= BLOCK:
        upper = running(totals, key, block, values)
    else:
        one = Window.partitionBy(*key).orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upper = totals.select(*key, block, *[F.sum(v).over(one).alias(f"sum_{v}") for v in values])
    before = upper.select(*key, (F.col(block) + 1).alias(block), *[F.col(f"sum_{v}").alias(f"before_{v}") for v in values])
    both = inside.join(before, [*key, block], "left")
    return both.select(*rows.drop(block).columns, *[(F.col(f"sum_{v}") + F.coalesce(F.col(f"before_{v}"), F.lit(0))).alias(f"sum_{v}") for v in values])


def keyed(rows: DataFrame) -> DataFrame:
    """paths() with the key (k1, k2) of each prefix and (p1, p2) of the prefix before it, null for the root."""
    low = F.lit(0xFFFFFFFF)
    parts = {}
    for i in (0, 1):
        h = F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(i), "depth", "digest"))
        parts |= {f"a{i}": F.shiftrightunsigned(h, 32), f"b{i}": h.bitwiseAND(low)}
    summed = running(rows.select("conv_id", "depth", "size", "length", *[v.alias(k) for k, v in parts.items()]), ["conv_id"], "depth", list(parts))

    def key(salt: int, depth: Column, less: bool) -> Column:
        return F.xxhash64(F.lit(salt), depth, *[F.col(f"sum_{v}") - F.col(v) if less else F.col(f"sum_{v}") for v in parts])

    depth = F.col("depth")
    own = [key(i, depth, False).alias(f"k{i + 1}") for i in (0, 1)]
    above = [F.when(depth > 0, key(i, depth - 1, True)).alias(f"p{i + 1}") for i in (0, 1)]
    return written(summed.select("conv_id", "depth", "size", (depth == F.col("length")).alias("ends"), *own, *above), "prefixes")


def members(prefixes: DataFrame) -> DataFrame:
    """(k1, k2, first, ids): the conversations that end at a node, ascending, as comma-joined runs of at most IDS_A_ROW ids; first is a run's first id."""
    order = ["k1", "k2", "conv_id"]
    rows = written(prefixes.where("ends").select(*order), "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, ids = (c.to_numpy() for c in batch.columns)
            new = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            starts = np.concatenate([[0], new, np.arange(0, len(ids), IDS_A_ROW)]) if len(ids) else np.zeros(0)
            starts = np.unique(starts).astype(np.int64)
            ends = np.append(starts[1:], len(ids))
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, ends, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(k1[starts]), pa.array(k2[starts]), pa.array(ids[starts]), pa.array(texts, pa.string())], ["k1", "k2", "first", "ids"])

    cut = rows.repartitionByRange(shuffle_parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    return cut.mapInArrow(run, "k1 long, k2 long, first long, ids string")


def member_digests(runs: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of members(): runs of a node meet in one task, but are hashed as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def out(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[0][i] for f in found], pa.int64()) for i in (0, 1)] + [pa.array([f[1] for f in found], pa.string())], ["k1", "k2", "ends_sha256"])

        for batch in batches:
            found = []
            for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (a, b) == key:
                    held.update(b"," + ids.encode())
                else:
                    if key is not None:
                        found.append((key, held.hexdigest()))
                    key, held = (a, b), hashlib.sha256(ids.encode())
            yield out(found)
        if key is not None:
            yield out([(key, held.hexdigest())])

    dealt = runs.repartition(shuffle_parts(runs.sparkSession), "k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return dealt.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def linked(nodes: DataFrame) -> DataFrame:
    """nodes with parent_id, parent_conv_id, n_children, first_child, last_child, next and prev, the siblings' ids; -1 where there is none.

    Children of a parent are in the order of (salt, id). The table of (parent, salt) holds at most SALTS rows a parent, so what all children
    of a parent need from it reaches them by that pair."""
    child = nodes.where("depth > 0").select("id", F.col("p1"), F.col("p2"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    groups = child.groupBy("p1", "p2", "salt").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    parent = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    by_salt = Window.partitionBy("parent_id").orderBy("salt")
    groups = groups.join(parent, ["p1", "p2"]).select("*", F.lead("low").over(by_salt).alias("after"), F.lag("high").over(by_salt).alias("ahead"))
    groups = written(groups, "groups")
    beside = Window.partitionBy("p1", "p2", "salt").orderBy("id")
    sides = child.select("*", F.lead("id").over(beside).alias("right"), F.lag("id").over(beside).alias("left")).join(groups, ["p1", "p2", "salt"])
    sides = sides.select("id", "parent_id", "parent_conv_id", F.coalesce("right", "after").alias("next"), F.coalesce("left", "ahead").alias("prev"))
    of = groups.groupBy(F.col("parent_id").alias("id")).agg(F.sum("n").alias("n_children"), F.min_by("low", "salt").alias("first_child"), F.max_by("high", "salt").alias("last_child"))
    every = nodes.drop("p1", "p2").join(sides, "id", "left").join(of, "id", "left")
    return every.fillna(0, ["n_children"]).fillna(-1, ["parent_id", "next", "prev", "first_child", "last_child"])


def tour(tree: DataFrame) -> DataFrame:
    """(id, prev, next): arc 2v goes into node v, arc 2v + 1 out of it; -1 before the first and after the last."""
    v, up, first, last, right, left = (F.col(c) for c in ("id", "parent_id", "first_child", "last_child", "next", "prev"))
    before_in = F.when(left >= 0, 2 * left + 1).when(up >= 0, 2 * up).otherwise(-1)
    after_in = F.when(first >= 0, 2 * first).otherwise(2 * v + 1)
    before_out = F.when(last >= 0, 2 * last + 1).otherwise(2 * v)
    after_out = F.when(right >= 0, 2 * right).when(up >= 0, 2 * up + 1).otherwise(-1)
    arc = lambda i, p, n: F.struct(i.cast("long").alias("id"), p.cast("long").alias("prev"), n.cast("long").alias("next"))
    return tree.select(F.explode(F.array(arc(2 * v, before_in, after_in), arc(2 * v + 1, before_out, after_out))).alias("arc")).select("arc.*")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the few arcs that are left: (id, place)."""
    some = [b for b in batches if b.num_rows]
    if some:
        got = pa.Table.from_batches(some)
        ids, prev, to, gap = (got.column(c).to_numpy() for c in ("id", "prev", "next", "gap"))
        order = np.argsort(ids)
        follow = np.where(to >= 0, order[np.searchsorted(ids[order], to).clip(0, len(ids) - 1)], -1).tolist()
        at, path = int(np.flatnonzero(prev < 0)[0]), []
        while at >= 0:
            path.append(at)
            at = follow[at]
        yield pa.RecordBatch.from_arrays([pa.array(ids[path]), pa.array(np.cumsum(gap[path]))], ["id", "place"])


def ranked(arcs: DataFrame, rest: int = REST) -> DataFrame:
    """(id, place) of a linked list (id, prev, next; -1 for none): places from 0. Hashes of ids and round pick what a round takes out, so a
    task that runs again does the same."""
    now = written(arcs.select("id", "prev", "next", F.when(F.col("prev") < 0, 0).otherwise(1).cast("long").alias("gap")), "arcs")
    taken_out = []
    while now.count() > rest:
        rank = lambda c: F.xxhash64(F.lit(len(taken_out)), c)  # noqa: B023, E731
        out = (F.col("prev") >= 0) & (rank("id") > rank("prev")) & ((F.col("next") < 0) | (rank("id") > rank("next")))
        none = F.lit(None).cast("long")

        def row(i, prev=none, to=none, gap=F.lit(0), new_prev=none, new_next=none):
            named = {"id": i, "prev": prev, "next": to, "gap": gap.cast("long"), "new_prev": new_prev, "new_next": new_next}
            return F.struct(*[c.alias(k) for k, c in named.items()])

        same = row(F.col("id"), F.col("prev"), F.col("next"), F.col("gap"))
        join = [row(F.col("prev"), new_next=F.col("next")), row(F.col("next"), gap=F.col("gap"), new_prev=F.col("prev"))]
        told = now.select(F.explode(F.when(out, F.array(*join)).otherwise(F.array(same))).alias("row")).select("row.*").where("id >= 0")
        left = told.groupBy("id").agg(
            F.coalesce(F.max("new_prev"), F.max("prev")).alias("prev"), F.coalesce(F.max("new_next"), F.max("next")).alias("next"), F.sum("gap").alias("gap")
        )
        taken_out.append(now.where(out).select("id", "prev", "gap"))
        now = written(left, "arcs")
    places = written(now.repartition(1).mapInArrow(_walk, "id long, place long"), "places")
    for gone in reversed(taken_out):
        ahead = places.select(F.col("id").alias("prev"), "place")
        found = written(gone.join(ahead, "prev").select("id", (F.col("place") + F.col("gap")).alias("place")), "places")
        places = places.unionByName(found)
    return places


def trie(rows: DataFrame, rest: int = REST) -> DataFrame:
    """One row per node of the trie of paths(): conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (what sharing its subtree's turns saves, in UTF-8 bytes) and ends_sha256, the SHA-256 of the comma-joined ids of the conversations that end there."""
    prefixes = keyed(rows)
    nodes = prefixes.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("size").alias("size"), F.min("p1").alias("p1"), F.min("p2").alias("p2")
    )
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("id"), "*"), "nodes")
    tree = written(linked(nodes), "tree")
    places = ranked(tour(tree), rest)
    worth = lambda i, leaf, saved: F.struct(i.alias("id"), leaf.cast("long").alias("leaves"), saved.cast("long").alias("saved"))
    into = worth(2 * F.col("id"), F.col("n_children") == 0, (F.col("n_convs") - 1) * F.col("size"))
    values = tree.select(F.explode(F.array(into, worth(2 * F.col("id") + 1, F.lit(0), F.lit(0)))).alias("arc")).select("arc.*")
    sums = running(written(values.join(places, "id"), "values"), [], "place", ["leaves", "saved"])
    back = F.col("id") % 2 == 1
    total = lambda v: F.sum(F.when(back, F.col(f"sum_{v}")).otherwise(F.col(v) - F.col(f"sum_{v}")))
    below = sums.groupBy(F.shiftright("id", 1).alias("id")).agg(total("leaves").alias("n_leaves"), total("saved").alias("saved_tokens"))
    ends = member_digests(members(prefixes))
    found = tree.join(below, "id").join(ends, ["k1", "k2"], "left").fillna(hashlib.sha256(b"").hexdigest(), ["ends_sha256"])
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11(spark, sf_dir: str) -> DataFrame:
    return trie(forked(table(spark, sf_dir, "conversations")))
