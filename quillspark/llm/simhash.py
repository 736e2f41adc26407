"""SimHash near-duplicates found with anchor points of a covering code.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 1 bit in one of their two 32-bit halves. Each
half is covered by anchors: its low 31 bits by the words of the perfect Hamming(31, 26) code (covering radius 1), its
top bit by itself. So a half has a home anchor within distance 1, and two halves at distance 1 or less meet at the
home anchor of either if every fingerprint is also sent to all anchors within covering radius plus threshold (1 + 1):
17 anchors a half. 2^27 anchors a half keep groups small. Fingerprints are compared anchor by anchor.

Documents of one fingerprint enter once, with their smallest doc_id. Within an anchor only links that join parts are
written, never all pairs. Anchors that are home to more than `tile` fingerprints are cut in tiles, and each pair of
tiles is a group of its own. Components of the links are found by distributed star rounds.

Defined results: a null or empty text has no words and fingerprint zero, which links like any other; a row with a null
doc_id has a fingerprint but is in no component (null); rows of one doc_id are all reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, shuffle_parts, table, written

SHINGLE = 3
DISTANCE = 3
TILE = 50_000
_AT_ONCE = 1 << 17

#: Masks of bit positions 1..31 (bit 0 is position 1) whose number has bit k.
_PARITY = np.array([sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)], np.uint64)
#: For each syndrome the 15 pairs of positions that cancel it; without those of which one is no position.
_PAIRS = np.array([[0] * 15] + [[1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i ^ s > i] for s in range(1, 32)], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = [x - 1 for x in accumulate(len(x) + 1 for x in words)]
    starts = [0, *(x + 1 for x in ends)][:n]
    ends = ends[min(shingle, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    one = xxhash.xxh64_intdigest
    for at in range(0, n, _AT_ONCE):
        h = np.array([one(joined[a:b], 42) for a, b in zip(starts[at : at + _AT_ONCE], ends[at : at + _AT_ONCE], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t or b"", shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of every anchor that each fingerprint goes to."""
    rows, keys, home = [], [], []
    for half in range(2):
        bits = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        low, top = bits & np.uint64(0x7FFFFFFF), bits >> np.uint64(31) << np.uint64(31)
        s = np.zeros(len(fp), np.int64)
        for k in range(5):
            s |= (np.bitwise_count(low & _PARITY[k]).astype(np.int64) & 1) << k
        at = np.arange(len(fp))
        flip = np.where(s > 0, np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64), np.uint64(0))
        near = low ^ flip
        off = np.flatnonzero(s > 0)
        far = (low[off, None] ^ _PAIRS[s[off]]) | top[off, None]
        side = np.uint64(half << 32)
        rows += [at, at, np.repeat(off, 15)]
        keys += [near | top | side, near | (top ^ np.uint64(1 << 31)) | side, far.ravel() | side]
        home += [np.ones(len(at), bool), np.zeros(len(at), bool), np.zeros(len(off) * 15, bool)]
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(home)


def replicated(groups: DataFrame) -> DataFrame:
    """(anchor, fp, rep, home) for groups (fp, rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a in range(0, len(fp), 1000):
                rows, keys, home = anchors(fp[a : a + 1000].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[a + rows]), pa.array(rep[a + rows]), pa.array(home)], ["anchor", "fp", "rep", "home"])

    return groups.select("fp", "rep").mapInArrow(run, "anchor bigint, fp bigint, rep bigint, home boolean")


def joined_up(fp: np.ndarray, rep: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all fingerprints of a group which chains of close pairs connect: a forest, not all pairs."""
    left, out = np.arange(len(fp)), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            f = front.pop()
            near = np.bitwise_count(fp[left] ^ fp[f]) <= distance
            hit = left[near]
            if len(hit):
                out.append((np.full(len(hit), rep[f]), rep[hit]))
                front.extend(hit.tolist())
                left = left[~near]
    return out


def linked(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, distance: int, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(edge, len(key)))
    out = []
    size = np.repeat(n, n)
    for step in range(1, min(small, int(n.max(initial=1)))):
        at = np.flatnonzero((size[:-step] <= small) & (key[step:] == key[:-step]))
        at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
        out.append((rep[at], rep[at + step]))
    for a, m in zip(edge[n > small].tolist(), n[n > small].tolist(), strict=True):
        out += joined_up(fp[a : a + m], rep[a : a + m], distance)
    pairs = np.concatenate([np.stack(x, 1) for x in out] or [np.zeros((0, 2), np.int64)])
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(groups: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """(a, b): links between the reps of fingerprints at most `distance` bits apart, enough to connect all of them. Of two such one is at home at an
    anchor that the other visits, so an anchor with visitors only is left out, and one with more than `tile` rows is cut in tiles of homes against all."""
    if distance > 3:
        raise ValueError("the anchors cover at most 3 differing bits")
    n = shuffle_parts(groups.sparkSession)
    sent = replicated(groups)
    home = F.col("home").cast("long")
    crowded = written(sent.groupBy("anchor").agg(F.sum(home).alias("homes"), F.count("*").alias("n")).where((F.col("n") > tile) & (F.col("homes") > 0)), "crowded")
    if crowded.isEmpty():
        sent = sent.withColumn("part", F.lit(0))
    else:
        tiles = lambda c: F.ceil(2 * F.col(c) / tile).cast("int").alias(f"{c}_tiles")
        both = sent.join(crowded.select("anchor", tiles("homes"), tiles("n")), "anchor", "left")
        own = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        hot = both.where("n_tiles is not null")
        left = hot.where("home").withColumn("other", every("n_tiles")).withColumn("part", own("homes_tiles") * F.col("n_tiles") + F.col("other"))
        right = hot.withColumn("other", every("homes_tiles")).withColumn("part", F.col("other") * F.col("n_tiles") + own("n_tiles"))
        cool = both.where("n_tiles is null").withColumn("part", F.lit(0))
        columns = ["anchor", "part", "fp", "rep", "home"]
        sent = cool.select(*columns).unionAll(left.select(*columns)).unionAll(right.select(*columns))
    dealt = sent.select("anchor", "part", "fp", "rep", "home").repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(keys, part, fp, rep, home):
            key = keys * np.int64(1_000_003) + part
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            some = np.repeat(np.logical_or.reduceat(home, starts), np.diff(np.append(starts, len(key))))  # two that are both only visitors meet where one is at home
            a, b = linked(key[some], fp[some], rep[some], distance)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            new = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(new[0]):
                continue
            held.append(new)
            if new[0][0] == new[0][-1] and new[1][0] == new[1][-1] and held[0][0][0] == new[0][0]:
                continue  # one group so far
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = [tuple(x[cut:] for x in rows)]
            if cut:
                yield out(rows[0][:cut], rows[1][:cut], rows[2][:cut].view(np.uint64), rows[3][:cut], rows[4][:cut])
        if held:
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield out(rows[0], rows[1], rows[2].view(np.uint64), rows[3], rows[4])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def cluster(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    fps = written(fingerprints(docs, shingle), "fingerprints")
    groups = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "groups")
    joined = components(links(groups.where("rep is not null"), distance))
    roots = groups.join(joined, groups.rep == joined.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(roots, "fp").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op6(spark, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
