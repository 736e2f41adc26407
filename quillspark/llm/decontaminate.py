"""Benchmark decontamination: Wu-Manber search for all windows of benchmark words in all documents.

The alphabet is words. For the patterns of one length m, a table over hashed blocks of B words tells how far a search
position may shift: a block that no pattern holds shifts by m - B + 1 words. Where the shift is 0, the block's bucket
names the patterns that end in it; a second block at the front thins them, and the bytes of the words decide. All
texts of a batch are searched side by side: texts are cut in lanes, and one numpy step moves every lane.

Tables grow with the patterns, so that most blocks of a text still shift, and are built once, by the driver. Patterns are
taken in blocks of at most `block_patterns` windows and `block_bytes` bytes, which bounds what is broadcast. Benchmarks of one block,
the usual case, need one pass and no shuffle. With more, documents are written once with a row number, each block makes
a pass of its own that keeps only rows with hits, its broadcast is taken back before the next, and the hits of a row are
united: neither the driver nor a worker holds more than a block.

Defined results: a null text, or one without words, has no words and no hits; an item without words, or with a null
item_id, has no windows; items of one text each keep their own id; rows of one doc_id are reported one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, table, unpacked, with_own, written
from .words import ALNUM, Words, parts

WINDOW = 10
LANE = 512
BLOCK_BYTES = 64 << 20


def item_windows(item_id: int, text: str | None, window: int) -> Iterator[tuple[bytes, int]]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(ALNUM).split()
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield b" ".join(words[i : i + window]), item_id


class Patterns:
    """Shift and bucket tables for the patterns of one length."""

    def __init__(self, texts: list[bytes], items: list[list[int]]):
        self.m = len(texts[0].split())
        self.block = min(2, self.m)
        self.texts, self.items = texts, items
        grams = Words(texts).grams(self.block).reshape(len(texts), self.m)[:, : self.m - self.block + 1]
        far = self.m - self.block + 1
        self.bits = min(26, max(12, (4 * len(texts) * far).bit_length()))  # at most a quarter of the entries are taken
        self.shift = np.full(1 << self.bits, far, np.uint8 if far < 256 else np.int64)
        for j in range(far):  # later blocks shift less and come last
            self.shift[(grams[:, j] >> np.uint64(64 - self.bits)).astype(np.int64)] = far - 1 - j
        order = np.argsort(grams[:, -1], kind="stable")
        self.order = order
        self.suffix = grams[order, -1]
        self.prefix = grams[order, 0]

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence in w."""
        grams = w.grams(self.block)
        # a lane searches window starts [at, stop)
        starts, stops = [], []
        for d in np.flatnonzero(w.n >= self.m):
            a, b = w.first[d], w.first[d + 1] - self.m + 1
            cuts = np.arange(a, b, LANE)
            starts.append(cuts)
            stops.append(np.append(cuts[1:], b))
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, stop = np.concatenate(starts), np.concatenate(stops)
        key = (grams >> np.uint64(64 - self.bits)).astype(np.int64)
        tail = self.m - self.block
        found = []
        while len(at):
            move = self.shift[key[at + tail]].astype(np.int64)
            zero = at[move == 0]
            if len(zero):
                found.append(zero)
            at = at + np.maximum(move, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(found)
        low = np.searchsorted(self.suffix, grams[at + tail], "left")
        n = np.searchsorted(self.suffix, grams[at + tail], "right") - low
        keep = n > 0
        at, low, n = at[keep], low[keep], n[keep]
        who = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        keep = self.prefix[who] == grams[at]
        at, which = at[keep], self.order[who[keep]]
        same = np.fromiter(
            (b" ".join(w.data[w.start[i] : w.end[i + self.m - 1]].split()) == self.texts[p] for i, p in zip(at.tolist(), which.tolist(), strict=True)), bool, len(at)
        )
        return at[same], which[same]


def build(windows: dict[bytes, list[int]]) -> list[Patterns]:
    by_length: dict[int, list[bytes]] = {}
    for text in sorted(windows):
        by_length.setdefault(text.count(b" ") + 1, []).append(text)
    return [Patterns(texts, [windows[t] for t in texts]) for _, texts in sorted(by_length.items())]


def search(texts: list[bytes], block: list[Patterns]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[int]]]:
    """Of each text its number of words, the (first word, words) of its hits and the sorted ids of items found."""
    sizes: list[int] = []
    spans: list[set[tuple[int, int]]] = [set() for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    for a, b in parts(texts):
        w = Words(texts[a:b], ALNUM)
        sizes += w.n.tolist()
        for patterns in block:
            at, which = patterns.find(w)
            doc = w.doc[at]
            for d, start in zip(doc.tolist(), (at - w.first[doc]).tolist(), strict=True):
                spans[a + d].add((start, patterns.m))
            for d, p in set(zip(doc.tolist(), which.tolist(), strict=True)):
                items[a + d].update(patterns.items[p])
    return sizes, [sorted(x) for x in spans], [sorted(x) for x in items]


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any of the spans, which are sorted."""
    n = end = 0
    for start, m in spans:
        n += max(0, start + m - max(start, end))
        end = max(end, start + m)
    return n


def blocks_of(benchmark: DataFrame, window: int, block_patterns: int, block_bytes: int) -> Iterator[list[Patterns]]:
    held: dict[bytes, list[int]] = {}
    size = 0
    for row in benchmark.where("item_id is not null").select("item_id", "text").toLocalIterator():
        for text, item in item_windows(row[0], row[1], window):
            held.setdefault(text, []).append(item)
            size += len(text) + 100
            if len(held) >= block_patterns or size >= block_bytes:
                yield build(held)
                held, size = {}, 0
    yield build(held)


_FOUND = "n_words bigint, n_hit bigint, hit_items array<bigint>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_patterns: int = 500_000, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (or its columns `carry`) with the columns n_words, n_hit (words inside a benchmark window) and hit_items (array of item_id)."""
    spark = docs.sparkSession
    own = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("n_words", "n_hit", "hit_items")]
    df = carried(docs, own, F.col("text").cast("binary").alias("text"))
    ends = ("n_words", "n_hit", "hit_items")
    out_schema = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit_items", pa.list_(pa.int64()))])
    blocks = blocks_of(benchmark, window, block_patterns, block_bytes)
    sent, more = spark.sparkContext.broadcast(next(blocks)), next(blocks, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = zip(*search([t or b"" for t in batch.column(0).to_pylist()], sent.value), strict=True)
            found = pa.array([{"n_words": n, "n_hit": covered(spans), "hit_items": items} for n, spans, items in got], out_schema)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found.flatten()], [*batch.schema.names[1:], *out_schema.names])

    if more is None:
        return unpacked(df.mapInArrow(run, with_own(df, _FOUND)), own, *ends)

    base = written(df.withColumn("row", F.monotonically_increasing_id()), "texts")
    hits = []
    while sent is not None:

        def hit(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, spans, items = search([t or b"" for t in batch.column(0).to_pylist()], sent.value)
                some = [i for i, x in enumerate(spans) if x]
                pairs = pa.list_(pa.struct([("a", pa.int64()), ("m", pa.int64())]))
                rows = [batch.column(1).take(pa.array(some, pa.int64())), pa.array([[{"a": a, "m": m} for a, m in spans[i]] for i in some], pairs), pa.array([items[i] for i in some], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(rows, ["row", "spans", "items"])

        hits.append(written(base.select("text", "row").mapInArrow(hit, "row bigint, spans array<struct<a: bigint, m: bigint>>, items array<bigint>"), "hits"))
        sent.destroy()
        sent = spark.sparkContext.broadcast(more) if more is not None else None
        more = next(blocks, None) if more is not None else None
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  of one row: as many as it has hits
    found = reduce(DataFrame.unionAll, hits).groupBy("row").agg(flat("spans"), flat("items"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, _, _ = search([t or b"" for t in batch.column(0).to_pylist()], [])
            spans = [covered([(x["a"], x["m"]) for x in row or []]) for row in batch.column(1).to_pylist()]
            rows = [{"n_words": n, "n_hit": h, "hit_items": i or []} for n, h, i in zip(sizes, spans, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *pa.array(rows, out_schema).flatten()], [*batch.schema.names[3:], *out_schema.names])

    whole = base.join(found, "row", "left").select("text", "spans", "items", "own")
    return unpacked(whole.mapInArrow(count, with_own(whole, _FOUND)), own, *ends)


def op5(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
