"""Source divergence audit by a recount over minimal perfect hashes.

A first pass counts, exactly, in how many documents of its language each term occurs; terms of at least `least` documents are kept. Kept
terms of a language are cut in shards by hash, and each shard gets a minimal perfect hash: levels of bits, in which a term that is alone at its
place is settled and the others go on to the next level, so that the number of bits set before a term's bit is its slot. The terms themselves are
stored in slot order, and a lookup counts only if the stored term is equal, byte by byte. The shards are broadcast, and the second pass adds to dense
slots of each (language, source) group; what a task has counted leaves it as pairs of slot and count, by shard. Shards of more than `BROADCAST_BYTES`
in all are not broadcast: then each task's counted terms go to their shard, which looks them up, by the same hash, as they stream past.

Last, every shard's task has the dense counts of all groups of its language (at most `CELLS` numbers, by the size of shards), and adds up
divergences of pairs of sources and of terms; sums over shards and the best `top` terms a group are plain aggregates and windows.

Shares are whole numbers, p = 1 + floor(10^9 (count + 1) / (N + V)), divergences floor((p - q)^2 / q); nothing is rounded elsewhere.

Defined results: null text, lang and source are empty; every row is a document, also of a repeated doc_id; a language without kept terms has divergence 0
between its sources; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, table, written
from .words import Words, mix, parts

LEAST, TOP = 3, 200
SCALE = 10**9
BROADCAST_BYTES = 16 << 20
HELD_BYTES = 192 << 20
CELLS = 1 << 22
SHARD_KEYS = 1 << 14
LEVELS = 40
ROOM = 2  # places a term in a level

#: A-Z become a-z; bytes that are neither letters nor part of a non-ASCII character part terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

COUNTED = "lang string, shard int, kind int, source string, n long, v long, a binary, b binary"
SHARD, GROUP, SLOTS = 0, 1, 2


def documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow array of values that follow each other in data."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def split(blob: bytes) -> pa.Array:
    """Terms of a blob, which spaces part."""
    raw = np.frombuffer(blob, np.uint8)
    gap = np.append(np.flatnonzero(raw == 32), len(raw)) if len(raw) else np.zeros(0, np.int64)
    return binary(raw[raw != 32], gap - np.arange(len(gap)))


def counted(texts: list[bytes], group: np.ndarray, n_groups: int, once: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of the texts, and (group, term, n): how often each occurs in the texts of a group, or `once` a text."""
    raw = np.frombuffer(b" ".join(texts).translate(LETTERS), np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    np.not_equal(raw, 32, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    terms = binary(raw[inside[1:-1]], np.cumsum(end - start)).dictionary_encode()
    code = terms.indices.to_numpy().astype(np.int64)
    size = max(1, len(terms.dictionary))
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    if once:
        pair = np.unique(doc * size + code)
        doc, code = pair // size, pair % size
    n = np.bincount(group[doc] * size + code, minlength=n_groups * size) if n_groups * size <= 1 << 22 else None
    if n is not None:
        at = np.flatnonzero(n)
        n = n[at]
    else:
        at, n = np.unique(group[doc] * size + code, return_counts=True)
    return terms.dictionary, at // size, at % size, n


def by_group(batch: pa.RecordBatch, names: list[str]) -> tuple[list[tuple], np.ndarray, list[bytes]]:
    """Groups of a batch, each document's group and text."""
    keys = list(zip(*[batch.column(c).to_pylist() for c in names], strict=True))
    groups = sorted(set(keys))
    number = {k: i for i, k in enumerate(groups)}
    return groups, np.fromiter(map(number.__getitem__, keys), np.int64, len(keys)), batch.column("text").to_pylist()


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term): terms of at least so many documents of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, group, texts = by_group(batch, ["lang"])
            for a, b in parts(texts, 8 << 20):
                terms, g, code, n = counted(texts[a:b], group[a:b], len(groups), True)
                langs = pa.array([k[0] for k in groups], pa.string()).take(pa.array(g))
                yield pa.RecordBatch.from_arrays([langs, terms.take(pa.array(code)).cast(pa.binary()), pa.array(n.astype(np.int64))], ["lang", "term", "n"])

    found = docs.select("lang", "text").mapInArrow(run, "lang string, term binary, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def hashes(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = Words([b" ".join(terms.to_pylist())])
    return w.hash, w.check


def place(h: np.ndarray, check: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    return (mix(h ^ mix(check + np.uint64(level))) % np.asarray(size, np.uint64)).astype(np.int64)


def built(terms: pa.Array) -> tuple[np.ndarray, bytes]:
    """Order of a shard's terms by slot, and its levels: their number, sizes, and bits in words of 64. Terms that no level settles come last."""
    h, check = hashes(terms) if len(terms) else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    left, order, sizes, words = np.arange(len(terms)), [], [], []
    for level in range(LEVELS):
        if not len(left):
            break
        size = -(-max(64, ROOM * len(left)) // 64) * 64
        at = place(h[left], check[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        settled = alone[at]
        order.append(left[settled][np.argsort(at[settled])])
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        left = left[~settled]
    head = np.array([len(sizes), *sizes], np.int64)
    return np.concatenate([*order, left]).astype(np.int64), head.tobytes() + b"".join(w.tobytes() for w in words)


class Shards:
    """Perfect hashes of a language's shards, looked up together: term -> slot. shards are (number of terms, blob of terms, blob of levels)."""

    def __init__(self, shards: list[tuple[int, bytes, bytes]]):
        self.n = len(shards)
        self.base = np.concatenate([[0], np.cumsum([s[0] for s in shards])]).astype(np.int64)
        self.keys = pa.concat_arrays([split(s[1]) for s in shards])
        self.levels, self.rest = [], {}
        reads = []
        for s in shards:
            head = np.frombuffer(s[2], np.int64, int(np.frombuffer(s[2], np.int64, 1)[0]) + 1)
            reads.append((head[1:], np.frombuffer(s[2], np.uint64, offset=8 * len(head))))
        done, used = self.base[:-1].copy(), np.zeros(self.n, np.int64)
        for level in range(max((len(r[0]) for r in reads), default=0)):
            size = np.array([r[0][level] if level < len(r[0]) else 0 for r in reads], np.int64)
            words = [r[1][u : u + m // 64] for r, u, m in zip(reads, used, size, strict=True)]
            ahead = [d + np.concatenate([[0], np.cumsum(np.bitwise_count(w).astype(np.int64))]) for w, d in zip(words, done, strict=True)]
            done = np.array([a[-1] for a in ahead])
            used += size // 64
            start = np.concatenate([[0], np.cumsum(size // 64)])[:-1]
            self.levels.append((size, start, np.concatenate(words), np.concatenate([a[:-1] for a in ahead])))
        for s in range(self.n):
            for slot in range(int(done[s]), int(self.base[s + 1])):
                self.rest[self.keys[slot].as_py()] = slot

    def slots(self, terms: pa.Array) -> np.ndarray:
        """The slot of each term, -1 for a term that is not stored."""
        slot = np.full(len(terms), -1, np.int64)
        if not len(terms) or not len(self.keys):
            return slot
        h, check = hashes(terms)
        shard = shard_of(h, self.n)
        left = np.arange(len(terms))
        for level, (size, start, words, ahead) in enumerate(self.levels):
            left = left[size[shard[left]] > 0]
            if not len(left):
                break
            at = place(h[left], check[left], level, size[shard[left]])
            where = start[shard[left]] + (at >> 6)
            bit = (at & 63).astype(np.uint64)
            word = words[where]
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            slot[left[hit]] = (ahead[where] + np.bitwise_count(below))[hit]
            left = left[~hit]
        for i in left if self.rest else ():
            slot[i] = self.rest.get(terms[int(i)].as_py(), -1)
        some = np.flatnonzero(slot >= 0)
        same = pc.equal(self.keys.take(pa.array(slot[some])), terms.take(pa.array(some))).to_numpy(zero_copy_only=False)
        slot[some[~same]] = -1
        return slot


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(max(1, n))).astype(np.int64)


def sharded(kept: DataFrame, langs: DataFrame, keys: int) -> DataFrame:
    """COUNTED rows of kind SHARD: n terms of v of the language, a the terms by slot, b the levels. Every language has a shard at least, and all its shards are there.

    Only languages of more than `keys` terms, at most one for each `keys` kept terms, have several shards; their number goes with each term."""
    sizes = written(kept.groupBy("lang").agg(F.count("*").alias("v")), "sizes")
    large = {r["lang"]: -(-r["v"] // keys) for r in sizes.where(F.col("v") > keys).collect()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = np.array([large.get(x, 1) for x in batch.column(0).to_pylist()], np.uint64)
                shard = ((hashes(batch.column(1))[0] >> np.uint64(32)) % n).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], ["lang", "term", "shard"])

    def build(group: pa.Table) -> pa.Table:
        terms = group.column("term").combine_chunks()
        order, levels = built(terms)
        blob = b" ".join(terms.take(pa.array(order)).to_pylist())
        return pa.table({"lang": group.column("lang")[:1], "shard": group.column("shard")[:1], "n": pa.array([len(terms)], pa.int64()), "a": pa.array([blob], pa.binary()), "b": pa.array([levels], pa.binary())})

    some = kept.mapInArrow(deal, "lang string, term binary, shard int").groupBy("lang", "shard").applyInArrow(build, "lang string, shard int, n long, a binary, b binary")
    v = F.coalesce("v", F.lit(0)).cast("long")
    wanted = langs.join(sizes, "lang", "left").select("lang", v.alias("v"), F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(v / keys).cast("int"), F.lit(1)) - 1)).alias("shard"))
    every = wanted.join(some, ["lang", "shard"], "left")  # a shard may have no terms
    empty = F.lit(np.zeros(1, np.int64).tobytes())
    return every.select("lang", "shard", F.lit(SHARD).alias("kind"), F.lit("").alias("source"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "v", F.coalesce("a", F.lit(b"")).alias("a"), F.coalesce("b", empty).alias("b"))


def rows_of(kind: int, rows: list[tuple]) -> pa.RecordBatch:
    """COUNTED rows of (lang, shard, source, n, a, b)."""
    lang, shard, source, n, a, b = zip(*rows, strict=True) if rows else [()] * 6
    arrays = [
        pa.array(lang, pa.string()), pa.array(shard, pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array(source, pa.string()), pa.array(n, pa.int64()),
        pa.array([0] * len(rows), pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["lang", "shard", "kind", "source", "n", "v", "a", "b"])


def slot_row(lang: str, shard: int, source: str, slot: np.ndarray, n: np.ndarray) -> tuple:
    return lang, shard, source, int(n.sum()), slot.astype(np.int32).tobytes(), n.astype(np.int64).tobytes()


def recounted(docs: DataFrame, shards: DataFrame, held: int = HELD_BYTES) -> DataFrame:
    """The second pass with broadcast shards: COUNTED rows of kind SLOTS, in a shard's own slots. A task's dense slots take at most `held` bytes
    (or one group's): before they would take more they leave the task."""
    got: dict[str, list] = {}
    for r in shards.orderBy("lang", "shard").select("lang", "n", "a", "b").collect():  # at most BROADCAST_BYTES, see divergence()
        got.setdefault(r["lang"], []).append((r["n"], bytes(r["a"]), bytes(r["b"])))
    sent = docs.sparkSession.sparkContext.broadcast(got)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {lang: Shards(s) for lang, s in sent.value.items()}
        dense: dict[tuple, np.ndarray] = {}

        def emptied() -> pa.RecordBatch:
            rows = []
            for (lang, source), n in dense.items():
                some = np.flatnonzero(n)
                base = known[lang].base
                cut = np.searchsorted(some, base)
                rows += [slot_row(lang, s, source, some[i:j] - base[s], n[some[i:j]]) for s, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            dense.clear()
            return rows_of(SLOTS, rows)

        for batch in batches:
            groups, group, texts = by_group(batch, ["lang", "source"])
            for a, b in parts(texts, 8 << 20):
                terms, g, code, n = counted(texts[a:b], group[a:b], len(groups), False)
                slots, cut = {}, np.searchsorted(g, np.arange(len(groups) + 1))
                for i in np.unique(g).tolist():
                    lang = groups[i][0]
                    if lang not in slots:
                        slots[lang] = known[lang].slots(terms)
                    if groups[i] not in dense:
                        size = len(known[lang].keys)
                        if (sum(map(len, dense.values())) + size) * 8 > held:
                            yield emptied()
                        dense[groups[i]] = np.zeros(size, np.int64)
                    at = slots[lang][code[cut[i] : cut[i + 1]]]
                    dense[groups[i]][at[at >= 0]] += n[cut[i] : cut[i + 1]][at >= 0]  # a group has a term once
        yield emptied()

    return docs.mapInArrow(run, COUNTED)


def streamed(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run() over COUNTED rows dealt by shard: shards of a task come one after the other, SHARD rows first, then GROUP, then SLOTS."""
    return rows.repartition(shuffle_parts(rows.sparkSession), "lang", "shard").sortWithinPartitions("lang", "shard", "kind", "source").mapInArrow(run, schema)


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def dealt(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """The second pass without a broadcast: each task's terms and counts go to their shards, which look them up as they stream past."""
    of = {r["lang"]: r["n"] for r in shards.groupBy("lang").agg(F.count("*").alias("n")).where("n > 1").collect()}  # at most a row for each SHARD_KEYS kept terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, group, texts = by_group(batch, ["lang", "source"])
            for a, b in parts(texts, 8 << 20):
                terms, g, code, n = counted(texts[a:b], group[a:b], len(groups), False)
                if not len(terms):
                    continue
                h, words, rows = hashes(terms)[0], np.array(terms.to_pylist(), object), []
                for i in np.unique(g).tolist():
                    (lang, source), mine = groups[i], g == i
                    shard = shard_of(h[code[mine]], of.get(lang, 1))
                    for s in np.unique(shard).tolist():
                        at = np.flatnonzero(mine)[shard == s]
                        rows.append((lang, s, source, 0, b" ".join(words[code[at]]), n[at].astype(np.int64).tobytes()))
                yield rows_of(SLOTS, rows)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known, source, dense = None, None, None, None

        def out() -> Iterator[pa.RecordBatch]:
            some = np.flatnonzero(dense) if dense is not None else ()
            if len(some):
                yield rows_of(SLOTS, [slot_row(*key, source, some, dense[some])])

        for r in each(batches):
            if r["kind"] == SHARD:
                yield from out()
                key, known, source, dense = (r["lang"], r["shard"]), Shards([(r["n"], r["a"], r["b"])]), None, None
                continue
            if r["source"] != source:
                yield from out()
                source, dense = r["source"], np.zeros(len(known.keys), np.int64)
            at = known.slots(split(r["a"]))
            dense[at[at >= 0]] += np.frombuffer(r["b"], np.int64)[at >= 0]
        yield from out()

    return streamed(docs.mapInArrow(count, COUNTED).unionByName(shards), look, COUNTED)


def share(count: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / whole), three digits at a time, so that no product leaves 64 bits below 9 * 10^15 words."""
    rest, out = (count + 1).astype(np.int64), np.zeros(count.shape, np.int64)
    out, rest = rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def spread(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def compared(rows: DataFrame, top: int) -> DataFrame:
    """(lang, source, part, item, value) of each shard: pairs' sums over the shard's terms, and each group's best `top` terms of the shard."""

    def batch(lang: str, source: list, part: str, item: list, value: np.ndarray) -> pa.RecordBatch:
        names = ["lang", "source", "part", "item", "value"]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(item), pa.string()), pa.array(source, pa.string()), pa.array([part] * len(item), pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, sums, sources, terms, whole, v, dense = None, None, [], None, [], 0, None

        def pairs() -> Iterator[pa.RecordBatch]:
            """Sums of the language so far, a row of the matrix at a time."""
            for i, s in enumerate(sources if sums is not None else ()):
                others = [j for j in range(len(sources)) if j != i]
                yield batch(lang, [s] * len(others), "pair", [sources[j] for j in others], sums[i][others])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal sums
            if sums is None:
                sums = np.zeros((len(sources), len(sources)), np.int64)
            if dense is None or not dense.shape[1]:
                return
            p = np.stack([share(n, w + v) for n, w in zip(dense, whole, strict=True)])
            q = share(dense.sum(0), sum(whole) + v)
            by_term = np.argsort(np.argsort(np.array(terms, object)))
            for i, s in enumerate(sources):
                sums[i] += spread(p[i], p).sum(1)
                at = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                value = spread(p[i][at], q[at])
                best = np.lexsort((by_term[at], -value))[:top]
                yield batch(lang, [s] * len(best), "term", [terms[k].decode() for k in at[best]], value[best])

        for r in each(batches):
            if r["kind"] == SHARD:
                if lang is not None:
                    yield from close()
                if r["lang"] != lang:
                    yield from pairs()
                    sums = None
                lang, terms, v, sources, whole, dense, n = r["lang"], split(r["a"]).to_pylist(), r["v"], [], [], None, r["n"]
            elif r["kind"] == GROUP:
                sources.append(r["source"])
                whole.append(r["n"])
            else:
                if dense is None:
                    number, dense = {s: i for i, s in enumerate(sources)}, np.zeros((len(sources), n), np.int64)
                dense[number[r["source"]]][np.frombuffer(r["a"], np.int32)] += np.frombuffer(r["b"], np.int64)
        if lang is not None:
            yield from close()
            yield from pairs()

    return streamed(rows, run, "lang string, source string, part string, item string, value long")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, broadcast: int = BROADCAST_BYTES, keys: int = SHARD_KEYS, held: int = HELD_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language how far each other source's terms are from its own (part `pair`), and
    which terms it has more of than its language, the first `top` of them (part `term`). Rows do not depend on the other settings."""
    docs = documents(docs)
    groups = written(docs.select("lang", "source").distinct(), "groups")
    most = groups.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    kept = written(kept_terms(docs, least), "kept")
    shards = written(sharded(kept, groups.select("lang").distinct(), int(min(keys, max(16, CELLS // most)))), "shards")
    size = shards.agg(F.sum(F.octet_length("a") + F.octet_length("b"))).first()[0] or 0
    slots = written(recounted(docs, shards, held) if size <= broadcast else dealt(docs, shards), "slots")
    sums = groups.join(slots.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    totals = sums.join(shards.select("lang", "shard"), "lang").select(
        "lang", "shard", F.lit(GROUP).alias("kind"), "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.lit(0).cast("long").alias("v"), F.lit(b"").alias("a"), F.lit(b"").alias("b")
    )
    found = compared(shards.unionByName(totals).unionByName(slots), top)
    found = written(found, "found")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    return pair.unionByName(found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def op12(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")
