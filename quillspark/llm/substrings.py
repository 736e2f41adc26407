"""Substring dedup by relative Lempel-Ziv parsing against an index of all documents.

Every document is a reference for those with larger ids. The reference is indexed in blocks of 13 words, and a document
is parsed greedily: at each word the index tells the block that starts there and the smallest document, and place in it,
that holds the block; a factor runs on while the next block continues the same copy. Where a factor ends, the blocks that
straddle its end are looked up as well, so a factor may begin before the last one ended. Words of all factors are
removed. A factor is at least one block long.

Looking every block up would shuffle a row a word. Equal blocks have equal minimizers (the run of 4 words with the
smallest hash among the 10 in a block), so first only minimizers travel, packed by shard, once for each batch of
documents. Blocks are then looked up only where their minimizer is held by two documents. In each batch the entries
that a smaller document of the same batch settles are not sent, so a passage that a third of all documents share puts
one entry a batch in its shard.

Equal blocks are told by 96 bits: a 64-bit hash of the block, and 32 bits of a second one, made from other hashes of its words.

Entries are dealt to a few times as many shards as there are partitions, and each partition is sorted by shard, so a task
holds one shard at a time.

Defined results: a null text has no words; a row with a null doc_id is kept whole and is no reference; rows of one doc_id
are one document and never remove words of each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, shuffle_parts, table
from .words import Words, parts

BLOCK = 13
SEED = 4
SHARDS = 4  # a partition
PACKED = "shard int, known boolean, hashes binary, checks binary, docs binary, places binary, ref_docs binary, ref_places binary"
BLOBS = (np.uint64, np.uint32, np.int64, np.int32, np.int64, np.int32)


def minimizers(w: Words, block: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block starts, place of the minimizer of each, hash at every place)."""
    g = w.grams(seed)
    at = np.flatnonzero(w.inside(block))
    if not len(at):
        return at, at, g
    least = sliding_window_view(g, block - seed + 1)[at].argmin(1)
    return at, at + least, g


def runs(hashes: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first index, size) of each run of equal hashes, and checks."""
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    if checks is not None:
        new[1:] |= checks[1:] != checks[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(hashes)))


def to_blob(x: np.ndarray) -> bytes:
    """First bytes of all numbers, then second bytes and so on: high bytes are alike and compress well in a shuffle."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_blob(blob: bytes, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def packed(hashes: np.ndarray, checks: np.ndarray, docs: np.ndarray, places: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Rows for the shards. Of each hash only the two smallest documents of the batch go to the hash's shard; what the
    smallest settles for the others is known here, and goes to any shard, with the reference."""
    order = np.lexsort((places, docs, checks, hashes))
    hashes, checks, docs, places = hashes[order], checks[order], docs[order], places[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1]) | (docs[1:] != docs[:-1])
    hashes, checks, docs, places = hashes[new], checks[new], docs[new], places[new].astype(np.int32)  # the first place in each document
    first, size = runs(hashes, checks)
    lead, rank = np.repeat(first, size), np.arange(len(hashes)) - np.repeat(first, size)
    rows = []
    for known, at in ((False, np.flatnonzero(rank < 2)), (True, np.flatnonzero(rank >= 2))):
        shard = (docs[at].view(np.uint64) if known else hashes[at]) % np.uint64(n)
        order = np.argsort(shard, kind="stable")
        at, shard = at[order], shard[order]
        for a, m in zip(*runs(shard), strict=True):
            k = at[a : a + m]
            ref = lead[k] if known else k[:0]
            rows.append((int(shard[a]), known, *(to_blob(x) for x in (hashes[k], checks[k[: 0 if known else m]], docs[k], places[k], docs[ref], places[ref]))))
    if rows:
        types = (pa.int32(), pa.bool_(), *[pa.binary()] * 6)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], PACKED.replace(",", "").split()[::2])


def unpacked(batches: list[pa.RecordBatch]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of a shard (hashes, checks, docs, places) sorted by hash, check and document; and of what is known (hashes, docs, ref_docs, ref_places)."""
    got: dict[bool, list[list[np.ndarray]]] = {known: [[np.zeros(0, t)] for t in BLOBS] for known in (False, True)}
    for batch in batches:
        for known, *blobs in zip(*(batch.column(i).to_pylist() for i in range(1, 8)), strict=True):
            for held, blob, t in zip(got[known], blobs, BLOBS, strict=True):
                held.append(from_blob(blob, t))
    open_, settled = ([np.concatenate(x) for x in got[known]] for known in (False, True))
    order = np.lexsort((open_[2], open_[1], open_[0]))
    return [x[order] for x in open_[:4]], [settled[i] for i in (0, 2, 4, 5)]


def to_shards(sent: DataFrame, n: int) -> DataFrame:
    return sent.repartition(n, "shard").sortWithinPartitions("shard")


def documents_of(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    ids = batch.column(0)
    valid = np.asarray(ids.is_valid())
    return np.asarray(ids.fill_null(0)), [t or b"" for t in batch.column(1).to_pylist()], valid


def shared_seeds(docs: DataFrame, block: int, seed: int) -> DataFrame:
    """(doc_id, seeds): of each document the minimizers that another document holds as well."""
    n = shuffle_parts(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, valid = documents_of(batch)
            h, d = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for a, b in parts(texts):
                w = Words(texts[a:b])
                _, place, g = minimizers(w, block, seed)
                place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
                place = place[valid[a + w.doc[place]]]
                h.append(g[place])
                d.append(ids[a + w.doc[place]])
            h, d = np.concatenate(h), np.concatenate(d)
            yield from packed(h, np.zeros(len(h), np.uint32), d, np.zeros(len(h), np.int64), n * SHARDS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in by_key(batches):
            (hashes, _, docs, _), settled = unpacked(own)
            first, size = runs(hashes)
            keep = np.repeat(docs[first] != docs[first + size - 1], size)
            for h, d in ((hashes[keep], docs[keep]), settled[:2]):
                for a in range(0, len(h), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(d[a : a + (1 << 18)]), pa.array(h[a : a + (1 << 18)].view(np.int64))], ["doc_id", "seed"])

    sent = to_shards(docs.mapInArrow(send, PACKED), n)
    return sent.mapInArrow(meet, "doc_id bigint, seed bigint").groupBy("doc_id").agg(F.collect_list("seed").alias("seeds"))


def duplicates(docs: DataFrame, seeds: DataFrame, block: int, seed: int) -> DataFrame:
    """(doc_id, found): the blocks of each document that a smaller one holds, with the smallest such and the place in it."""
    n = shuffle_parts(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            ids, texts, _ = documents_of(batch)
            h, c, d, p = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in parts(texts):
                w = Words(texts[a:b])
                start, place, g = minimizers(w, block, seed)
                if not len(start):
                    continue
                keep = np.zeros(len(start), bool)
                cut = np.searchsorted(start, w.first)
                for i in range(b - a):
                    own = slice(cut[i], cut[i + 1])
                    keep[own] = np.isin(g[place[own]].view(np.int64), batch.column(2)[a + i].values.to_numpy(zero_copy_only=False))
                at = start[keep]
                h.append(w.grams(block)[at])
                c.append((w.grams(block, check=True)[at] >> np.uint64(32)).astype(np.uint32))
                d.append(ids[a + w.doc[at]])
                p.append(at - w.first[w.doc[at]])
            yield from packed(*map(np.concatenate, (h, c, d, p)), n * SHARDS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in by_key(batches):
            (hashes, checks, docs, places), settled = unpacked(own)
            lead = np.repeat(*runs(hashes, checks))
            late = np.flatnonzero(docs > docs[lead])
            for h, d, ref, at in ((hashes[late], docs[late], docs[lead[late]], places[lead[late]]), settled):
                for a in range(0, len(h), 1 << 17):
                    k = slice(a, a + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[k], h[k].view(np.int64), ref[k], at[k])], ["doc_id", "block", "ref_doc", "ref_place"])

    sent = docs.join(seeds, "doc_id", "left").select("doc_id", "text", "seeds").mapInArrow(send, PACKED)
    met = to_shards(sent, n).mapInArrow(meet, "doc_id bigint, block bigint, ref_doc bigint, ref_place int")
    return met.groupBy("doc_id").agg(F.collect_list(F.struct("block", "ref_doc", "ref_place")).alias("found"))


def factors(blocks: np.ndarray, found: pa.StructArray, block: int) -> list[dict]:
    """Greedy parse: blocks has the hash of the block at each place; a factor is a run of blocks that continue one copy."""
    key, doc, place = (found.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    order = np.argsort(key)
    at = np.minimum(np.searchsorted(key[order], blocks), len(key) - 1)
    who = order[at]
    hit = np.flatnonzero(key[who] == blocks)
    doc, place = doc[who[hit]], place[who[hit]]
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (doc[1:] != doc[:-1]) | (np.diff(place) != 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(hit))) + block - 1
    return [{"start": int(hit[i]), "n_words": int(n), "ref_doc": int(doc[i]), "ref_start": int(place[i])} for i, n in zip(first, size, strict=True)]


def dedup_substrings(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, text, factors) for every row of docs; text is the kept words joined by spaces."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = duplicates(docs, shared_seeds(docs, block, seed), block, seed)
    factor = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("ref_doc", pa.int64()), ("ref_start", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            n_words, n_removed, kept, spans = [], [], [], []
            for a, b in parts(texts):
                w = Words(texts[a:b]) if batch.column(2).slice(a, b - a).null_count < b - a else None
                blocks = w.grams(block).view(np.int64) if w else None
                for i in range(a, b):
                    words, of = texts[i].split(), batch.column(2)[i]
                    n = len(words)
                    cuts = factors(blocks[w.first[i - a] : w.first[i - a] + max(0, n - block + 1)], of.values, block) if of.is_valid and n >= block else []
                    stay = np.ones(n, bool)
                    for x in cuts:
                        stay[x["start"] : x["start"] + x["n_words"]] = False
                    n_words.append(n)
                    n_removed.append(n - int(stay.sum()))
                    kept.append(b" ".join(x for x, s in zip(words, stay.tolist(), strict=True) if s) if cuts else b" ".join(words))
                    spans.append(cuts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, factor)], ["doc_id", "n_words", "n_removed", "kept", "factors"]
            )

    out = docs.join(found, "doc_id", "left").select("doc_id", "text", "found").mapInArrow(
        cut, "doc_id bigint, n_words bigint, n_removed bigint, kept binary, factors array<struct<start: bigint, n_words: bigint, ref_doc: bigint, ref_start: bigint>>"
    )
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("text"), "factors")


def op8(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
