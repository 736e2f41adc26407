"""Line dedup that can be undone: cuckoo filters by shard, backed by exact reference counts.

The state is four tables in a folder, each kept as changes by version. `added` has a row for each (key digest, doc_id) that a
version brought, and `gone` the doc_ids that it deleted. `counts` has, for each digest that a version touched, the exact number of
documents and the largest doc_id that hold it; `filters` has, for each shard of digests that a version changed, a cuckoo
filter of the digests that enough documents hold to be dropped. A change counts anew just the digests it touches, from the
postings that hold them, and puts into or takes out of the filters just those whose count crosses the threshold, which is
what cuckoo filters allow and Bloom filters do not. Earlier versions stay readable.

A line's key is the line without [\\x20\\x09-\\x0D] at its ends and with A-Z lowered; its digest is two XXH64 of the key with
different seeds, 128 bits. A filter answers at once for most lines that they stay; what it passes is settled by the
exact counts. Filters go to all tasks only while their summed size is at most `broadcast_bytes`; beyond that postings are
dealt to the filters: by shard, a shard's in several parts, each with the shard's filter in front, so a task holds one filter.

Defined results: a null or empty text is one empty line; rows of one doc_id are one document, but keep their own lines; a null
doc_id counts as one document, and is never the largest; deleting what is not held, from an empty index too, changes nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, carried, new_path, shuffle_parts, table, written

MIN_CHARS = 20
MIN_DOCS = 3
BROADCAST_BYTES = 16 << 20
ENDS = "\x09\x0a\x0b\x0c\x0d\x20"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALT = "second"
SPREAD = 8  # parts of a shard where filters are not sent to all


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; each key has two buckets. Built and probed over arrays of two 64-bit hashes."""

    SLOTS = 4

    def __init__(self, n_keys: int):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(1, n_keys) / (self.SLOTS * 0.85)))))
        self.slots = np.zeros((self.buckets, self.SLOTS), np.uint16)

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (h2.astype(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (h1.astype(np.uint64) >> np.uint64(20)).astype(np.int64) & (self.buckets - 1)
        return mark, one, self._other(one, mark)

    def _other(self, place, mark):
        return place ^ ((np.asarray(mark).astype(np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """Whether all keys found a place; if not, the filter must be made anew, larger."""
        rng = np.random.default_rng(5)
        mark, place, _ = self._places(h1, h2)
        todo = list(zip(mark.tolist(), place.tolist(), strict=True))
        for m, p in todo:
            for at in (p, int(self._other(p, m))):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = m
                    break
            else:
                for _ in range(500):
                    k = int(rng.integers(self.SLOTS))
                    m, self.slots[at, k] = int(self.slots[at, k]), m
                    at = int(self._other(at, m))
                    free = np.flatnonzero(self.slots[at] == 0)
                    if len(free):
                        self.slots[at, free[0]] = m
                        break
                else:
                    return False
        return True

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Keys must have been inserted before."""
        mark, one, two = self._places(h1, h2)
        for m, p, q in zip(mark.tolist(), one.tolist(), two.tolist(), strict=True):
            for at in (p, q):
                held = np.flatnonzero(self.slots[at] == m)
                if len(held):
                    self.slots[at, held[0]] = 0
                    break

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(h1, h2)
        return (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        new = cls(1)
        new.slots = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        new.buckets = len(new.slots)
        return new


def filled(h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
    room = len(h1)
    while not (made := CuckooFilter(room)).insert(h1, h2):
        room = room * 2 + 8
    return made


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(ENDS)), UPPER, LOWER)


def digest_of(line: Column, min_chars: int) -> Column:
    """Struct of the two hashes of a line's key; null if the key is too short to count."""
    key = key_of(line)
    return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(SALT), key).alias("h2")))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id), once for each digest and row of docs."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), lambda x: digest_of(x, min_chars)), lambda d: d.isNotNull()))
    return docs.select("doc_id", F.explode(keys).alias("d")).select("d.h1", "d.h2", "doc_id")


def counts(found: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, last_doc) of postings that may repeat."""
    return found.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("x")).groupBy("h1", "h2").agg(F.count("x").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def shard_of(n: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(n)).cast("int")


class LineIndex:
    """The state in `folder`: insert(), delete(), drops(). Each change writes a version; `at` can be set back to an earlier one to read it."""

    def __init__(self, spark: SparkSession, folder: str | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None):
        self.spark, self.folder = spark, folder or new_path(spark, "lines")
        self.min_chars, self.min_docs, self.shards = min_chars, min_docs, shards or shuffle_parts(spark)
        self.version = 0
        self.inserted: list[int] = []
        self.deleted: list[int] = []

    def _path(self, name: str, version: int) -> str:
        return f"{self.folder}/{name}/{version}"

    def _read(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(self._path(name, version))

    def _latest(self, name: str, key: list[str]) -> DataFrame | None:
        """The last change of each key."""
        if not self.version:
            return None
        if self.version == 1:
            return self._read(name, 1)
        every = reduce(DataFrame.unionByName, (self._read(name, v).withColumn("version", F.lit(v)) for v in range(1, self.version + 1)))
        rest = [c for c in every.columns if c not in (*key, "version")]
        return every.groupBy(*key).agg(F.max_by(F.struct(*rest), "version").alias("last")).select(*key, "last.*")

    def postings(self) -> DataFrame | None:
        """(h1, h2, doc_id) of what was inserted and not deleted since; may repeat where a document was inserted twice."""
        found = []
        for v in (x for x in self.inserted if x <= self.version):
            rows = self._read("added", v)
            later = [self._read("gone", w) for w in self.deleted if v < w <= self.version]
            if later:
                gone = reduce(DataFrame.unionAll, later).distinct().withColumnRenamed("doc_id", "gone_id")
                rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
            found.append(rows)
        return reduce(DataFrame.unionAll, found) if found else None

    def counts(self) -> DataFrame | None:
        found = self._latest("counts", ["h1", "h2"])
        return found if found is None or self.version == 1 else found.where("n_docs > 0")

    def filters(self) -> DataFrame | None:
        return self._latest("filters", ["shard"])

    def insert(self, docs: DataFrame) -> LineIndex:
        old = self.counts()
        postings(docs, self.min_chars).write.parquet(self._path("added", self.version + 1))
        self.inserted.append(self.version + 1)
        return self._changed(old, self._read("added", self.version + 1))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes out all that rows with these doc_id (a table with that column) brought in."""
        held, old = self.postings(), self.counts()
        if held is None:
            return self
        doc_ids.select("doc_id").distinct().write.parquet(self._path("gone", self.version + 1))
        self.deleted.append(self.version + 1)
        gone = self._read("gone", self.version + 1).withColumnRenamed("doc_id", "gone_id")
        return self._changed(old, held.join(gone, held["doc_id"].eqNullSafe(gone["gone_id"]), "left_semi"))

    def _changed(self, old: DataFrame | None, rows: DataFrame) -> LineIndex:
        """Counts and filters of the digests in `rows`, which a new version added or deleted."""
        made = self.filters()
        self.version += 1
        key = ["h1", "h2"]
        if old is None:
            counts(rows).write.parquet(self._path("counts", self.version))
            step = self._read("counts", self.version).where(F.col("n_docs") >= self.min_docs).select(*key, F.lit(1).alias("change"))
        else:
            touched = written(rows.select(*key).distinct(), "touched")
            now = counts(self.postings().join(touched, key, "left_semi"))
            blank = touched.join(now, key, "left").select(*key, F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "last_doc")
            blank.write.parquet(self._path("counts", self.version))
            was = old.join(touched, key, "left_semi").select(*key, F.col("n_docs").alias("was"))
            over, before = F.col("n_docs") >= self.min_docs, F.coalesce("was", F.lit(0)) >= self.min_docs
            step = self._read("counts", self.version).join(was, key, "left").where(over != before).select(*key, F.when(over, 1).otherwise(-1).alias("change"))
        self._filters(step, made).write.parquet(self._path("filters", self.version))
        return self

    def _filters(self, step: DataFrame, made: DataFrame | None) -> DataFrame:
        """The filters of the shards that change. A filter that runs full is made again from the exact counts of its shard."""
        n = self.shards
        rows = step.select(shard_of(n).alias("shard"), F.lit(0).alias("kind"), "h1", "h2", "change", F.lit(None).cast("binary").alias("filter"))
        if made is not None:
            zero, touched = F.lit(0), written(rows.select("shard").distinct(), "shards")
            made = made.join(touched, "shard", "left_semi")
            rows = rows.unionByName(made.select("shard", F.lit(-1).alias("kind"), zero.cast("long").alias("h1"), zero.cast("long").alias("h2"), zero.alias("change"), "filter"))
            all_over = self.counts().where(F.col("n_docs") >= self.min_docs).withColumn("shard", shard_of(n)).join(touched, "shard", "left_semi")
            rows = rows.unionByName(all_over.select("shard", F.lit(1).alias("kind"), "h1", "h2", zero.alias("change"), F.lit(None).cast("binary").alias("filter")))
        dealt = rows.repartition(n, "shard").sortWithinPartitions("shard", "kind")

        def build(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            kind, change = t["kind"].to_numpy(), t["change"].to_numpy()
            h1, h2 = t["h1"].to_numpy(), t["h2"].to_numpy()
            up, down, whole = (kind == 0) & (change == 1), (kind == 0) & (change == -1), kind == 1
            if (kind == -1).any():
                made = CuckooFilter.from_bytes(t["filter"][int(np.flatnonzero(kind == -1)[0])].as_py())
                made.delete(h1[down], h2[down])
                if not made.insert(h1[up], h2[up]):
                    made = filled(h1[whole], h2[whole])
            else:
                made = filled(h1[up], h2[up])
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([made.to_bytes()], pa.binary())], ["shard", "filter"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, got in by_key(batches):
                yield build(shard, got)

        return dealt.mapInArrow(run, "shard int, filter binary")

    def passed(self, found: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """Those of found (h1, h2, doc_id) that the filters let through."""
        filters, n = self.filters(), self.shards
        if (filters.agg(F.sum(F.length("filter"))).first()[0] or 0) > broadcast_bytes:
            return self._passed_by_shard(found, filters)
        sent = self.spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in filters.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = {k: CuckooFilter.from_bytes(v) for k, v in sent.value.items()}
            for batch in batches:
                h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                keep, shard = np.zeros(len(h1), bool), h1 % n
                for k in np.unique(shard).tolist():
                    if k in made:
                        of = np.flatnonzero(shard == k)
                        keep[of] = made[k].contains(h1[of], h2[of])
                yield batch.filter(pa.array(keep))

        return found.mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint")

    def _passed_by_shard(self, found: DataFrame, filters: DataFrame) -> DataFrame:
        """The same with postings brought to their shard's filter. Each shard is dealt in parts by document, as one line may be in a third of all."""
        slot = lambda shard, part: (shard * SPREAD + part).alias("slot")
        rows = found.select(slot(shard_of(self.shards), F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int")), F.lit(1).alias("kind"), "h1", "h2", "doc_id", F.lit(None).cast("binary").alias("filter"))
        zero = F.lit(0).cast("long")
        copies = filters.select("filter", "shard", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
        rows = rows.unionAll(copies.select(slot(F.col("shard"), F.col("part")), F.lit(0), zero, zero, zero, "filter"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, made = None, None
            for batch in batches:
                slots, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero(slots[1:] != slots[:-1]) + 1).tolist(), len(slots)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if b > a and slots[a] != at:
                        at, made = slots[a], None
                    if b > a and kind[a] == 0:
                        made = CuckooFilter.from_bytes(batch.column(5)[a].as_py())
                        a += 1
                    if b > a and made is not None:
                        own = batch.slice(a, b - a)
                        yield own.filter(pa.array(made.contains(own.column(2).to_numpy(), own.column(3).to_numpy()))).select(["h1", "h2", "doc_id"])

        dealt = rows.repartition(self.shards * SPREAD, "slot").sortWithinPartitions("slot", "kind")
        return dealt.mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint")

    def drops(self, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """(doc_id, drops): the digests whose lines each document loses. Documents that lose none are left out."""
        over = self.counts().where(F.col("n_docs") >= self.min_docs)
        hit = self.passed(self.postings().select("h1", "h2", F.col("doc_id").cast("long")), broadcast_bytes).join(over, ["h1", "h2"])
        hit = hit.where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        return hit.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with text cut to the lines that stay, and n_lines and n_dropped."""
    drops = LineIndex(docs.sparkSession, min_chars=min_chars, min_docs=min_docs).insert(docs).drops()
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    both = carried(docs, own, F.col("doc_id").alias("doc"), F.col("text")).join(drops, F.col("doc").eqNullSafe(F.col("doc_id")), "left")
    lines = lines_of(F.col("text"))
    stay = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("drops"), digest_of(x, min_chars)), F.lit(False)))
    both = both.withColumn("stay", F.when(F.col("drops").isNull(), lines).otherwise(stay)).withColumn("n_lines", F.size(lines).cast("long"))
    both = both.withColumn("n_dropped", F.col("n_lines") - F.size("stay"))
    return both.select(*[F.array_join("stay", "\n").alias(c) if c == "text" else F.col("own").getField(c).alias(c) for c in own], "n_lines", "n_dropped")


def op2(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
