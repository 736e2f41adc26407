"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut in two halves, each half has a codebook of its own, and the pairs of codewords form a grid of cells.
Every vector lives in the cell of its nearest codewords. Two unit vectors of cosine c are delta = sqrt(2 - 2c) apart, and a
neighbour's half lies beyond the plane between two codewords only if the vector's half is near the plane: the step along
the plane's normal is about normal, with deviation delta / sqrt(dimensions). The multi-sequence traversal takes the codewords
of either half by squared plane distance and visits the cells by the sum, until the distance of the normal quantile of the
target recall is used up; its front moves for all vectors of a batch at once. Cosines of the vector and all vectors that live
in a visited cell, with the same label, decide in double precision. A link that only one side visits counts for both. Tests
hold the recall against brute force.

Codebooks grow with the square root of the table and are fitted to a sample of at most `sample` distinct vectors, the smallest by
a hash; a codebook has at most an eighth as many words as the sample has vectors. All distinct vectors of a label enter once with
their count; vectors are told apart by two 64-bit hashes, so only these travel when results come back to the rows. A vector
travels once, as it is in the table, to each first codeword it visits, with the second codewords. First codewords with over `tile`
vectors, at home or visiting, are cut in tiles, and each pair of tiles is a group of its own. From a group go link counts and
the links that join parts, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link
with nothing and are their own component; vectors of different length do not link; a null vec_id has no component; rows of
one vec_id count as separate vectors; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import by_key, components, shuffle_parts, table, written

COSINE = 0.98
SAMPLE = 20_000
RECALL = 0.997
TILE = 4_000


class Book:
    """Codewords of one half and the distances between them."""

    def __init__(self, rows: np.ndarray, k: int, rounds: int = 8):
        rng = np.random.default_rng(3)
        words = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
        for _ in range(rounds):
            near = (rows @ words.T - 0.5 * (words**2).sum(1)).argmax(1)
            n = np.bincount(near, minlength=len(words))
            order = np.argsort(near, kind="stable")
            own = np.flatnonzero(n)
            words[own] = np.add.reduceat(rows[order], (np.cumsum(n) - n)[own], axis=0) / n[own, None]
        self.words = np.unique(words, axis=0)
        square = (self.words**2).sum(1)
        self.gap = np.sqrt(np.maximum(square[:, None] + square - 2 * self.words @ self.words.T, 1e-30))

    def planes(self, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home, squared distance to the plane between home and each codeword; 0 for home itself)."""
        d = (half**2).sum(1)[:, None] + (self.words**2).sum(1) - 2 * half @ self.words.T
        home = d.argmin(1)
        at = np.arange(len(half))
        away = np.maximum(d - d[at, home][:, None], 0) / (2 * self.gap[home])
        away[at, home] = 0
        return home, away**2

    def plane(self, half: np.ndarray, home: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The same for one codeword a row."""
        d = ((half - self.words[word]) ** 2).sum(1) - ((half - self.words[home]) ** 2).sum(1)
        return np.where(home == word, 0, np.maximum(d, 0) / (2 * self.gap[home, word])) ** 2


def reach(cosine: float, recall: float, size: int) -> float:
    """Squared plane distance within which cells are visited."""
    z = NormalDist().inv_cdf((1 + min(recall, 1 - 1e-12)) / 2)
    return (2 - 2 * cosine) * min(1.0, z * z / size) + 1e-12


def traversal(one: np.ndarray, two: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Multi-sequence traversal of all rows at once: (rows, first codeword of each, second codewords by distance, how many of these are visited)."""
    most = [max(1, int((x <= radius).sum(1).max(initial=0))) for x in (one, two)]
    near = [np.argpartition(x, m - 1, axis=1)[:, :m] for x, m in zip((one, two), most, strict=True)]
    a, b = (np.take_along_axis(n, np.argsort(np.take_along_axis(x, n, 1), axis=1, kind="stable"), 1) for n, x in zip(near, (one, two), strict=True))
    da, db = np.take_along_axis(one, a, 1), np.take_along_axis(two, b, 1)
    for step in range(most[0]):
        n = (da[:, step, None] + db <= radius).sum(1)
        rows = np.flatnonzero(n)
        if not len(rows):
            break
        yield rows, a[rows, step], b[rows], n[rows]


def units(raw: np.ndarray) -> np.ndarray:
    unit = raw.astype(np.float64)
    unit /= np.abs(unit).max(1)[:, None]
    return unit / np.sqrt((unit**2).sum(1))[:, None]


def by_size(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each length."""
    size, flat = np.asarray(vectors.value_lengths()), np.asarray(vectors.flatten())
    first = np.cumsum(size) - size
    for n in np.unique(size).tolist():
        of = np.flatnonzero(size == n)
        yield of, flat[first[of, None] + np.arange(n)]


def spread(groups: DataFrame, books: dict[int, tuple[Book, Book]], cosine: float, recall: float) -> DataFrame:
    """A row for each first codeword that a vector visits: home is its own second codeword, or -1 where it does not live; visits the second codewords it visits."""
    schema = "label string, size int, code int, home int, visits binary, rep bigint, n bigint, own_code int, own_home int, raw binary"
    names = schema.replace(",", "").split()[::2]
    sent = groups.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                for of, raw in by_size(part.column(1)):
                    size, unit = raw.shape[1], units(raw)
                    label, rep, n = (part.column(i).take(pa.array(of)) for i in (0, 2, 3))
                    blobs = pa.array([x.tobytes() for x in raw], pa.binary())
                    zero = np.zeros(len(of), np.int64)
                    if size in sent.value:
                        one, two = sent.value[size]
                        (h1, d1), (h2, d2) = one.planes(unit[:, : size // 2]), two.planes(unit[:, size // 2 :])
                        steps = traversal(d1, d2, reach(cosine, recall, size))
                    else:
                        h1 = h2 = zero
                        steps = iter([(zero.cumsum() + np.arange(len(of)), zero, zero[:, None], zero + 1)])
                    for rows, code, second, count in steps:
                        home = np.where(code == h1[rows], h2[rows], -1)
                        visits = [s[:c].tobytes() for s, c in zip(second.astype(np.int32), count.tolist(), strict=True)]
                        k = pa.array(rows)
                        ints = [pa.array(x.astype(np.int32)) for x in (code, home, h1[rows], h2[rows])]
                        yield pa.RecordBatch.from_arrays(
                            [label.take(k), pa.array(np.full(len(rows), size, np.int32)), ints[0], ints[1], pa.array(visits, pa.binary()), rep.take(k), n.take(k), ints[2], ints[3], blobs.take(k)], names
                        )

    return groups.select("label", "vector", "rep", "n").mapInArrow(run, schema)


def compare(home: np.ndarray, visits: list[np.ndarray], rep: np.ndarray, n: np.ndarray, own: np.ndarray, unit: np.ndarray, books: tuple[Book, Book] | None, cosine: float, radius: float, most: int = 1024) -> tuple[np.ndarray, list]:
    """One group: linked rows of each row, as far as this group tells them; and (a, b) links that connect what the group's links connect."""
    counts, edges, half = np.zeros(len(home), np.int64), [], unit.shape[1] // 2
    lives = np.flatnonzero(home >= 0)
    lives = lives[np.argsort(home[lives], kind="stable")]
    who = np.repeat(np.arange(len(home)), [len(v) for v in visits])
    cell = np.concatenate(visits) if len(who) else np.zeros(0, np.int32)
    order = np.argsort(cell, kind="stable")
    who, cell = who[order], cell[order]
    cells = np.unique(home[lives])
    lo, hi = np.searchsorted(home[lives], cells, "left"), np.searchsorted(home[lives], cells, "right")
    vlo, vhi = np.searchsorted(cell, cells, "left"), np.searchsorted(cell, cells, "right")
    for a0, a1, b0, b1 in zip(vlo.tolist(), vhi.tolist(), lo.tolist(), hi.tolist(), strict=True):
        for a in range(a0, a1, most):
            va = who[a : min(a1, a + most)]
            for b in range(b0, b1, most):
                hb = lives[b : min(b1, b + most)]
                close = (unit[va] @ unit[hb].T >= cosine) & (rep[va][:, None] != rep[hb])
                x, y = np.nonzero(close)
                if not len(x):
                    continue
                np.add.at(counts, va, close @ n[hb])
                if books is not None:  # those at home that do not visit the visitor's cell
                    v, h = va[x], hb[y]
                    away = books[0].plane(unit[h, :half], own[h, 0], own[v, 0]) + books[1].plane(unit[h, half:], own[h, 1], own[v, 1])
                    missed = away > radius
                    np.add.at(counts, h[missed], n[v[missed]])
                low_v, low_h = rep[va].copy(), rep[hb].copy()
                while True:  # smallest reachable within the block
                    before = low_v.sum(), low_h.sum()
                    np.minimum.at(low_h, y, low_v[x])
                    np.minimum.at(low_v, x, low_h[y])
                    if before == (low_v.sum(), low_h.sum()):
                        break
                edges += [(rep[va], low_v), (rep[hb], low_h)]
    return counts, edges


def met(sent: DataFrame, books: dict, cosine: float, recall: float, tile: int, single: bool) -> DataFrame:
    """(a, b, n): links have b, counts have n. Of a large group's rows those at home meet visitors tile by tile."""
    spark = sent.sparkSession
    parts, key = shuffle_parts(spark), ["label", "size", "code"]
    crowded = written(sent.groupBy(*key).count().where(F.col("count") > tile), "crowded")
    if crowded.isEmpty():
        sent = sent.withColumn("part", F.lit(0))
    else:
        tiles = F.ceil(F.coalesce("count", F.lit(1)) / tile).cast("int")
        sent = sent.join(crowded, key, "left").withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
        here, other, many = F.col("own"), F.col("other"), F.col("tiles")
        sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        role = lambda at, home, visits: F.struct(at.alias("part"), home.alias("home"), visits.alias("visits"))
        lives, comes = role(here * many + other, F.col("home"), F.lit(b"")), role(other * many + here, F.lit(-1), F.col("visits"))
        both = F.when(here == other, F.array(role(here * many + here, F.col("home"), F.col("visits")))).when(F.col("home") >= 0, F.array(lives, comes)).otherwise(F.array(comes))
        sent = sent.withColumn("as", F.explode(both)).select(*key, "as.home", "as.visits", "rep", "n", "own_code", "own_home", "raw", "as.part")
    group = F.xxhash64(*key, "part").alias("cell_group")
    dealt = sent.select(group, *key, "part", "home", "visits", "rep", "n", "own_code", "own_home", "raw").repartition(parts, "cell_group").sortWithinPartitions("cell_group", *key, "part")
    books_sent = spark.sparkContext.broadcast(books)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for _, held in by_key(batches):
            t = pa.Table.from_batches(held)
            if len(t) > 1 and len(t.group_by([*key, "part"]).aggregate([])) > 1:  # two keys of one hash
                keys = t.group_by([*key, "part"]).aggregate([]).to_pylist()
                yield from (t.filter(pa.array([r == k for r in t.select([*key, "part"]).to_pylist()])) for k in keys)
            else:
                yield t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            home = t["home"].to_numpy()
            if len(home) < 2 or (home < 0).all():
                continue
            size = t["size"][0].as_py()
            unit = units(np.frombuffer(b"".join(t["raw"].to_pylist()), np.float32 if single else np.float64).reshape(len(home), -1))
            visits = [np.frombuffer(v, np.int32) for v in t["visits"].to_pylist()]
            own = np.stack([t["own_code"].to_numpy(), t["own_home"].to_numpy()], 1)
            rep = t["rep"].to_numpy()
            counts, edges = compare(home, visits, rep, t["n"].to_numpy(), own, unit, books_sent.value.get(size), cosine, reach(cosine, recall, size))
            some = counts > 0
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(counts[some])], ["a", "b", "n"])
            for a, b in edges:
                off = a != b
                yield pa.RecordBatch.from_arrays([pa.array(a[off]), pa.array(b[off]), pa.nulls(int(off.sum()), pa.int64())], ["a", "b", "n"])

    return dealt.mapInArrow(run, "a bigint, b bigint, n bigint")


def dedup_vectors(rows: DataFrame, cosine: float = COSINE, codewords: int | None = None, sample: int = SAMPLE, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of rows (vec_id, embedding, label)."""
    single = isinstance(rows.schema["embedding"].dataType.elementType, FloatType)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine, F.lit(False))
    one_zero = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0)).otherwise(x))
    vector = one_zero.cast(f"array<{'float' if single else 'double'}>")
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), usable.alias("usable"), vector.alias("vector"))
    key = ["label", "h1", "h2"]
    named = named.select("vec_id", "label", "usable", F.when(F.col("usable"), F.xxhash64("vector")).alias("h1"), F.when(F.col("usable"), F.xxhash64(F.lit("second"), "vector")).alias("h2"), "vector")
    groups = written(named.where("usable").groupBy(*key).agg(F.first("vector").alias("vector"), F.min("vec_id").alias("rep"), F.count("vec_id").alias("n")), "vectors")
    taken = groups.select("vector", "h1", "h2").orderBy("h1", "h2").limit(sample).select("vector").toArrow()
    k = codewords or int(min(max(4, sample // 8), max(4, (groups.count() / 100) ** 0.5)))
    books = {}
    if len(taken):
        for _, raw in by_size(taken["vector"].combine_chunks()):
            size = raw.shape[1]
            if size >= 2:
                unit = units(raw)
                books[size] = Book(unit[:, : size // 2], k), Book(unit[:, size // 2 :], k)
    found = written(met(spread(groups, books, cosine, recall), books, cosine, recall, tile, single), "met")
    linked = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("others"))
    joined = components(found.where("b is not null").select("a", "b"))
    ids = groups.select(*[F.col(c).alias(f"g_{c}") for c in key], "rep", "n")
    classes = ids.join(linked, ids.rep == linked.a, "left").join(joined, ids.rep == joined.node, "left")
    classes = classes.select("g_label", "g_h1", "g_h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    same = (F.col("label") == F.col("g_label")) & (F.col("h1") == F.col("g_h1")) & (F.col("h2") == F.col("g_h2"))
    out = named.select("vec_id", *key).join(classes, same, "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op10(spark, sf_dir: str) -> DataFrame:
    return dedup_vectors(table(spark, sf_dir, "embeddings"))
