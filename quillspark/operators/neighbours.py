"""Nearest vectors by cosine: exactly, in blocks of queries against parts of the rows, and by an index of inverted lists of product-quantised residuals.

Vectors that are null, empty, zero, or hold a null or non-finite component are in no list and have none; vectors of another number of
dimensions than a query's aren't compared with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.named import named
from ..sources.tables import table
from .network import kept

FOUND = "query_id bigint, vec_id bigint, cosine double"
BLOCK = 1 << 14


def sound(rows: DataFrame, *more: Column) -> DataFrame:
    """(vec_id, unit): the vectors that can be compared, at length one, in double precision."""
    e = F.col("embedding").cast("array<double>")
    rows = rows.where("vec_id is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("e"), *more)
    rows = rows.where(F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.withColumn("most", F.array_max(F.transform("e", F.abs))).where("most > 0")  # scaled first: squares must not leave the range
    scaled = F.transform("e", lambda x: x / F.col("most"))
    norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("norm", norm).select("vec_id", F.transform(scaled, lambda x: x / F.col("norm")).alias("unit"), *rows.columns[2:-1])


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length, from its flat values."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def by_size(column: pa.Array) -> Iterator[np.ndarray]:
    """Indices of rows of a list column, a length at a time."""
    size = np.asarray(column.value_lengths())
    for d in np.unique(size):
        yield np.flatnonzero(size == d)


class Best:
    """The k best (value down, id up) of each of n queries, of what has been seen."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.least = np.full(n, -np.inf)
        self.q, self.id, self.value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, q: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        if not len(q):
            return
        q, ids, value = np.concatenate([self.q, q]), np.concatenate([self.id, ids]), np.concatenate([self.value, value])
        order = np.lexsort((ids, -value, q))
        q, ids, value = q[order], ids[order], value[order]
        first = np.searchsorted(q, np.arange(self.n))
        keep = np.arange(len(q)) - first[q] < self.k
        self.q, self.id, self.value = q[keep], ids[keep], value[keep]
        full = np.bincount(self.q, minlength=self.n) == self.k
        last = np.searchsorted(self.q, np.arange(self.n), side="right") - 1
        self.least[full] = self.value[last[full]]

    def search(self, queries: np.ndarray, names: np.ndarray, x: np.ndarray, ids: np.ndarray, at_once: int = 512) -> None:
        """Takes in the products of queries (n, d) with rows x (m, d), by six digits; a query is not its own neighbour."""
        for a in range(0, len(queries), at_once):
            near = np.round(queries[a : a + at_once] @ x.T, 6)
            near[names[a : a + at_once, None] == ids[None, :]] = -np.inf
            floor = self.least[a : a + at_once, None]
            if near.shape[1] > self.k:
                floor = np.maximum(floor, np.partition(near, -self.k, axis=1)[:, -self.k, None])
            q, at = np.nonzero((near >= floor) & (near > -np.inf))
            self.add(a + q, ids[at], near[q, at])

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names[self.q]), pa.array(self.id), pa.array(self.value)], ["query_id", "vec_id", "cosine"])


def _in_place(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """At most BLOCK queries go to where the rows are."""
    got = queries.toPandas().sort_values("vec_id")  # at most BLOCK rows
    sent = rows.sparkSession.sparkContext.broadcast([(g["vec_id"].to_numpy(np.int64), np.stack(g["unit"].to_numpy())) for _, g in got.groupby(got["unit"].map(len))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {q.shape[1]: (names, q, Best(len(names), k)) for names, q in sent.value}
        for batch in batches:
            for at in by_size(batch.column(1)):
                part = batch.take(pa.array(at))
                x = matrix(part.column(1))
                if x.shape[1] in asked:
                    names, q, best = asked[x.shape[1]]
                    best.search(q, names, x, np.asarray(part.column(0)))
        for names, _, best in asked.values():
            yield best.batch(names)

    return rows.mapInArrow(run, FOUND)


def _in_grid(rows: DataFrame, queries: DataFrame, k: int, n_queries: int, block: int) -> DataFrame:
    """Rows are dealt to as many parts, and queries to as many blocks, as tasks need; each pair of a part and a block of one team is one key, whose
    queries are held while its rows stream past. The plan is the same for any number of queries."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = -(-n_queries // block)
    shares = max(1, -(-2 * tasks // blocks))

    def side(df: DataFrame, own: str, other: str, n_own: int, n_other: int, kind: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
        return df.select(F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int").alias(own), every, F.size("unit").alias("dims"), F.lit(kind).alias("kind"), "team", "vec_id", "unit")

    both = side(queries, "block", "part", blocks, shares, 0).unionByName(side(rows, "part", "block", shares, blocks, 1))
    key = ["team", "block", "part", "dims"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, best = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in (*key, "kind")], 1).astype(np.int64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                part, here = batch.slice(a, b - a), tuple(keys[a, :4])
                x, ids = matrix(part.column("unit")), np.asarray(part.column("vec_id"))
                if here != now:
                    if best is not None:
                        yield best.batch(names)
                    now, held, best = here, [], None
                if keys[a, 4] == 0:
                    held.append((ids, x))
                elif held:
                    if best is None:
                        names, q = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                        best = Best(len(names), k)
                    best.search(q, names, x, ids)
        if best is not None:
            yield best.batch(names)

    return both.repartition(max(tasks, blocks * shares), *key).sortWithinPartitions(*key, "kind").mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k nearest of rows for each query, exactly, to six digits; both are (vec_id, embedding). Up to
    `block` queries are broadcast; more are dealt out in blocks, through no driver. Either way a task keeps k a query."""
    rows, queries = sound(rows), sound(queries)
    n = queries.count()
    if n <= block:
        return _ranked(_in_place(rows, queries, k), k)
    team = F.lit(0).cast("bigint").alias("team")
    return _ranked(_in_grid(rows.select("*", team), kept(queries.select("*", team)), k, n, block), k)


def nearest_within(rows: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """As nearest(), of (team, vec_id, embedding): a query meets the rows of its team only, and may be in several teams, once each."""
    team = F.col("team").cast("bigint").alias("team")
    rows, queries = (sound(df.where("team is not null"), team) for df in (rows, queries))
    queries = kept(queries)
    n = queries.groupBy("team").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    return _ranked(_in_grid(rows, queries, k, n, block), k)


@dataclass
class Codebooks:
    """Centres of cells, and of the parts of residuals; probes is how many cells a query visits."""

    cells: np.ndarray
    parts: np.ndarray  # (parts, codes, dims of a part)
    probes: int

    def nearest_cells(self, x: np.ndarray, n: int) -> np.ndarray:
        far = (self.cells**2).sum(1) - 2 * x @ self.cells.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = self.nearest_cells(x, 1)[:, 0]
        rest = (x - self.cells[cell]).reshape(len(x), len(self.parts), -1)
        code = [((c**2).sum(1) - 2 * rest[:, i] @ c.T).argmin(1) for i, c in enumerate(self.parts)]
        return cell, np.stack(code, 1).astype(np.uint8)

    def decoded(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """Products of queries with these are the asymmetric distances: the query is whole, the row is its codes."""
        return self.cells[cell] + np.concatenate([c[codes[:, i]] for i, c in enumerate(self.parts)], 1)


def means(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of at most n groups of rows; one left empty moves to the row that is farthest from its centre."""
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        far = (c**2).sum(1) - 2 * x @ c.T
        own = far.argmin(1)
        size = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        some = np.flatnonzero(size)
        c[some] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(size)])[some]) / size[some, None]
        empty = np.flatnonzero(size == 0)
        c[empty] = x[np.argsort(-(far.min(1) + (x**2).sum(1)), kind="stable")[: len(empty)]]
    return c


def learnt(x: np.ndarray, n_rows: int, k: int, target: float, part: int = 4) -> Codebooks:
    """Codebooks of a sample of unit vectors. Cells grow with the root of the rows, up to 2048 and an eighth of the sample; as many are visited as hold
    `target` of the sample's true k nearest, by cells of the sample's own rows."""
    rng = np.random.default_rng(17)
    cells = means(x, int(min(2048, max(1, len(x) // 8), max(1, np.sqrt(n_rows)))), rng)
    own = ((cells**2).sum(1) - 2 * x @ cells.T).argmin(1)
    rest = x - cells[own]
    size = next(s for s in (part, 3, 2, 1) if x.shape[1] % s == 0)
    books = [means(rest[:, i : i + size], 256, rng) for i in range(0, x.shape[1], size)]
    most = max(len(b) for b in books)
    found = Codebooks(cells, np.stack([np.concatenate([b, np.repeat(b[:1], most - len(b), 0)]) for b in books]), 1)
    asked = rng.choice(len(x), min(len(x), 1000), replace=False)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if true.size:
        turn = np.argsort(found.nearest_cells(x[asked], len(cells)), axis=1)  # at which turn a query visits each cell
        found.probes = int(np.quantile(np.take_along_axis(turn, own[true], 1), target, method="higher")) + 1
    return found


class Index:
    """Inverted lists of product-quantised residuals over (vec_id, embedding) of one number of dimensions, as tables: codebooks, lists and vectors."""

    def __init__(self, rows: DataFrame, k: int = 10, target: float = 0.98, sample: int = 20_000, tile: int = 1 << 16):
        """Codebooks are learnt on `sample` vectors at most, the first by a hash of their id; every row is in a list."""
        spark = rows.sparkSession
        self.vectors = kept(sound(rows))
        self.n, self.tile = self.vectors.count(), tile
        few = self.vectors.orderBy(F.xxhash64(F.lit(29), F.col("vec_id")), "vec_id").limit(sample).select("unit").toPandas()["unit"]
        self.books = learnt(np.stack(few.to_numpy()), self.n, k, target) if len(few) else None
        if self.books is None:
            return
        sent = spark.sparkContext.broadcast(self.books)
        self.sent = sent

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, codes = sent.value.encoded(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "cell", "codes"])

        self.lists = kept(self.vectors.mapInArrow(assign, "vec_id bigint, cell int, codes binary").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "vec_id"))
        self.codebooks = spark.createDataFrame(
            [("cell", 0, i, c.tolist()) for i, c in enumerate(self.books.cells)] + [("part", i, j, c.tolist()) for i, b in enumerate(self.books.parts) for j, c in enumerate(b)], "kind string, part int, code int, centre array<double>"
        )

    def search(self, queries: DataFrame, k: int, pool: int = 100, block: int = 4096) -> DataFrame:
        """(query_id, vec_id, cosine, rank): each query's `pool` best by its visited lists' codes, then the k best of these by their vectors.

        A list goes by tiles of at most about `tile` rows, and a tile meets its queries by at most about `block`, so neither a list that
        holds much of the table nor one that every query visits is one task's."""
        spark, sent = self.vectors.sparkSession, getattr(self, "sent", None)
        if sent is None:
            return spark.createDataFrame([], f"{FOUND}, rank int")
        dims, probes = self.books.cells.shape[1], self.books.probes
        asked = kept(sound(queries).where(F.size("unit") == dims))

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = sent.value.nearest_cells(matrix(batch.column(1)), probes)
                at = np.repeat(np.arange(len(cells)), cells.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cells.ravel().astype(np.int32)), batch.column(1).take(pa.array(at))], ["vec_id", "cell", "unit"])

        visits = kept(asked.mapInArrow(visit, "vec_id bigint, cell int, unit array<double>"))
        many = lambda df, size: df.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("n"))
        plan = many(self.lists, self.tile).withColumnRenamed("n", "tiles").join(many(visits, block).withColumnRenamed("n", "blocks"), "cell")
        plan = F.broadcast(plan)  # a row a cell, 2048 at most
        own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        none = F.lit(None)
        left = visits.join(plan, "cell").select("cell", own("blocks").alias("block"), every("tiles").alias("tile"), F.lit(0).alias("kind"), "vec_id", "unit", none.cast("binary").alias("codes"))
        right = self.lists.join(plan, "cell").select("cell", every("blocks").alias("block"), own("tiles").alias("tile"), F.lit(1).alias("kind"), "vec_id", none.cast("array<double>").alias("unit"), "codes")
        key = ["cell", "tile", "block"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, best = None, [], None
            for batch in batches:
                keys = np.stack([np.asarray(batch.column(c)) for c in (*key, "kind")], 1).astype(np.int64)
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if b == a:
                        continue
                    part, here = batch.slice(a, b - a), tuple(keys[a, :3])
                    if here != now:
                        if best is not None:
                            yield best.batch(names)
                        now, held, best = here, [], None
                    ids = np.asarray(part.column("vec_id"))
                    if keys[a, 3] == 0:
                        held.append((ids, matrix(part.column("unit"))))
                    elif held:
                        if best is None:
                            names, q = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                            best = Best(len(names), pool)
                        codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(len(part), -1)
                        best.search(q, names, sent.value.decoded(int(keys[a, 0]), codes), ids)
            if best is not None:
                yield best.batch(names)

        both = left.unionByName(right).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, "kind")
        found = both.mapInArrow(run, FOUND)
        rank = lambda: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
        found = kept(found.withColumn("rank", rank()).where(F.col("rank") <= pool).select("query_id", "vec_id"))
        dot = F.aggregate(F.zip_with("unit", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        whole = found.join(self.vectors, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("unit").alias("q")), "query_id")
        return whole.select("query_id", "vec_id", F.round(dot, 6).alias("cosine")).withColumn("rank", rank()).where(F.col("rank") <= k)


@named("retrieve_approximate")
def retrieve_approximate(spark, folder):
    """The ten nearest of every twentieth vector by the index (VEC2). No SQL: what it may miss depends on the codebooks; a test measures its recall."""
    rows = table(spark, folder, "embeddings")
    return Index(rows).search(rows.where("vec_id % 20 = 0"), 10)


_NEXT = """p as (select vec_id, vec_id // 8 as paper, embedding::double[] as e, row_number() over (partition by vec_id // 8 order by vec_id) as chunk from embeddings),
    m as (select paper, i, avg(x) as x from (select paper, unnest(e) as x, generate_subscripts(e, 1) as i from p where chunk <= 5 and paper % 4 = 0) group by all), q as (select paper, list(x order by i) as q from m group by paper),
    n as (select q.paper, p.vec_id, p.paper as other, round(list_cosine_similarity(q, e), 6) as cosine from q, p),
    k as (select * from (select *, row_number() over (partition by paper order by cosine desc, vec_id) as r from n) where r <= 15),
    o as (select paper, other, min(r) as r from k where other <> paper group by all)"""


@named("retrieve_papers", f"with {_NEXT} select paper, other, rank::int as rank from (select *, row_number() over (partition by paper order by r) as rank from o) where rank <= 10")
def retrieve_papers(spark, folder):
    """Papers beside a paper (VEC29): the mean of its first five chunks, the fifteen nearest chunks, the papers of these in order, at most ten. Eight
    vectors that follow each other are a paper; every fourth asks."""
    rows = table(spark, folder, "embeddings").withColumn("paper", F.expr("vec_id div 8"))
    first = rows.where("paper % 4 = 0").withColumn("chunk", F.row_number().over(Window.partitionBy("paper").orderBy("vec_id"))).where("chunk <= 5")
    e = first.select("paper", F.posexplode("embedding").alias("i", "x")).groupBy("paper", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = e.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))  # as many entries as dimensions
    asked = mean.select((-1 - F.col("paper")).alias("vec_id"), F.col("p.x").alias("embedding"))
    found = nearest(rows, asked, 15).select((-1 - F.col("query_id")).alias("paper"), F.expr("vec_id div 8").alias("other"), "rank")
    found = found.where("other <> paper").groupBy("paper", "other").agg(F.min("rank").alias("r"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("paper").orderBy("r"))).where("rank <= 10").select("paper", "other", "rank")


_RECOMMENDED = """r as (select vec_id, label, embedding::double[] as e, vec_id % 20 = 0 as read from embeddings),
    reader as (select vec_id as seed, vec_id // 200 as reader, label, e, row_number() over (partition by vec_id // 200 order by vec_id desc) as t from r where read),
    n as (select s.reader, r.vec_id, round(list_cosine_similarity(s.e, r.e), 6) as cosine, row_number() over (partition by s.seed order by round(list_cosine_similarity(s.e, r.e), 6) desc, r.vec_id) as k from reader s, r where s.t <= 3 and s.seed <> r.vec_id),
    near as (select reader, n.vec_id, max(cosine) as score from n join r using (vec_id) where k <= 10 and not r.read group by all),
    known as (select distinct reader, label from reader),
    fresh as (select d.reader, f.vec_id, 0.6 as score from (select distinct reader from reader) d, (select label, min(vec_id) as vec_id from r where not read group by label) f join r using (vec_id)
        where not exists (select 1 from known k where k.reader = d.reader and k.label = r.label)),
    every as (select reader, vec_id, max(score) as score from (select * from near union all select * from fresh) group by all)"""


@named("retrieve_recommended", f"with {_RECOMMENDED} select reader, vec_id, score::double as score, rank::int as rank from (select *, row_number() over (partition by reader order by score desc, vec_id) as rank from every) where rank <= 20")
def retrieve_recommended(spark, folder):
    """What to read next (VEC36): the neighbours of a reader's last three vectors that no one read yet, and at .6 the first unread one of each
    label that the reader never met; the best of either, at most twenty. Every twentieth vector is read, by reader vec_id div 200. Readers meet labels, not vectors."""
    rows = table(spark, folder, "embeddings")
    unread = rows.where("vec_id % 20 <> 0")
    read = rows.where("vec_id % 20 = 0").withColumn("reader", F.expr("vec_id div 200"))
    last = read.withColumn("t", F.row_number().over(Window.partitionBy("reader").orderBy(F.desc("vec_id")))).where("t <= 3")
    near = nearest(rows, last.select("vec_id", "embedding"), 10).where("vec_id % 20 <> 0").select(F.expr("query_id div 200").alias("reader"), "vec_id", F.col("cosine").alias("score"))
    first = unread.where("label is not null").groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    met = read.select("reader", "label").distinct()
    every = near.unionByName(_unmet(met, first).select("reader", "vec_id", F.lit(0.6).alias("score"))).groupBy("reader", "vec_id").agg(F.max("score").alias("score"))
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("reader").orderBy(F.desc("score"), "vec_id"))).where("rank <= 20").select("reader", "vec_id", "score", "rank")


def _unmet(met: DataFrame, first: DataFrame) -> DataFrame:
    """(reader, vec_id): the first twenty unread vectors, by id, of labels that a reader never met. As many labels as a reader met, and twenty more, will do."""
    most = met.groupBy("reader").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    early = first.orderBy("vec_id").limit(most + 20).agg(F.collect_list(F.struct("label", "vec_id")).alias("early"))
    readers = met.groupBy("reader").agg(F.collect_set("label").alias("labels"))
    return readers.join(F.broadcast(early), F.lit(True)).select("reader", F.explode(F.filter("early", lambda x: ~F.array_contains("labels", x["label"]))).alias("x")).select("reader", "x.vec_id")
