"""Closures, components, paths and grids over edge tables. Loops write each round to the shared folder, so plans stay short."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import cosine
from ..plans.named import named
from ..sources.files import removed, scratch
from ..sources.tables import table


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there."""
    return kept_at(df)[0]


def kept_at(df: DataFrame) -> tuple[DataFrame, str]:
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def parts_of(rows: int | DataFrame, lines: int = 250_000) -> int:
    """As many parts as have about so many rows each, so a task's memory doesn't grow with the table; a DataFrame is counted."""
    spark = SparkSession.active() if isinstance(rows, int) else rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows if isinstance(rows, int) else rows.count()) // lines))


class Dealt:
    """A table of the shared folder in `parts` buckets by a key, so that joins on it move the other side only; close() forgets its name."""

    def __init__(self, df: DataFrame, key: str, parts: int):
        self.spark, self.name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
        df.repartition(parts, key).write.option("path", scratch(self.spark)).bucketBy(parts, key).sortBy(key).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"drop table {self.name}")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the least node of each component of (u, v). Alternates two steps: every node hands its least neighbour to
    its greater ones, then to its lesser ones; the edges become stars in rounds that grow with the logarithm of the nodes. A round is
    written once, told from the last by a count and a sum of hashes, and then takes its place. Null nodes and loops are left out."""
    spark = edges.sparkSession
    now, at = kept_at(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(now)
    if not before[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new, new_at = kept_at(small.where("u <> v").distinct())
        removed(spark, at)
        now, at, after = new, new_at, state(new)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before = after
    raise RuntimeError(f"components did not settle in {most} rounds")


#: Whole-graph SQL: every node keeps the least node known to reach it, and hands it on when it changes.
_LINKS = "select distinct 's' || l_suppkey as u, 'p' || l_partkey as v from lineitem"
_COMPONENTS = f"""with recursive e as ({_LINKS}), b as (select u, v from e union select v, u from e), r(node, component) using key (node) as (select u, min(least(u, v)) from b group by u
    union select b.v, min(r.component) from r join b on b.u = r.node join recurring.r o on o.node = b.v where r.component < o.component group by b.v)"""


def _supplied(spark, folder) -> DataFrame:
    """(u, v): suppliers and the parts of their lines, whatever their size or discount."""
    return table(spark, folder, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("u"), F.concat(F.lit("p"), F.col("l_partkey")).alias("v")).distinct()


DIGITS = 15


def code(kind: int, number: Column, digits: int = DIGITS) -> Column:
    """A long in the order of kind and the decimal digits of a number from 0 to below 10^digits: digits from the left, filled up, then how many there are."""
    n = number.cast("long")
    size = F.length(n.cast("string"))
    return (F.lit(kind * 10**digits) + n * _power(digits, size)) * 32 + size


def decoded(c: Column, kinds: str, digits: int = DIGITS) -> Column:
    """The kind's letter and the number of a code()."""
    div = lambda x, y: F.call_function("div", x, y)
    left = div(c, F.lit(32))
    number = div(left % F.lit(10**digits), _power(digits, c.bitwiseAND(31).cast("int")))
    return F.concat(F.element_at(F.array(*map(F.lit, kinds)), (div(left, F.lit(10**digits)) + 1).cast("int")), number.cast("string"))


def _power(digits: int, size: Column) -> Column:
    """What a number of `size` digits is to be multiplied by to have `digits`."""
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(digits)]), F.lit(digits + 1) - size)


def _joined(spark, folder) -> DataFrame:
    """(node, component) of suppliers and parts joined by lines, whose names are numbers in the same order while the components are sought, where they have 15 digits at most."""
    line = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey")
    ends = [x for x in line.agg(*[f(c) for c in line.columns for f in (F.min, F.max)]).first() if x is not None]
    if any(not 0 <= x < 10**DIGITS for x in ends):
        return components(_supplied(spark, folder))
    digits = len(str(max(ends, default=0)))
    found = components(line.select(code(1, F.col("l_suppkey"), digits).alias("u"), code(0, F.col("l_partkey"), digits).alias("v")))
    return found.select(*[decoded(F.col(c), "ps", digits).alias(c) for c in found.columns])


@named("graph_components", f"{_COMPONENTS} select node, component from r")
def graph_components(spark, folder):
    """Suppliers and parts joined by lines."""
    return _joined(spark, folder)


@named("graph_component_sizes", f"{_COMPONENTS} select component, count(*) as n, sum((node like 's%')::int)::bigint as suppliers from r group by component")
def graph_component_sizes(spark, folder):
    c = _joined(spark, folder)
    return c.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.col("node").startswith("s").cast("int")).alias("suppliers"))


def hops(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(node, depth): fewest steps from the nodes of start along (u, v), up to a depth. A round joins only the newest nodes."""
    reached = newest = kept(start.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, most + 1):
        step = newest.join(edges, newest.node == edges.u).select(F.col("v").alias("node")).distinct()
        newest = kept(step.join(reached, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if newest.isEmpty():
            break
        reached = reached.union(newest)
    return reached


@named("graph_hops", """with recursive e as (select distinct 's' || l_suppkey as u, 'p' || l_partkey as v from lineitem), b as (select u, v from e union select v, u from e),
    r(node, depth) as (select 's0', 0 union select b.v, r.depth + 1 from r join b on b.u = r.node where r.depth < 4) select node, min(depth) as depth from r group by node""")
def graph_hops(spark, folder):
    """Fewest steps, at most four, from a seed over suppliers and parts of all lines."""
    e = kept(_supplied(spark, folder))
    return hops(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), spark.range(1).select(F.lit("s0").alias("node")), 4)


@named("graph_descendants", """with recursive e as (select 'r' || n_regionkey as u, 'n' || n_nationkey as v from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders),
    r(top, node, depth) as (select u, v, 1 from e union all select r.top, e.v, r.depth + 1 from r join e on e.u = r.node) select top, count(distinct node) as descendants, max(depth) as depth from r group by top""")
def graph_descendants(spark, folder, most: int = 10):
    """Descendants of every node of a hierarchy and its greatest depth. Rounds carry counts of paths up the edges, not pairs:
    in a tree each descendant is one path."""
    name = lambda prefix, column: F.concat(F.lit(prefix), F.col(column))
    edges = kept(
        table(spark, folder, "nation").select(name("r", "n_regionkey").alias("u"), name("n", "n_nationkey").alias("v"))
        .union(table(spark, folder, "customer").select(name("n", "c_nationkey"), name("c", "c_custkey"))).union(table(spark, folder, "orders").select(name("c", "o_custkey"), name("o", "o_orderkey")))
    )
    at = edges.groupBy(F.col("u").alias("top")).agg(F.count("*").alias("n")).withColumn("depth", F.lit(1))
    every = at = kept(at)
    for depth in range(2, most + 1):
        at = kept(at.join(edges, at.top == edges.v).groupBy(F.col("u").alias("up")).agg(F.sum("n").alias("n")).select(F.col("up").alias("top"), "n", F.lit(depth).alias("depth")))
        if at.isEmpty():
            break
        every = every.union(at)
    return every.groupBy("top").agg(F.sum("n").alias("descendants"), F.max("depth").alias("depth"))


@named("graph_colliders", """with e as (select distinct l_suppkey, l_partkey from lineitem), c as (select l_partkey, count(*) as parents from e group by 1)
    select l_partkey, parents, case when parents >= 2 then 'collider' else 'chain' end as kind from c""")
def graph_colliders(spark, folder):
    """Nodes with two parents or more."""
    e = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return e.groupBy("l_partkey").agg(F.count("*").alias("parents")).withColumn("kind", F.when(F.col("parents") >= 2, "collider").otherwise("chain"))


#: What an event does to a weight, and where weights stop.
STEPS = {"purchase": 0.2, "error": -0.3, "view": -0.1, "signup": 0.4}
LOWEST, HIGHEST = 0.0, 2.0


@named("graph_feedback", """with recursive e as (select user_id, case event_type when 'purchase' then 0.2 when 'error' then -0.3 when 'view' then -0.1 when 'signup' then 0.4 else 0 end::double as d, row_number() over (partition by user_id order by ts, event_id) as i from events),
    f as (select user_id, list(d order by i) as d from e group by user_id) select user_id, round(list_reduce(list_prepend(1.0::double, d), lambda w, x: greatest(0.0, least(2.0, w + x))), 4)::double as weight, len(d) as n from f""")
def graph_feedback(spark, folder):
    """A weight per user that starts at 1 and moves with each event in order, never leaving its bounds.

    A run of bounded moves is itself one bounded move: add s, then stay in [lo, hi]. So each hour of a user is folded
    apart, in parallel, then the hours of a day, then the days: no list holds more than a user's events of one hour."""
    step = F.lit(0.0)
    for kind, by in STEPS.items():
        step = F.when(F.col("event_type") == kind, by).otherwise(step)
    one = F.struct(F.lit(0.0).alias("s"), F.lit(LOWEST).alias("lo"), F.lit(HIGHEST).alias("hi"))

    def then(a, b):
        within = lambda x: F.greatest(b["lo"], F.least(b["hi"], x + b["s"]))
        return F.struct((a["s"] + b["s"]).alias("s"), within(a["lo"]).alias("lo"), within(a["hi"]).alias("hi"))

    def folded(rows):
        return F.aggregate(F.transform(F.array_sort(rows), lambda r: r["move"]), one, then)

    e = table(spark, folder, "events").select("user_id", F.date_trunc("hour", "ts").alias("hour"), F.struct("ts", "event_id", F.struct(step.alias("s"), F.lit(LOWEST).alias("lo"), F.lit(HIGHEST).alias("hi")).alias("move")).alias("row"))
    hours = e.groupBy("user_id", "hour").agg(F.count("*").alias("n"), folded(F.collect_list("row")).alias("move"))
    days = hours.groupBy("user_id", F.to_date("hour").alias("day")).agg(F.sum("n").alias("n"), folded(F.collect_list(F.struct("hour", "move"))).alias("move"))
    users = days.groupBy("user_id").agg(F.sum("n").alias("n"), folded(F.collect_list(F.struct("day", "move"))).alias("m"))
    return users.select("user_id", F.round(F.greatest(F.col("m.lo"), F.least(F.col("m.hi"), 1.0 + F.col("m.s"))), 4).alias("weight"), "n")


_CELLS = "select vec_id, label, floor((embedding[1]::double + 1) * 4)::int as x, floor((embedding[2]::double + 1) * 4)::int as y, floor((embedding[3]::double + 1) * 4)::int as z from embeddings"


def _cells(spark, folder) -> DataFrame:
    at = lambda i: F.floor((F.col("embedding")[i].cast("double") + 1) * 4).cast("int")
    return table(spark, folder, "embeddings").select("vec_id", "label", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


@named("atlas_cells", f"with c as ({_CELLS}) select x, y, z, count(*) as n, count(distinct label) as labels from c group by all")
def atlas_cells(spark, folder):
    """Points by cell of an eight-by-eight-by-eight map of the first three dimensions."""
    return _cells(spark, folder).groupBy("x", "y", "z").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))


@named("atlas_gaps", f"""with c as ({_CELLS}), k as (select distinct x, y, z, label from c), o as (select unnest([-1, 0, 1]) as d), n as (select k.x + a.d as x, k.y + b.d as y, k.z + g.d as z, label from k, o a, o b, o g)
    select x, y, z, count(distinct label) as labels from n where not exists (select 1 from k where k.x = n.x and k.y = n.y and k.z = n.z) and x between 0 and 7 and y between 0 and 7 and z between 0 and 7 group by all having count(distinct label) >= 2""")
def atlas_gaps(spark, folder):
    """Empty cells that touch cells of two labels or more. Cells, not points, are spread to their neighbours."""
    cells = _cells(spark, folder).select("x", "y", "z", "label").distinct()
    near = cells
    for axis in "xyz":
        near = near.withColumn(axis, F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.col(axis) + d)))  # noqa: B023
    near = near.where(" and ".join(f"{axis} between 0 and 7" for axis in "xyz")).groupBy("x", "y", "z").agg(F.countDistinct("label").alias("labels")).where("labels >= 2")
    return near.join(cells, ["x", "y", "z"], "left_anti")


@named("atlas_closest", """with m as (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings), c as (select label, i, avg(v) as v from m group by all), q as (select label, list(v order by i) as q from c group by label),
    d as (select label, vec_id, round(list_cosine_similarity(embedding::double[], q), 6) as cosine from embeddings join q using (label)) select label, vec_id, cosine from (select *, row_number() over (partition by label order by cosine desc, vec_id) as r from d) where r <= 3""")
def atlas_closest(spark, folder):
    """The three vectors of each label nearest its centroid."""
    rows = table(spark, folder, "embeddings")
    mean = rows.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    centre = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p")).select("label", F.col("p.v").alias("q"))
    near = rows.join(centre, "label").select("label", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))
    return near.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("cosine"), "vec_id"))).where("r <= 3").drop("r")


def nearest(points: DataFrame) -> DataFrame:
    """(label, id, other, distance): for each of points (label, id, x, y, z) the nearest of its label, exactly; ties go to the smallest id.

    Equal points are one place, so copies meet each other without a search. Places are dealt to cells of a grid; what is found in
    a place's own and the 26 cells around is the nearest if it is within a cell's side, and other places go on to a round with wider cells. A cell's places
    are lists of 256 at most, of which a place takes the nearest, so pairs are no rows; the 27 rows of a place are dealt by their number."""
    at, cells = ["label", "x", "y", "z"], ["label", "cx", "cy", "cz"]
    places = kept(points.groupBy(*at).agg(F.min("id").alias("first"), F.count("*").alias("n")))
    copies = points.join(places.where("n > 1"), at)
    twins = copies.where("id <> first").groupBy(*at).agg(F.min("id").alias("second"))
    found = kept(copies.join(twins, at).select("label", "id", F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("other"), F.lit(0.0).alias("distance")))
    span = places.agg(*[F.max(c) - F.min(c) for c in "xyz"], F.count("*")).first()
    if not span[3]:
        return found
    extent = max(*span[:3], 1e-9)
    side, todo = extent / max(1.0, (span[3] / 4) ** (1 / 3)), kept(places.where("n = 1").select("label", F.col("first").alias("id"), "x", "y", "z"))
    while rows := todo.count():
        parts = parts_of(27 * rows)
        cell = lambda c: F.floor(F.col(c) / side)  # noqa: B023, E731
        asked = todo
        for c in "xyz":
            asked = asked.withColumn(f"c{c}", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: cell(c) + d)))  # noqa: B023
        held = places.select("label", *[cell(c).alias(f"c{c}") for c in "xyz"], F.struct(F.col("first").alias("other"), "x", "y", "z").alias("place")).repartition(parts, *cells)
        turn = F.row_number().over(Window.partitionBy(*cells).orderBy("place.other"))
        lists = held.withColumn("list", F.floor((turn - 1) / 256)).groupBy(*cells, "list").agg(F.collect_list("place").alias("places"))
        square = lambda p, c: (F.col(c) - p[c]) * (F.col(c) - p[c])
        far = F.transform(F.filter("places", lambda p: p["other"] != F.col("id")), lambda p: F.struct((square(p, "x") + square(p, "y") + square(p, "z")).alias("d"), p["other"].alias("other")))
        near = asked.repartition(parts, *cells).join(lists.hint("merge"), cells).select("label", "id", F.array_min(far).alias("best")).where("best is not null")
        best = near.repartition(parts, "label", "id").groupBy("label", "id").agg(F.min("best").alias("best"))
        best = best.select("label", "id", "best.other", F.sqrt("best.d").alias("distance"))
        last = side > extent
        settled = kept(best if last else best.where(F.col("distance") < side))
        found = found.union(settled)
        if last:
            break
        todo, side = kept(todo.join(settled, ["label", "id"], "left_anti")), side * 4
    return found


@named("atlas_nearest", """with p as (select label, vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings where label is not null and isfinite(embedding[1]) and isfinite(embedding[2]) and isfinite(embedding[3])),
    d as (select a.label, a.vec_id, b.vec_id as other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) as d from p a join p b on a.label = b.label and a.vec_id <> b.vec_id)
    select label, vec_id, arg_min(other, {'d': d, 'other': other}) as other, round(1 / (sqrt(min(d)) + 0.01), 2) as weight from d group by all""")
def atlas_nearest(spark, folder):
    """An edge of the map from each point to the nearest of its label, heavier the nearer."""
    fine = " and ".join(f"abs(embedding[{i}]) < double('infinity') and not isnan(embedding[{i}])" for i in range(3))
    rows = table(spark, folder, "embeddings").where(f"label is not null and {fine}")
    points = rows.select("label", F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    return nearest(points).select("label", F.col("id").alias("vec_id"), "other", F.round(1 / (F.col("distance") + 0.01), 2).alias("weight"))
