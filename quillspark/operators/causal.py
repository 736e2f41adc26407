"""Causal graphs: what conditioning identifies an effect, instruments, and the sizes of closures of general graphs.

Many models are judged at once: edges are (model, u, v), and a case asks about one treatment and outcome of a model, given the variables (case, z). Models
of at most 64 variables are rows, moved once, and sets of their variables are the bits of a number. Models beyond the bounds go by rounds over the newest states only,
keyed by case and node; their number follows the longest path, and a round is one join. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..plans.named import named
from ..sources.tables import table
from .network import Dealt, kept, parts_of

#: A model is a row if it has at most so many variables, and at most so many edges, cases and given variables of cases.
WIDTH, MOST = 64, 256


def packed(edges: DataFrame, cases: DataFrame, roles: list[str], given: DataFrame | None = None) -> DataFrame:
    """(model, cases, edges, given, nodes, small) of edges (model, u, v), cases (case, model, *roles) and given (model, case, z). Lists hold MOST + 1 rows
    at most, so a model of any size fits; those not cut, of WIDTH variables at most, are small."""

    def listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
        turn = F.row_number().over(Window.partitionBy("model").orderBy("model"))
        return df.withColumn("turn", turn).where(F.col("turn") <= MOST + 1).groupBy("model").agg(F.collect_list(F.struct(*columns)).alias(name))

    models = listed(cases, "cases", "case", *roles).join(listed(edges, "edges", "u", "v"), "model", "left")
    models = models.join(listed(given, "given", "case", "z"), "model", "left") if given is not None else models
    nodes = F.array_distinct(F.concat(*[F.coalesce(F.col(f"edges.{c}"), F.array()) for c in "uv"], *[F.col(f"cases.{c}") for c in roles]))
    within = [F.coalesce(F.size(c), F.lit(0)) <= MOST for c in ("cases", "edges", *(["given"] if given is not None else []))]
    return kept(models.withColumn("nodes", nodes).withColumn("small", F.size("nodes") <= WIDTH)).withColumn("small", F.expr("small") & within[0] & within[1] & within[-1])


def place(x: Column) -> Column:
    """The place of x among its model's variables, from 0; -1 if it isn't there."""
    return F.coalesce(F.array_position("nodes", x), F.lit(0)).cast("int") - 1


def judged(models: DataFrame, roles: list[str], fields: str, rule: Callable[..., list[np.ndarray]]) -> DataFrame:
    """(model, case, *roles, *fields) of packed models that are small. rule(up, down, places, given) gives a field's values each, of all cases of some models:
    sets are bits of a number, up and down hold (case, variable) sets of parents and children, places (case, role), given a set of each case."""
    mask = lambda c: F.aggregate(
        F.coalesce("given", F.array().cast(models.schema["given"].dataType)), F.lit(0).cast("long"),
        lambda m, g: F.when((g["case"] == c["case"]) & (g["z"] != c["t"]) & (g["z"] != c["y"]) & (place(g["z"]) >= 0), m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place(g["z"])))).otherwise(m),
    )
    links = F.coalesce(F.transform("edges", lambda e: place(e["u"]) * WIDTH + place(e["v"])), F.array().cast("array<int>"))
    rows = models.where("small").select(
        "model", "cases", links.alias("links"), F.transform("cases", lambda c: F.array(*[place(c[r]) for r in roles])).alias("places"),
        F.transform("cases", mask if "given" in models.columns else lambda c: F.lit(0).cast("long")).alias("sets"),
    )
    found = StructType.fromDDL(fields)
    schema = StructType([models.schema["model"], models.schema["cases"]]).add("found", ArrayType(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("sets")
            ends, links, places = lists.offsets, b.column("links"), b.column("places")
            links, model = links.flatten().to_numpy(), np.repeat(np.arange(len(b)), np.diff(links.offsets.to_numpy()))
            places = places.flatten().flatten().to_numpy().reshape(-1, len(roles))
            u, v = links // WIDTH, links % WIDTH
            width = int(max(u.max(initial=0), v.max(initial=0), places.max(initial=0))) + 1
            up, down = np.zeros((2, len(b) * width), np.uint64)
            np.bitwise_or.at(up, model * width + v, np.uint64(1) << u.astype(np.uint64))
            np.bitwise_or.at(down, model * width + u, np.uint64(1) << v.astype(np.uint64))
            own = np.repeat(np.arange(len(b)), np.diff(ends.to_numpy()))
            got = rule(up.reshape(-1, width)[own], down.reshape(-1, width)[own], places, lists.flatten().to_numpy().astype(np.uint64))
            values = pa.StructArray.from_arrays([pa.array(x) for x in got], names=found.fieldNames())
            yield pa.RecordBatch.from_arrays([b.column("model"), b.column("cases"), pa.ListArray.from_arrays(ends, values)], ["model", "cases", "found"])

    out = rows.mapInArrow(run, schema).select("model", F.explode(F.arrays_zip("cases", "found")).alias("x"))
    return out.select("x.cases.case", "model", *[f"x.cases.{r}" for r in roles], "x.found.*")


def has(sets: np.ndarray, k) -> np.ndarray:
    """1 where a set has the k-th variable, else 0; k may be an array, none below 0 is in any."""
    k = np.asarray(k)
    return (sets >> np.maximum(k, 0).astype(np.uint64)) & (k >= 0).astype(np.uint64)


def joined(of: np.ndarray, members: np.ndarray) -> np.ndarray:
    """The union of the sets of each row's members."""
    out = np.zeros_like(members)
    for k in range(of.shape[1]):
        out |= of[:, k] * has(members, k)
    return out


def closed(of: np.ndarray) -> np.ndarray:
    """The sets that are reached in any number of steps, at least one."""
    out = of.copy()
    for k in range(of.shape[1]):
        out |= out[:, k : k + 1] * has(out, k)
    return out


def alone(k: np.ndarray) -> np.ndarray:
    return has(np.full(len(k), ~np.uint64(0)), k) << np.maximum(k, 0).astype(np.uint64)


def backdoor_rule(up: np.ndarray, down: np.ndarray, places: np.ndarray, given: np.ndarray) -> list[np.ndarray]:
    """As backdoor(): whether rule1 and rule2 hold, confounders and missing."""
    t, y = alone(places[:, 0]), alone(places[:, 1])
    above = closed(up)
    opens = given | joined(above, given)
    over, under = joined(up, t) & ~t, np.zeros_like(t)  # what is come to up and down
    while True:
        rise = joined(up, ((over & ~given) | (under & opens)) & ~y)
        fall = joined(down, (over | under) & ~given & ~y)
        new = over | (rise & ~t), under | (fall & ~t)
        if (new[0] == over).all() and (new[1] == under).all():
            break
        over, under = new
    common = joined(above, t) & ~t & joined(above, y) & ~y
    count = lambda s: np.bitwise_count(s).astype(np.int64)
    return [opens & t == 0, (over | under) & y == 0, count(common), count(common & ~given)]


def instruments_rule(up: np.ndarray, down: np.ndarray, places: np.ndarray, given: np.ndarray) -> list[np.ndarray]:
    """As instruments(): relevance, exclusion and independence."""
    i, t, y = (alone(places[:, k]) for k in range(3))
    reach, above, free = i, closed(up), np.where(places[:, 1] < 0, np.uint64(0), ~t)  # nothing is known to be other than a null t
    while True:
        new = reach | (joined(down, reach) & free)
        if (new == reach).all():
            break
        reach = new
    return [joined(down, i) & t != 0, reach & y == 0, joined(above, i) & ~i & joined(above, y) & ~y == 0]


def larger(models: DataFrame, *tables: DataFrame) -> list[DataFrame] | None:
    """The rows of tables that belong to packed models that are not small; nothing if there are none."""
    big = models.where("not small").select(F.col("model").alias("big"))
    return None if big.isEmpty() else [t.join(big, F.col("model").eqNullSafe(F.col("big")), "left_semi") for t in tables]


def spread(start: DataFrame, step, key: list[str], most: int = 10_000) -> DataFrame:
    """start and all that step() reaches from it: rows of key, each once. step(newest) gives rows of key that may be known already."""
    reached = newest = kept(start.select(*key).distinct())
    for turn in range(most):
        newest = kept(step(newest).select(*key).distinct().join(reached, key, "left_anti"))
        if newest.isEmpty():
            return reached
        reached = reached.unionByName(newest)
        if turn % 8 == 7:
            reached = kept(reached)
    raise RuntimeError(f"still spreading after {most} rounds")


def ancestors(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(case, kind, model, node) of start, of the same columns, and all ancestors."""
    up = edges.select("model", F.col("v").alias("node"), F.col("u").alias("to"))
    key = ["case", "kind", "model", "node"]
    return spread(start, lambda now: now.join(up, ["model", "node"]).select("case", "kind", "model", F.col("to").alias("node")), key)


def backdoor(edges: DataFrame, cases: DataFrame, given: DataFrame) -> DataFrame:
    """(case, status, rule1, rule2, confounders, missing) for cases (case, model, t, y) and given (case, z), z neither t nor y.

    rule1: no z descends from t. rule2: z blocks every path that begins with an arrow into t: a state is a node and the way it was come to, against an arrow (up) or
    along it (down). From a node come to up, or going on along arrows, one passes if it isn't given; from a node come to down, one turns up, as at a collider, if it or
    a descendant is given. An open walk exists if and only if an open path does. Confounders are common ancestors of t and y, missing those not given.
    given may have its cases' model too, which spares a join."""
    edges, cases = edges.select("model", "u", "v").where("model is not null and u <> v").distinct(), cases.select("case", "model", "t", "y").where("t <> y")
    given = (given if "model" in given.columns else given.join(cases.select("case", "model"), "case")).select("model", "case", "z").where("z is not null").distinct()
    models = packed(edges, cases, ["t", "y"], given)
    found = judged(models, ["t", "y"], "rule1 boolean, rule2 boolean, confounders bigint, missing bigint", backdoor_rule)
    rest = larger(models, edges, cases, given)
    found = found if rest is None else found.unionByName(backdoor_rounds(rest[0], rest[1], rest[2].select("case", "z")))
    status = F.when(F.expr("rule1 and rule2"), "IDENTIFIED").when(~F.col("rule1"), "COLLIDER_BIAS").otherwise("CONFOUNDED")
    return found.select("case", "model", "t", "y", status.alias("status"), "rule1", "rule2", "confounders", "missing")


def backdoor_rounds(edges: DataFrame, cases: DataFrame, given: DataFrame) -> DataFrame:
    """As backdoor(), without the status, by rounds that move the newest states of all cases: for models of any size."""
    edges, cases = kept(edges), kept(cases)
    given = kept(given.join(cases, "case").where("z <> t and z <> y").select("case", "model", F.col("z").alias("node")).distinct())
    mark = lambda df, kind, c: df.select("case", F.lit(kind).alias("kind"), "model", F.col(c).alias("node"))
    above = kept(ancestors(edges, mark(given, "z", "node").unionByName(mark(cases, "t", "t")).unionByName(mark(cases, "y", "y"))))
    opens = above.where("kind = 'z'").select("case", "node", F.lit(True).alias("opens"))
    shut = given.select("case", "node", F.lit(True).alias("given"))
    ways = edges.select("model", F.col("u").alias("node"), F.col("v").alias("to"), F.lit("down").alias("way")).unionByName(edges.select("model", F.col("v").alias("node"), F.col("u").alias("to"), F.lit("up").alias("way")))

    def step(now: DataFrame) -> DataFrame:
        known = now.withColumnRenamed("way", "came").join(shut, ["case", "node"], "left").join(opens, ["case", "node"], "left")
        through = F.when((F.col("came") == "down") & (F.col("way") == "up"), F.col("opens").isNotNull()).otherwise(F.col("given").isNull())
        on = known.where("node <> y").join(ways, ["model", "node"]).where(through & (F.col("to") != F.col("t")))
        return on.select("case", "model", "t", "y", F.col("to").alias("node"), "way")

    first = cases.join(edges.select("model", F.col("v").alias("t"), F.col("u").alias("node")), ["model", "t"]).withColumn("way", F.lit("up"))
    walked = spread(first, step, ["case", "model", "t", "y", "node", "way"])
    bad = walked.where("node = y").select("case").distinct().withColumn("open", F.lit(True))
    below = above.where("kind = 'z'").join(cases.select("case", F.col("t").alias("node")), ["case", "node"]).select("case").distinct().withColumn("descends", F.lit(True))
    proper = above.where("kind <> 'z'").join(cases.select("case", "t", "y"), "case").where("(kind = 't' and node <> t) or (kind = 'y' and node <> y)")
    common = proper.groupBy("case", "node").agg(F.count("*").alias("n")).where("n = 2").join(shut, ["case", "node"], "left")
    common = common.groupBy("case").agg(F.count("*").alias("confounders"), F.count(F.when(F.col("given").isNull(), 1)).alias("missing"))
    found = cases.join(bad, "case", "left").join(below, "case", "left").join(common, "case", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select("case", "model", "t", "y", F.col("descends").isNull().alias("rule1"), F.col("open").isNull().alias("rule2"), count("confounders"), count("missing"))


def instruments(edges: DataFrame, cases: DataFrame) -> DataFrame:
    """(case, relevance, exclusion, independence) of cases (case, model, i, t, y): i causes t directly, reaches y only through t, and shares no ancestor with y."""
    edges, cases = edges.select("model", "u", "v").where("model is not null and u <> v").distinct(), cases.select("case", "model", "i", "t", "y")
    models = packed(edges, cases, ["i", "t", "y"])
    found = judged(models, ["i", "t", "y"], "relevance boolean, exclusion boolean, independence boolean", instruments_rule)
    rest = larger(models, edges, cases)
    found = found if rest is None else found.unionByName(instruments_rounds(*rest))
    return found.withColumn("valid", F.expr("relevance and exclusion and independence"))


def instruments_rounds(edges: DataFrame, cases: DataFrame) -> DataFrame:
    """As instruments(), without valid, by rounds, for models of any size."""
    edges, cases = kept(edges), kept(cases)
    down = edges.select("model", F.col("u").alias("node"), F.col("v").alias("to"))
    key = ["case", "model", "t", "node"]
    reach = spread(cases.withColumn("node", F.col("i")), lambda now: now.join(down, ["model", "node"]).where("to <> t").select("case", "model", "t", F.col("to").alias("node")), key)
    direct = reach.join(cases.select("case", F.col("y").alias("node")), ["case", "node"]).select("case").distinct().withColumn("direct", F.lit(True))
    mark = lambda c: cases.select("case", F.lit(c).alias("kind"), "model", F.col(c).alias("node"))
    proper = ancestors(edges, mark("i").unionByName(mark("y"))).join(cases.select("case", "i", "y"), "case").where("(kind = 'i' and node <> i) or (kind = 'y' and node <> y)")
    common = proper.groupBy("case", "node").agg(F.count("*").alias("n")).where("n = 2").select("case").distinct().withColumn("common", F.lit(True))
    causes = cases.join(edges.select("model", F.col("u").alias("i"), F.col("v").alias("t"), F.lit(True).alias("causes")), ["model", "i", "t"], "left")
    found = causes.join(direct, "case", "left").join(common, "case", "left")
    relevance, exclusion, independence = F.col("causes").isNotNull(), F.col("direct").isNull(), F.col("common").isNull()
    return found.select("case", "model", "i", "t", "y", relevance.alias("relevance"), exclusion.alias("exclusion"), independence.alias("independence"))


def _lines(spark, folder) -> DataFrame:
    """Each order is a model whose lines are variables: (model, node), with what tells of them."""
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("model"), F.col("l_linenumber").cast("long").alias("node"), "l_discount", "l_returnflag")


def _drives(line: DataFrame) -> DataFrame:
    """(model, u, v): a line drives a later one of a greater discount."""
    later = line.select("model", F.col("node").alias("v"), F.col("l_discount").alias("other"))
    return line.withColumnRenamed("node", "u").join(later, "model").where("u < v and l_discount < other").select("model", "u", "v")


def _dealt(spark, folder) -> Dealt:
    """The lines in buckets of their orders, about 250,000 to one: whatever is joined or grouped by order then moves no more."""
    line = _lines(spark, folder)
    return Dealt(line, "model", parts_of(line))


_LINES = """l as (select l_orderkey as model, l_linenumber::bigint as node, l_discount, l_returnflag, l_linestatus from lineitem), e as (select distinct a.model, a.node as u, b.node as v from l a join l b on a.model = b.model and a.node < b.node and a.l_discount < b.l_discount),
    up(model, node, top) as (select model, v, u from e union select up.model, up.node, e.u from up join e on e.model = up.model and e.v = up.top),
    c as (select a.model, a.node as t, b.node as y from (select model, min(node) as node from l where node > 1 group by model) a join (select distinct model, node from l) b on a.model = b.model and a.node < b.node),
    z as (select distinct model, node as z from l where l_returnflag = 'R')"""


@named("causal_backdoor", f"""with recursive {_LINES},
    s as (select model, u as a, v as b, true as fwd from e union all select model, v, u, false from e),
    p(model, t, y, path, here, fwd) as (select c.model, c.t, c.y, [c.t, e.u], e.u, false from c join e on e.model = c.model and e.v = c.t
        union all select p.model, p.t, p.y, list_append(p.path, s.b), s.b, s.fwd from p join s on s.model = p.model and s.a = p.here
        where p.here <> p.y and not list_contains(p.path, s.b) and case when p.fwd and not s.fwd
            then exists (select 1 from z where z.model = p.model and z.z <> p.t and z.z <> p.y and (z.z = p.here or exists (select 1 from up where up.model = p.model and up.node = z.z and up.top = p.here)))
            else not exists (select 1 from z where z.model = p.model and z.z = p.here) end),
    r as (select c.*, not exists (select 1 from z join up on up.model = z.model and up.node = z.z where z.model = c.model and z.z <> c.y and z.z <> c.t and up.top = c.t) as rule1,
        not exists (select 1 from p where p.model = c.model and p.t = c.t and p.y = c.y and p.here = c.y) as rule2 from c),
    f as (select c.model, c.t, c.y, count(*) as confounders, count(*) filter (not exists (select 1 from z where z.model = c.model and z.z = a.top)) as missing from c join up a on a.model = c.model and a.node = c.t join up b on b.model = c.model and b.node = c.y and b.top = a.top group by all)
    select model as order, t, y, case when rule1 and rule2 then 'IDENTIFIED' when not rule1 then 'COLLIDER_BIAS' else 'CONFOUNDED' end as status, rule2 as blocked, coalesce(confounders, 0) as confounders, coalesce(missing, 0) as missing
    from r left join f using (model, t, y)""".replace(" as order,", " as order_id,"))
def causal_backdoor(spark, folder):
    """Is the effect of an order's second line on each later one identified, given its returned lines (GRF13)? In orders as models, see _lines()."""
    dealt = _dealt(spark, folder)
    line = dealt.rows
    second = line.where("node > 1").groupBy("model").agg(F.min("node").alias("t"))
    cases = second.join(line.select("model", F.col("node").alias("y")).distinct(), "model").where("t < y").withColumn("case", F.struct("model", "y"))
    given = cases.join(line.where("l_returnflag = 'R'").select("model", F.col("node").alias("z")), "model").select("model", "case", "z")
    found = backdoor(_drives(line), cases, given)
    dealt.close()
    return found.select(F.col("model").alias("order_id"), "t", "y", "status", F.col("rule2").alias("blocked"), "confounders", "missing")


@named("causal_instruments", f"""with recursive {_LINES}, i as (select c.model, l.node as i, c.t, c.y from c join (select distinct model, node from l) l on l.model = c.model and l.node < c.t),
    d(model, i, t, node) as (select distinct i.model, i.i, i.t, e.v from i join e on e.model = i.model and e.u = i.i and e.v <> i.t union select d.model, d.i, d.t, e.v from d join e on e.model = d.model and e.u = d.node and e.v <> d.t)
    select i.model as order_id, i.i, i.t, i.y, exists (select 1 from e where e.model = i.model and e.u = i.i and e.v = i.t) as relevance, not exists (select 1 from d where d.model = i.model and d.i = i.i and d.t = i.t and d.node = i.y) as exclusion,
        not exists (select 1 from up a join up b on a.model = b.model and a.top = b.top where a.model = i.model and a.node = i.i and b.node = i.y) as independence from i""")
def causal_instruments(spark, folder):
    """Is an order's first line an instrument for its second one's effect on each later one (GRF14)?"""
    dealt = _dealt(spark, folder)
    line = dealt.rows
    second = line.where("node > 1").groupBy("model").agg(F.min("node").alias("t"))
    nodes = line.select("model", "node").distinct()
    cases = second.join(nodes.withColumnRenamed("node", "y"), "model").where("t < y").join(nodes.withColumnRenamed("node", "i"), "model").where("i < t")
    found = instruments(_drives(line), cases.withColumn("case", F.struct("model", "i", "y")))
    dealt.close()
    return found.select(F.col("model").alias("order_id"), "i", "t", "y", "relevance", "exclusion", "independence")


def closure_sizes(edges: DataFrame, k: int = 256) -> DataFrame:
    """(node, n, exact): how many other nodes each node of edges (u, v) reaches, in graphs of any shape, cycles included.

    Each node keeps the k least hashes of the nodes it reaches, and a round hands only new ones to its parents. Below k hashes the number
    is exact; with k it is estimated from the k-th, with a relative error of about 1 / sqrt(k - 2). A node's hashes are rows, so one with
    very many children is no one's list."""
    if k < 3:
        raise ValueError("k must be 3 or more")
    edges = kept(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    turn = lambda by: F.row_number().over(Window.partitionBy("node").orderBy(by))
    least = lambda df: df.withColumn("turn", turn("h")).where(F.col("turn") <= k).drop("turn")
    own = kept(nodes.select("node", F.xxhash64(F.lit(41), "node").alias("h")))
    held = newest = own
    bound, turn_no = 1, 0
    while True:
        told = newest.join(edges, newest.node == edges.v).select(F.col("u").alias("node"), "h").distinct()
        fresh = kept(told.join(held, ["node", "h"], "left_anti"))
        most = fresh.groupBy("node").count().agg(F.max("count")).first()[0]
        if most is None:
            break
        bound, turn_no = bound + most, turn_no + 1
        if bound <= k:  # no node has more than k yet, so none has to be cut
            held, newest = held.unionByName(fresh), fresh
            held = kept(held) if turn_no % 8 == 0 else held
            continue
        both = kept(least(held.withColumn("new", F.lit(False)).unionByName(fresh.withColumn("new", F.lit(True)))))
        held, newest = both.select("node", "h"), kept(both.where("new").select("node", "h"))
    size = held.groupBy("node").agg(F.count("*").alias("size"), F.max("h").alias("last"))
    within = (F.col("last") / F.lit(float(1 << 63)) + 1) / 2  # the k-th hash as a share of all hashes
    n = F.when(F.col("size") < k, F.col("size").cast("double")).otherwise((k - 1) / within) - 1
    return size.select("node", F.round(n).cast("long").alias("n"), (F.col("size") < k).alias("exact"))


@named("causal_closure", """with recursive l as (select l_orderkey as model, l_linenumber as node, l_discount from lineitem), e as (select distinct a.model * 10 + a.node as u, b.model * 10 + b.node as v from l a join l b on a.model = b.model and a.node < b.node and a.l_discount < b.l_discount),
    r(node, down) as (select u, v from e union select r.node, e.v from r join e on e.u = r.down), n as (select u as node from e union select v from e) select n.node, count(down) as n, true as exact from n left join r using (node) group by n.node""")
def causal_closure(spark, folder):
    """How many lines each line drives, directly or not (GRF11): diamonds count once."""
    edges = _drives(_lines(spark, folder))
    name = lambda c: F.col("model") * 10 + F.col(c)
    return closure_sizes(edges.select(name("u").alias("u"), name("v").alias("v")))
