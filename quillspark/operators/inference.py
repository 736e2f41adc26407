"""Estimates of effects from grouped sums: differences, fixed effects, robust errors, placebos, power, drift and best responses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.named import named
from ..sources.tables import table


def _panel(spark, folder):
    """(unit, post, price): orders by the buyer's nation, before and after the middle of the year."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("unit"), (F.month("o_orderdate") >= 7).alias("post"), F.col("o_totalprice").alias("price"))


_PANEL = "p as (select c_nationkey as unit, month(o_orderdate) >= 7 as post, o_totalprice as price from orders join customer on o_custkey = c_custkey)"
_CHANGE = f"{_PANEL}, g as (select unit, avg(price) filter (where post) - avg(price) filter (where not post) as change from p group by unit having count(*) filter (where post) > 0 and count(*) filter (where not post) > 0)"


@named("stat_did", f"""with {_PANEL}, g as (select unit < 5 as treated, avg(price) filter (where post) as later, avg(price) filter (where not post) as before from p group by 1)
    select round(max(case when treated then later - before end) - max(case when not treated then later - before end), 2) as effect from g""")
def stat_did(spark, folder):
    """Difference in differences of mean price, units below 5 against the rest."""
    g = _panel(spark, folder).groupBy((F.col("unit") < 5).alias("treated")).agg((F.avg(F.when(F.col("post"), F.col("price"))) - F.avg(F.when(~F.col("post"), F.col("price")))).alias("change"))
    return g.agg(F.round(F.max(F.when(F.col("treated"), F.col("change"))) - F.max(F.when(~F.col("treated"), F.col("change"))), 2).alias("effect"))


@named("stat_placebo", f"""with {_CHANGE}, t as (select sum(change) as s, count(*) as n from g), e as (select unit, abs(change - (s - change) / (n - 1)) as gap, n from g, t)
    select unit, round(gap, 2) as gap, round((count(*) over (order by gap desc range between unbounded preceding and current row)) / n, 4) as p, rank() over (order by gap desc)::bigint as place from e""")
def stat_placebo(spark, folder):
    """Every unit treated in turn: how far its change lies from the others' mean, and the share of units at least as far."""
    g = _panel(spark, folder).groupBy("unit").agg((F.avg(F.when(F.col("post"), F.col("price"))) - F.avg(F.when(~F.col("post"), F.col("price")))).alias("change")).where("change is not null")
    t = F.broadcast(g.agg(F.sum("change").alias("s"), F.count("*").alias("n")))  # one row
    e = g.join(t).select("unit", F.abs(F.col("change") - (F.col("s") - F.col("change")) / (F.col("n") - 1)).alias("gap"), "n")
    far = Window.orderBy(F.desc("gap"))  # as many rows as nations
    at_least = F.count("*").over(far.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return e.select("unit", F.round("gap", 2).alias("gap"), F.round(at_least / F.col("n"), 4).alias("p"), F.rank().over(far).cast("long").alias("place"))


@named("stat_fixed_effects", """with g as (select l_suppkey, count(*) as n, sum(l_quantity) as x, sum(l_extendedprice) as y, sum(l_quantity * l_extendedprice) as xy, sum(l_quantity * l_quantity) as xx from lineitem group by 1)
    select round(sum(xy - x * y / n) / sum(xx - x * x / n), 4) as slope, sum(n)::bigint as n, count(*) as groups from g""")
def stat_fixed_effects(spark, folder):
    """The slope of price on quantity within suppliers; one pass of sums by supplier."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    g = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"))
    slope = F.sum(F.expr("xy - x * y / n")) / F.sum(F.expr("xx - x * x / n"))
    return g.agg(F.round(slope, 4).alias("slope"), F.sum("n").alias("n"), F.count("*").alias("groups"))


@named("stat_robust_error", """with g as (select l_returnflag, regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a, avg(l_quantity) as m, regr_sxx(l_extendedprice, l_quantity) as sxx, count(*) as n from lineitem group by 1),
    e as (select l_returnflag, (l_quantity - m) as d, (l_extendedprice - a - b * l_quantity) / (1 - 1.0::double / n - (l_quantity - m) * (l_quantity - m) / sxx) as e, sxx, b from lineitem join g using (l_returnflag))
    select l_returnflag, round(max(b), 4) as slope, round(sqrt(sum(d * d * e * e)) / max(sxx), 4) as error from e group by 1""")
def stat_robust_error(spark, folder):
    """Slope and its HC3 error by group: residuals over one less leverage, in a second pass that the few groups' sums join."""
    line, x, y = table(spark, folder, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice")
    g = line.groupBy("l_returnflag").agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.avg(x).alias("m"), F.regr_sxx(y, x).alias("sxx"), F.count("*").alias("n"))
    d = x - F.col("m")
    e = (y - F.col("a") - F.col("b") * x) / (1 - 1.0 / F.col("n") - d * d / F.col("sxx"))
    both = line.join(g, "l_returnflag").select("l_returnflag", "b", "sxx", (d * d * e * e).alias("v"))
    return both.groupBy("l_returnflag").agg(F.round(F.max("b"), 4).alias("slope"), F.round(F.sqrt(F.sum("v")) / F.max("sxx"), 4).alias("error"))


@named("stat_power", """with g as (select event_type, count(*) as n, avg(value) as m, var_samp(value) as v from events group by 1), c as (select a.event_type as a, b.event_type as b, round(abs(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) as d, a.n + b.n as n from g a join g b on a.event_type < b.event_type)
    select a, b, d, round(least(0.99, greatest(0.05, 1 - exp(-(d * sqrt(n / 4) - 1.96)))), 4)::double as power from c""")
def stat_power(spark, folder):
    """Effect size and power for each two kinds of event, from counts, means and variances of the few kinds."""
    g = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    a, b = [g.select(*[F.col(c).alias(f"{side}{c}") for c in g.columns]) for side in ("a_", "b_")]
    pooled = F.expr("sqrt(((a_n - 1) * a_v + (b_n - 1) * b_v) / (a_n + b_n - 2))")
    c = a.join(b, F.expr("a_event_type < b_event_type")).select(F.col("a_event_type").alias("a"), F.col("b_event_type").alias("b"), F.round(F.abs(F.expr("a_m - b_m")) / pooled, 6).alias("d"), F.expr("a_n + b_n").alias("n"))
    power = F.least(F.lit(0.99), F.greatest(F.lit(0.05), 1 - F.exp(-(F.col("d") * F.sqrt(F.col("n") / 4) - 1.96))))
    return c.select("a", "b", "d", F.round(power, 4).alias("power"))


@named("stat_drift", """with t as (select distinct doc_id % 30 // 10 as era, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) as w from documents), n as (select era, count(*) as n from t group by 1), s as (select a.era, count(*) as shared from t a join t b on b.era = a.era + 1 and a.w = b.w group by 1)
    select a.era::bigint as era, a.n as here, b.n as next, coalesce(shared, 0) as shared, round(1 - coalesce(shared, 0) / (a.n + b.n - coalesce(shared, 0)), 4) as distance from n a join n b on b.era = a.era + 1 left join s on s.era = a.era""")
def stat_drift(spark, folder):
    """How far the words of each era are from those of the next. Words of neighbouring eras are shared where a word has both, so
    a word's eras, which are few, are the only list."""
    era = F.floor(F.col("doc_id") % 30 / 10)
    t = table(spark, folder, "documents").select(era.alias("era"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("w"))
    words = t.groupBy("w").agg(F.collect_set("era").alias("eras")).select("eras", F.explode("eras").alias("era"))
    e = words.groupBy("era").agg(F.count("*").alias("here"), F.sum(F.array_contains("eras", F.col("era") + 1).cast("int")).alias("shared"))
    e = e.join(e.select((F.col("era") - 1).alias("era"), F.col("here").alias("next")), "era")
    return e.select("era", "here", "next", "shared", F.round(1 - F.col("shared") / (F.col("here") + F.col("next") - F.col("shared")), 4).alias("distance"))


@named("stat_best_responses", """with p as (select c_nationkey as game, c_mktsegment as first, o_orderpriority as second, sum(o_totalprice) as gain, count(*) as volume from orders join customer on o_custkey = c_custkey group by all),
    b as (select *, max(gain) over (partition by game, second) as best_gain, max(volume) over (partition by game, first) as best_volume from p) select game, first, second, volume from b where gain = best_gain and volume = best_volume""")
def stat_best_responses(spark, folder):
    """Pairs of moves where each is best against the other: a game per nation, segments against priorities."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    p = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("game"), F.col("c_mktsegment").alias("first"), F.col("o_orderpriority").alias("second")).agg(F.sum("o_totalprice").alias("gain"), F.count("*").alias("volume"))
    p = p.withColumn("g", F.max("gain").over(Window.partitionBy("game", "second"))).withColumn("v", F.max("volume").over(Window.partitionBy("game", "first")))
    return p.where("gain = g and volume = v").select("game", "first", "second", "volume")


@named("train_cases", """select doc_id, unnest(['recall', 'quote', 'refuse']) as kind, unnest([substr(text, 1, 40), substr(text, 1, 80), '']) as expected from documents""")
def train_cases(spark, folder):
    """Three test cases for each document."""
    case = lambda kind, expected: F.struct(F.lit(kind).alias("kind"), expected.alias("expected"))
    cases = F.array(case("recall", F.substring("text", 1, 40)), case("quote", F.substring("text", 1, 80)), case("refuse", F.lit("")))
    return table(spark, folder, "documents").select("doc_id", F.inline(cases))


@named("agg_eras", """with e(era, lo, hi) as (values ('first', 0, 1996), ('second', 1997, 2009), ('third', 2010, 2022), ('fourth', 2023, 9999)) select era, o_orderstatus as status, count(*) as n from orders join e on year(o_orderdate) between lo and hi group by all""")
def agg_eras(spark, folder):
    """Orders by era, a range join with four rows."""
    e = spark.createDataFrame([("first", 0, 1996), ("second", 1997, 2009), ("third", 2010, 2022), ("fourth", 2023, 9999)], "era string, lo int, hi int")
    o = table(spark, folder, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("status")).groupBy("y", "status").agg(F.count("*").alias("n"))
    return o.join(F.broadcast(e), F.col("y").between(F.col("lo"), F.col("hi"))).groupBy("era", "status").agg(F.sum("n").alias("n"))
