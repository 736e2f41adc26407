"""Library and usage analytics: grouped counts, trends and ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.named import named
from ..sources.tables import table
from .network import kept
from .quantiles import at_places


def grouped(name: str, source: str, keys: dict, aggs: dict, sql: str, having: str | None = None):
    """A registered groupBy: keys and aggs are name: expression over a table."""

    @named(name, sql)
    def run(spark, folder):
        df = table(spark, folder, source).groupBy(*[F.expr(v).alias(k) for k, v in keys.items()]).agg(*[F.expr(v).alias(k) for k, v in aggs.items()])
        return df.where(having) if having else df

    return run


grouped("agg_gaps", "documents", {"topic": "source", "lang": "lang"}, {"n": "count(*)"}, "select source as topic, lang, count(*) as n from documents group by all having count(*) < 10", "n < 10")
grouped("agg_coverage", "orders", {"year": "year(o_orderdate)", "priority": "o_orderpriority"}, {"n": "count(*)", "least": "min(o_totalprice)", "most": "max(o_totalprice)"},
        "select year(o_orderdate)::int as year, o_orderpriority as priority, count(*) as n, min(o_totalprice) as least, max(o_totalprice) as most from orders group by all")
grouped("agg_peak_hours", "events", {"hour": "hour(ts)"}, {"n": "count(*)", "users": "count(distinct user_id)"}, "select hour(ts)::int as hour, count(*) as n, count(distinct user_id) as users from events group by all")
grouped("agg_profile", "events", {"user_id": "user_id", "topic": "event_type"}, {"n": "count(*)", "first_seen": "date_format(min(ts), 'yyyy-MM-dd HH:mm:ss')", "last_seen": "date_format(max(ts), 'yyyy-MM-dd HH:mm:ss')"},
        "select user_id, event_type as topic, count(*) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen from events group by all")
grouped("agg_entity_timeline", "orders", {"o_custkey": "o_custkey"}, {"first_order": "min_by(o_orderkey, struct(o_orderdate, o_orderkey))", "n": "count(*)"},
        "select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first_order, count(*) as n from orders group by all")
grouped("agg_decades", "documents", {"decade": "floor((1995 + doc_id % 30) / 10) * 10"}, {"n": "count(*)", "chars": "sum(n_chars)"}, "select ((1995 + doc_id % 30) // 10) * 10 as decade, count(*) as n, sum(n_chars)::bigint as chars from documents group by all")
grouped("agg_edges", "lineitem", {"cause": "l_suppkey", "effect": "l_partkey"}, {"weight": "round(avg(l_discount), 6)", "evidence": "count(*)", "kinds": "count(distinct l_returnflag)"},
        "select l_suppkey as cause, l_partkey as effect, round(avg(l_discount), 6) as weight, count(*) as evidence, count(distinct l_returnflag) as kinds from lineitem group by all")
grouped("agg_costs", "conversations", {"role": "role"}, {"calls": "count(*)", "tokens": "sum(length(text)) / 4", "cost": "round(sum(length(text)) / 4 / 1000 * 0.002D, 4)"},
        "select role, count(*) as calls, sum(len(text)) / 4::double as tokens, round(sum(len(text)) / 4::double / 1000 * 0.002::double, 4) as cost from conversations group by all")
grouped("agg_feedback", "conversations", {"conv_id": "conv_id"}, {"up": "sum(case when turn % 2 = 0 then 1 else 0 end)", "down": "sum(case when turn % 2 = 1 then 1 else 0 end)"},
        "select conv_id, sum(case when turn % 2 = 0 then 1 else 0 end)::bigint as up, sum(case when turn % 2 = 1 then 1 else 0 end)::bigint as down from conversations group by all having sum(case when turn % 2 = 0 then 1 else 0 end) > sum(case when turn % 2 = 1 then 1 else 0 end)", "up > down")
grouped("agg_cube_sales", "orders", {"status": "o_orderstatus"}, {"n": "count(*)", "buyers": "count(distinct o_custkey)"}, "select o_orderstatus as status, count(*) as n, count(distinct o_custkey) as buyers from orders group by all")


@named("agg_method_audit", """with c as (select source, lang, count(*) as n from documents group by all) select source, arg_max(lang, (n, lang)) as dominant, count(*) as methods, sum(n)::bigint as total from c group by source""")
def agg_method_audit(spark, folder):
    c = table(spark, folder, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.max_by("lang", F.struct("n", "lang")).alias("dominant"), F.count("*").alias("methods"), F.sum("n").alias("total"))


@named("agg_facets", "select lang, array_to_string(list_sort(list(distinct source)), ',') as sources from documents group by lang")
def agg_facets(spark, folder):
    return table(spark, folder, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@named("agg_velocity", """with d as (select event_type, ts::date as day, sum(value) as v from events group by all), r as (select *, row_number() over (partition by event_type order by day desc) as rn, count(*) over (partition by event_type) as days from d)
    select event_type, round(avg(v) filter (where rn <= 7), 4) as recent, max(days) as days, case when max(days) < 5 then 'steady' when avg(v) filter (where rn <= 3) > 1.2 * avg(v) filter (where rn > 3) then 'up'
    when avg(v) filter (where rn <= 3) < 0.8 * avg(v) filter (where rn > 3) then 'down' else 'steady' end as trend from r group by event_type""")
def agg_velocity(spark, folder):
    d = table(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("event_type")
    d = d.withColumn("rn", F.row_number().over(w.orderBy(F.desc("day")))).withColumn("days", F.count("*").over(w))
    a = d.groupBy("event_type").agg(F.round(F.avg(F.when(F.col("rn") <= 7, F.col("v"))), 4).alias("recent"), F.max("days").alias("days"), F.avg(F.when(F.col("rn") <= 3, F.col("v"))).alias("new"), F.avg(F.when(F.col("rn") > 3, F.col("v"))).alias("old"))
    trend = F.when(F.col("days") < 5, "steady").when(F.col("new") > 1.2 * F.col("old"), "up").when(F.col("new") < 0.8 * F.col("old"), "down").otherwise("steady")
    return a.select("event_type", "recent", "days", trend.alias("trend"))


@named("agg_focus", "select event_type, round(count(*) / sum(count(*)) over (), 3) as share from events group by event_type")
def agg_focus(spark, folder):
    n = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 3).alias("share"))  # one row a type


@named("agg_weeks", "select strftime(ts, '%Y-W%W') as week, event_type, count(*) as n from events group by all")
def agg_weeks(spark, folder):
    """Weeks start on Monday; days before the first Monday of a year are week 0."""
    week = F.floor((F.dayofyear("ts") + 6 - F.weekday("ts")) / 7)
    return table(spark, folder, "events").groupBy(F.format_string("%d-W%02d", F.year("ts"), week).alias("week"), "event_type").agg(F.count("*").alias("n"))


@named("agg_rank_stats", """with s as (select event_type, list_sort(list(value)) as v from events group by event_type) select event_type, len(v) as n, round(list_sum(v) / len(v), 6) as mean, v[len(v) // 2 + 1] as median, v[1] as least, v[-1] as most,
    case when len(v) > 20 then v[floor(len(v) * 0.95)::int + 1] end as p95 from s""")
def agg_rank_stats(spark, folder):
    """Median and 95th percentile by rank, from counts by intervals, so a type of most events is not one task's."""
    e = table(spark, folder, "events").select("event_type", "value")
    s = kept(e.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")))
    rank = {"median": F.floor(F.col("n") / 2), "p95": F.floor(F.col("n") * 0.95)}
    want = s.select("event_type", F.explode(F.array(*rank.values())).alias("place"))
    found = s.select("event_type", "n").join(at_places(e, "event_type", "value", want), "event_type")
    found = found.groupBy("event_type").agg(*[F.max(F.when(F.col("place") == at, F.col("value"))).alias(name) for name, at in rank.items()])
    return s.join(found, "event_type").select("event_type", "n", "mean", "median", "least", "most", F.when(F.col("n") > 20, F.col("p95")).alias("p95"))


@named("agg_balance", """with c as (select o_orderpriority as topic, count(*) as n from orders group by 1) select topic, n, row_number() over (order by n desc, topic)::int as top, row_number() over (order by n, topic)::int as bottom, n < 0.5 * avg(n) over () as under from c""")
def agg_balance(spark, folder):
    c = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("topic")).agg(F.count("*").alias("n"))  # a few rows
    return c.select("topic", "n", F.row_number().over(Window.orderBy(F.desc("n"), "topic")).alias("top"), F.row_number().over(Window.orderBy("n", "topic")).alias("bottom"), (F.col("n") < 0.5 * F.avg("n").over(Window.partitionBy())).alias("under"))


@named("agg_evidence", """with c as (select l_orderkey, l_suppkey, count(*) as n from lineitem group by all), p as (select *, n / sum(n) over (partition by l_orderkey) as p from c)
    select l_orderkey, count(*) as sources, round(-sum(p * ln(p + 1e-10)) / ln(count(*) + 1e-10), 3) as diversity from p group by l_orderkey having count(*) > 1""")
def agg_evidence(spark, folder):
    """Evenness of an order's suppliers: entropy over its greatest value."""
    c = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("l_orderkey")))
    even = F.round(-F.sum(F.col("p") * F.log(F.col("p") + 1e-10)) / F.log(F.count("*") + 1e-10), 3)
    return p.groupBy("l_orderkey").agg(F.count("*").alias("sources"), even.alias("diversity")).where("sources > 1")


@named("agg_trends", """with y as (select o_orderpriority as topic, year(o_orderdate) as y, count(*) as n from orders group by all), r as (select *, row_number() over (partition by topic order by y) as a, row_number() over (partition by topic order by y desc) as b from y)
    select topic, case when avg(n) filter (where b <= 3) > 1.5 * avg(n) filter (where a <= 3) then 'rising' when avg(n) filter (where b <= 3) < 0.5 * avg(n) filter (where a <= 3) then 'falling' else 'flat' end as trend, max(n) as peak from r group by topic""")
def agg_trends(spark, folder):
    y = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("topic"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("topic")
    y = y.withColumn("a", F.row_number().over(w.orderBy("y"))).withColumn("b", F.row_number().over(w.orderBy(F.desc("y"))))
    first, last = F.avg(F.when(F.col("a") <= 3, F.col("n"))), F.avg(F.when(F.col("b") <= 3, F.col("n")))
    return y.groupBy("topic").agg(F.when(last > 1.5 * first, "rising").when(last < 0.5 * first, "falling").otherwise("flat").alias("trend"), F.max("n").alias("peak"))


@named("agg_rollup", "select o_orderstatus as status, o_orderpriority as priority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, folder):
    return table(spark, folder, "orders").rollup(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@named("join_manifest", """with a as (select doc_id, md5(text) as h from documents where doc_id % 10 <> 0), b as (select doc_id, md5(case when doc_id % 7 = 0 then text || '.' else text end) as h from documents where doc_id % 10 <> 1)
    select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'new' when b.doc_id is null then 'deleted' when a.h <> b.h then 'modified' else 'unchanged' end as state from a full join b on a.doc_id = b.doc_id""")
def join_manifest(spark, folder):
    """State of every document between two manifests of content hashes."""
    d = table(spark, folder, "documents")
    a = d.where("doc_id % 10 <> 0").select("doc_id", F.md5("text").alias("old"))
    b = d.where("doc_id % 10 <> 1").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("new"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return a.join(b, "doc_id", "full_outer").select("doc_id", state.alias("state"))


@named("join_not_indexed", "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def join_not_indexed(spark, folder):
    return table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left_anti")


@named("join_health", "select s_suppkey, s_name, coalesce(n, 0) as n from supplier left join (select l_suppkey, count(*) as n from lineitem group by 1) on s_suppkey = l_suppkey")
def join_health(spark, folder):
    n = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return table(spark, folder, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("n"))


#: Price of a thousand tokens by who wrote them.
PRICES = {"user": 0.003, "assistant": 0.015}


@named("agg_cost", """with t as (select conv_id, role, ceil(len(coalesce(text, '')) / 4.0)::bigint as n from conversations), c as (select role, count(*) as turns, sum(n)::bigint as tokens from t group by role)
    select role, turns, tokens, round(tokens / 1000.0::double * case role when 'user' then 0.003 when 'assistant' then 0.015 else 0 end::double, 6) as cost from c""")
def agg_cost(spark, folder):
    """Turns, tokens and cost by role; a role without a price is free."""
    price = F.lit(0.0)
    for role, p in PRICES.items():
        price = F.when(F.col("role") == role, p).otherwise(price)
    n = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4.0)
    c = table(spark, folder, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(n).alias("tokens"))
    return c.select("role", "turns", "tokens", F.round(F.col("tokens") / 1000.0 * price, 6).alias("cost"))


@named("agg_first_seen", """select l_suppkey, min(l_shipdate)::date::varchar as first_seen, arg_min(l_orderkey, {'d': l_shipdate, 'o': l_orderkey}) as first_order, max(l_shipdate)::date::varchar as last_seen, count(*) as n from lineitem group by 1""")
def agg_first_seen(spark, folder):
    """When each supplier is first and last seen, and in which order first; ties go to the smallest order."""
    day = F.col("l_shipdate").cast("date").cast("string")
    first = F.min(F.struct("l_shipdate", "l_orderkey"))
    g = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.min(day).alias("first_seen"), first.alias("f"), F.max(day).alias("last_seen"), F.count("*").alias("n"))
    return g.select("l_suppkey", "first_seen", F.col("f.l_orderkey").alias("first_order"), "last_seen", "n")


@named("agg_merged_records", """select p_name, arg_min(p_brand, p_partkey) as brand, string_agg(distinct p_type, ';' order by p_type) as types, count(*) as mentions, round(max(p_retailprice), 2) as price from part group by p_name""")
def agg_merged_records(spark, folder):
    """Records of one name as one: the first one's brand, all types, and how often the name is met. Types are few."""
    first, types = F.min_by("p_brand", "p_partkey"), F.array_join(F.array_sort(F.collect_set("p_type")), ";")
    return table(spark, folder, "part").groupBy("p_name").agg(first.alias("brand"), types.alias("types"), F.count("*").alias("mentions"), F.round(F.max("p_retailprice"), 2).alias("price"))


@named("retrieve_page", "select o_orderkey, o_custkey, round(o_totalprice, 2) as price from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def retrieve_page(spark, folder, page: int = 3, per_page: int = 50):
    """One page of a sorted listing."""
    o = table(spark, folder, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset((page - 1) * per_page).limit(per_page)
    return o.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"))


@named("events_recent", "select event_type, count(*) as n, max(event_id) as latest from (select * from events order by ts desc, event_id desc limit 500) group by event_type")
def events_recent(spark, folder, most: int = 500):
    """What the last 500 events were; a top-k, so no full sort."""
    return table(spark, folder, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(most).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("latest"))
