"""Training data: preference pairs, balanced samples, splits, quality gates; and the statistics used with them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.named import named
from ..sources.tables import table


@named("train_balanced", "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by doc_id) as rn from documents) where rn <= 50")
def train_balanced(spark, folder):
    """The first 50 documents of each topic, which is the operator."""
    first = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, folder, "documents").select("doc_id", "source").withColumn("rn", F.row_number().over(first)).where("rn <= 50").select("doc_id", "source")


@named("train_split", "select doc_id, case when ('0x' || substr(sha256(text), 1, 7))::bigint % 10 = 0 then 'val' else 'train' end as part from documents")
def train_split(spark, folder):
    """Split by content hash: copies of a text fall in one part, reruns agree, and no sort of the whole table is needed."""
    n = F.conv(F.substring(F.sha2("text", 256), 1, 7), 16, 10).cast("long")
    return table(spark, folder, "documents").select("doc_id", F.when(n % 10 == 0, "val").otherwise("train").alias("part"))


@named("train_pairs", """with t as (select conv_id, turn, role, text from conversations), u as (select conv_id, turn, text as prompt from t where role = 'user'), a as (select conv_id, turn, text from t where role = 'assistant')
    select u.conv_id, u.turn, u.prompt, a.text as chosen from u join a on a.conv_id = u.conv_id and a.turn = u.turn + 1""")
def train_pairs(spark, folder):
    """A user turn with the assistant turn that follows it."""
    c = table(spark, folder, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("next_role", F.lead("role").over(w)).withColumn("next_turn", F.lead("turn").over(w)).withColumn("chosen", F.lead("text").over(w))
    return c.where("role = 'user' and next_role = 'assistant' and next_turn = turn + 1").select("conv_id", "turn", F.col("text").alias("prompt"), "chosen")


@named("train_preferences", """with r as (select o_custkey, o_orderkey, o_totalprice, o_orderstatus from orders) select a.o_custkey, a.o_orderkey as chosen, b.o_orderkey as rejected from r a join r b on a.o_custkey = b.o_custkey where a.o_orderstatus = 'F' and b.o_orderstatus = 'O'""")
def train_preferences(spark, folder):
    """All pairs of a liked and a disliked answer to one question, as the operator asks; each list is cut by key before they meet."""
    r = table(spark, folder, "orders")
    good = r.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("chosen"))
    return good.join(r.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("rejected")), "o_custkey")


@named("train_gate", r"""with p as (select c.conv_id, c.turn, c.text as q, n.text as a from conversations c join conversations n on n.conv_id = c.conv_id and n.turn = c.turn + 1 where c.role = 'user' and n.role = 'assistant'),
    w as (select *, list_filter(regexp_split_to_array(lower(a), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') as w from p)
    select conv_id, turn, case when len(q) < 20 or len(a) < 20 then 'short' when len(w) >= 5 and len(list_distinct(w)) / len(w) < 0.5 then 'repetitive' else 'ok' end as reason from w""")
def train_gate(spark, folder):
    p = train_pairs(spark, folder).withColumn("w", C.words(F.lower("chosen")))
    unique = F.size(F.array_distinct("w")) / F.greatest(F.size("w"), F.lit(1))
    short = (F.length("prompt") < 20) | (F.length("chosen") < 20)
    return p.select("conv_id", "turn", F.when(short, "short").when((F.size("w") >= 5) & (unique < 0.5), "repetitive").otherwise("ok").alias("reason"))


@named("train_recent_turns", "select conv_id, turn, role, rn <= 6 as verbatim from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations)")
def train_recent_turns(spark, folder):
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", (F.row_number().over(last) <= 6).alias("verbatim"))


@named("stat_describe", "select l_returnflag, count(*) as n, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as sd, min(l_quantity) as least, max(l_quantity) as most, count(*) - count(l_discount) as missing from lineitem group by all")
def stat_describe(spark, folder):
    q = "l_quantity"
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_samp(q), 6).alias("sd"), F.min(q).alias("least"), F.max(q).alias("most"), (F.count("*") - F.count("l_discount")).alias("missing"))


@named("stat_correlate", "select round(corr(l_quantity, l_extendedprice), 3) as quantity_price, round(corr(l_quantity, l_discount), 3) as quantity_discount, round(corr(l_extendedprice, l_tax), 3) as price_tax from lineitem")
def stat_correlate(spark, folder):
    c = lambda a, b, n: F.round(F.corr(a, b), 3).alias(n)
    return table(spark, folder, "lineitem").agg(c("l_quantity", "l_extendedprice", "quantity_price"), c("l_quantity", "l_discount", "quantity_discount"), c("l_extendedprice", "l_tax", "price_tax"))


@named("stat_ols", "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, regr_count(l_extendedprice, l_quantity)::bigint as n from lineitem group by all")
def stat_ols(spark, folder):
    """Least squares by group from sums alone: one pass, one small shuffle."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    s = table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.regr_count(y, x).alias("n"))
    return s


@named("stat_synthetic_weights", """with p as (select c_nationkey as unit, avg(o_totalprice) as price, avg(c_acctbal) as balance from orders join customer on o_custkey = c_custkey group by 1), t as (select * from p where unit = 0),
    d as (select p.unit, sqrt((pow((p.price - t.price) / t.price, 2) + pow((p.balance - t.balance) / t.balance, 2)) / 2) as gap from p, t where p.unit <> 0), w as (select unit, 1 / greatest(gap, 0.001) as w from d) select unit, round(w / sum(w) over (), 6) as weight from w""")
def stat_synthetic_weights(spark, folder):
    """Donor weights by closeness to unit 0 in relative covariate gaps."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    p = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("unit")).agg(F.avg("o_totalprice").alias("price"), F.avg("c_acctbal").alias("balance"))
    t = F.broadcast(p.where("unit = 0").select(F.col("price").alias("tp"), F.col("balance").alias("tb")))  # one row
    gap = F.sqrt((F.pow((F.col("price") - F.col("tp")) / F.col("tp"), 2) + F.pow((F.col("balance") - F.col("tb")) / F.col("tb"), 2)) / 2)
    w = p.where("unit <> 0").join(t).select("unit", (1 / F.greatest(gap, F.lit(0.001))).alias("w"))
    return w.select("unit", F.round(F.col("w") / F.sum("w").over(Window.partitionBy()), 6).alias("weight"))
