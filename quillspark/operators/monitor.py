"""Latest metrics by key, stratified samples, stale sources, and how sensitive an effect is to what was left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.named import named
from ..sources.tables import table
from .network import kept
from .regression import ols


def latest(rows: DataFrame, key: str, at: list, most: int = 100) -> DataFrame:
    """The last `most` rows of each key by `at`. Tasks drop all but their own last ones before any row is shuffled."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in at]))
    return rows.withColumn("turn", turn).where(F.col("turn") <= most).drop("turn")


@named("agg_latest_metrics", """with l as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 100), v as (select user_id, count(*) as n, list_sort(list(value)) as v, round(avg((event_type = 'error')::int), 4) as errors from l group by user_id)
    select user_id, n, v[floor(n * 0.5)::int + 1] as p50, v[least(n, floor(n * 0.95)::int + 1)] as p95, v[least(n, floor(n * 0.99)::int + 1)] as p99, errors::double as errors from v""")
def agg_latest_metrics(spark, folder):
    """Percentiles by rank and the share of errors of the last hundred calls of each endpoint (AGG15); users stand for endpoints, values for latencies."""
    e = latest(table(spark, folder, "events"), "user_id", ["ts", "event_id"])
    v = F.array_sort(F.collect_list("value"))  # a hundred at most
    s = e.groupBy("user_id").agg(F.count("*").alias("n"), v.alias("v"), F.round(F.avg((F.col("event_type") == "error").cast("int")), 4).alias("errors"))
    at = lambda share: F.get("v", F.least(F.col("n") - 1, F.floor(F.col("n") * share)).cast("int"))
    return s.select("user_id", "n", at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), "errors")


def stratified(rows: DataFrame, stratum: str, id: str, n: int) -> DataFrame:
    """About n of rows: of each stratum as its share of them, one at least, the first by a hash of the id; then cut to n by the same hash (JN20). Ids
    over a hash bound that a stratum's size sets, with room to spare, are left out before any are ranked, so a large stratum is not one task's."""
    size = kept(rows.groupBy(stratum).agg(F.count("*").alias("size")))
    every = size.agg(F.sum("size")).first()[0] or 1
    share = F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("size") / every))
    marked = rows.join(size, stratum).withColumn("share", share).withColumn("mark", F.md5(F.concat(F.lit("s"), F.col(id).cast("string"))))
    bound = F.conv(F.substring("mark", 1, 8), 16, 10).cast("double") / float(1 << 32)
    marked = marked.where(bound * F.col("size") <= 2 * F.col("share") + 50)
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy("mark"))
    return marked.withColumn("turn", turn).where(F.col("turn") <= F.col("share")).orderBy("mark").limit(n).drop("size", "share", "mark", "turn")


@named("sample_stratified", """with z as (select source, count(*) as size from documents group by 1), t as (select sum(size) as every from z),
    d as (select doc_id, source, md5('s' || doc_id) as mark, greatest(1, floor(150 * size / every)) as share from documents join z using (source), t), r as (select *, row_number() over (partition by source order by mark) as turn from d)
    select doc_id, source from r where turn <= share order by mark limit 150""")
def sample_stratified(spark, folder):
    """150 documents, from each source as its share of all (JN20)."""
    return stratified(table(spark, folder, "documents").select("doc_id", "source"), "source", "doc_id", 150)


#: Words that ask for what is current.
CURRENT = ("current", "recent", "latest", "nowadays", "today", "2024", "2025", "2026", "trend", "contemporary")


def stale(results: DataFrame, questions: DataFrame, now: int, years: int = 5) -> DataFrame:
    """(query_id, doc_id, year) of results (query_id, doc_id, year) from before now - years, for questions (query_id, text) that ask for what is current only (FLT14).
    Years that are no number are never stale."""
    low = F.lower("text")
    asks = F.lit(False)
    for word in CURRENT:
        asks = asks | low.contains(word)
    year = F.expr("try_cast(substr(cast(year as string), 1, 4) as int)")
    return results.join(questions.where(asks).select("query_id"), "query_id", "left_semi").select("query_id", "doc_id", year.alias("year")).where(F.col("year") < now - years)


@named("filter_stale", """with q as (select item_id as query_id, case when item_id % 2 = 0 then 'Latest: ' || text else text end as text from benchmark), r as (select item_id as query_id, doc_id, 1995 + doc_id % 30 as year from benchmark join documents on doc_id % 40 = item_id % 40)
    select query_id, doc_id, year::int as year from r where year < 2021 and query_id in (select query_id from q where list_sum(list_transform(['current', 'recent', 'latest', 'nowadays', 'today', '2024', '2025', '2026', 'trend', 'contemporary'], lambda w: contains(lower(text), w)::int)) > 0)""")
def filter_stale(spark, folder):
    """Results too old for what was asked. Every other question is put as one for the latest; results are documents by number, years by id."""
    items, docs = table(spark, folder, "benchmark"), table(spark, folder, "documents")
    asked = items.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Latest: "), "text")).otherwise(F.col("text")).alias("text"))
    found = items.join(docs, F.col("item_id") % 40 == F.col("doc_id") % 40).select(F.col("item_id").alias("query_id"), "doc_id", (1995 + F.col("doc_id") % 30).alias("year"))
    return stale(found, asked, 2026)


@named("stat_sensitivity", """with m as (select avg(l_extendedprice) as y, avg(l_quantity) as a, avg(l_discount) as b from lineitem), s as (select sum((l_quantity - a) * (l_quantity - a)) as aa, sum((l_quantity - a) * (l_discount - b)) as ab, sum((l_discount - b) * (l_discount - b)) as bb,
    sum((l_quantity - a) * (l_extendedprice - y)) as ay, sum((l_discount - b) * (l_extendedprice - y)) as by_ from lineitem, m), f as (select ay / aa as alone, (bb * ay - ab * by_) / (aa * bb - ab * ab) as whole from s)
    select round(alone, 6) as alone, round(whole, 6) as whole, abs(whole / (alone - whole)) > 1 as robust from f""")
def stat_sensitivity(spark, folder):
    """How much stronger than the given control what was left out would have to be to undo an effect (STA5): the whole estimate over what the control moved it by; robust above 1."""
    line = table(spark, folder, "lineitem")
    y, x = F.col("l_extendedprice"), {c: F.col(c) for c in ("l_quantity", "l_discount")}
    alone, whole = (float(ols(line, y, {k: x[k] for k in names}, "classic").beta[1]) for names in (("l_quantity",), ("l_quantity", "l_discount")))
    ratio = abs(whole / (alone - whole)) if alone != whole else float("inf")
    return spark.createDataFrame([(round(alone, 6), round(whole, 6), ratio > 1)], "alone double, whole double, robust boolean")
