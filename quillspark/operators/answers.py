"""One answer to a question: facets, words and vectors in one score, variety, neighbouring chunks, reasons, and a second try where the first isn't enough."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.named import named
from ..sources.tables import chunks, table
from .network import kept
from .ranking import diversified
from .retrieval import _BM25, bm25

POOL, TOP, VARIETY = 60, 12, 0.7
ENOUGH, FAMILIES = 0.35, 2


def blended(pool: DataFrame, vectors: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(item_id, doc_id, source, score, embedding) of a pool (item_id, doc_id, score, rank): .65 of the cosine to the mean of the item's five best vectors, .35 of
    the lexical score between the pool's least and greatest, and what tier and stage add. Pools are bounded, so all of this is small."""
    item = Window.partitionBy("item_id")
    seen = kept(pool.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left"))
    mean = seen.where("rank <= 5").select("item_id", F.posexplode("embedding").alias("i", "x")).groupBy("item_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    query = mean.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select("item_id", F.col("p.x").alias("q"))
    near = F.greatest(F.lit(0.0), F.coalesce(F.round(C.cosine(F.col("embedding"), F.col("q")), 6), F.lit(0.0)))
    lo, hi = F.min("score").over(item), F.max("score").over(item)
    norm = F.when(hi - lo <= 1e-9, 0.5).otherwise((F.col("score") - lo) / (hi - lo))
    tier = F.when(F.col("quality") == 1, 0.06).when(F.col("quality") == 0, -0.02).otherwise(0.0) + F.when(F.col("toxic") == 1, -0.03).otherwise(0.0)
    rows = seen.withColumn("norm", norm).join(query, "item_id", "left").join(docs.select("doc_id", "source"), "doc_id").join(labels, "doc_id", "left")
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.65 * near + 0.35 * F.col("norm") + tier)), 6)
    return kept(rows.select("item_id", "doc_id", "source", "quality", score.alias("score"), "embedding"))


def picked(scored: DataFrame) -> DataFrame:
    """(item_id, doc_id, place): TOP of each pool, by score less likeness to what was picked before."""
    turn = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    dims = scored.select(F.max(F.size("embedding"))).first()[0] or 1
    vector = F.coalesce(F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.0), max(1, dims)))
    pool = scored.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("vec_id"), F.col("score").alias("cosine"), turn.alias("rank"), vector.alias("embedding"))
    return diversified(pool, TOP, VARIETY).select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "place")


def short_of(scored: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, reason) of items whose results are not enough: none, of low relevance (mean of the five best), or of one family among the eight best."""
    turn = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    s = scored.withColumn("turn", turn).groupBy("item_id").agg(F.round(F.avg(F.when(F.col("turn") <= 5, F.col("score"))), 4).alias("best"), F.countDistinct(F.when(F.col("turn") <= 8, F.col("source"))).alias("families"))
    reason = F.when(F.col("best").isNull(), "nothing_found").when(F.col("best") < ENOUGH, "low_relevance").when(F.col("families") < FAMILIES, "low_diversity")
    return items.select("item_id").join(s, "item_id", "left").select("item_id", reason.alias("reason")).where("reason is not null")


def answers(docs: DataFrame, items: DataFrame, vectors: DataFrame, labels: DataFrame, facets: DataFrame) -> DataFrame:
    """(item_id, doc_id, source, attempt, score, rank): up to TOP documents for each of items (item_id, text) within its facet of facets (item_id, lang), if it has
    one; where these are not enough, the same without the facet behind them, what came first staying, 2 TOP in all (VEC13, VEC16)."""
    asked = items.select("item_id", "text").join(facets.select("item_id", "lang"), "item_id", "left")
    first = blended(kept(bm25(docs, asked, POOL, "lang")), vectors, docs, labels)
    short = kept(short_of(first, items))
    again = items.select("item_id", "text").join(short, "item_id", "left_semi")
    second = blended(kept(bm25(docs, again, POOL)), vectors, docs, labels)
    every = None
    for attempt, scored in ((1, first), (2, second)):
        rows = picked(scored).join(scored.drop("embedding"), ["item_id", "doc_id"]).withColumn("attempt", F.lit(attempt))
        every = rows if every is None else every.unionByName(rows)
    every = every.withColumn("turn", F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy("attempt"))).where("turn = 1")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("attempt", "place"))
    return kept(every.withColumn("rank", rank).where(F.col("rank") <= 2 * TOP).select("item_id", "doc_id", "source", "quality", "attempt", "score", "rank"))


_ANSWERS = f"""{_BM25}, facet as (select item_id, case item_id % 3 when 0 then 'en' when 1 then 'fr' end as wanted from benchmark), tries as (select unnest([1, 2]) as attempt),
    pool as (select * from (select attempt, s.item_id, s.doc_id, source, round(score, 6) as score, row_number() over (partition by attempt, s.item_id order by round(score, 6) desc, s.doc_id) as pos
        from score s join documents using (doc_id) join facet using (item_id), tries where attempt = 2 or wanted is null or wanted = lang) where pos <= 60),
    m as (select attempt, item_id, i, avg(x) as x from (select attempt, item_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from pool join embeddings on vec_id = doc_id where pos <= 5) group by all), v as (select attempt, item_id, list(x order by i) as q from m group by all),
    near as (select p.*, embedding::double[] as e, greatest(0, coalesce(round(list_cosine_similarity(embedding::double[], q), 6), 0)) as near, min(score) over (partition by p.attempt, p.item_id) as lo, max(score) over (partition by p.attempt, p.item_id) as hi
        from pool p left join embeddings on vec_id = doc_id left join v on v.attempt = p.attempt and v.item_id = p.item_id),
    final as (select attempt, item_id, doc_id, source, quality, e, round(least(1, greatest(0, 0.65 * near + 0.35 * case when hi - lo <= 1e-9 then 0.5 else (score - lo) / (hi - lo) end
        + case when quality = 1 then 0.06 when quality = 0 then -0.02 else 0 end + case when toxic = 1 then -0.03 else 0 end)), 6) as final from near left join labels using (doc_id)),
    ranked as (select *, row_number() over (partition by attempt, item_id order by final desc, doc_id) as r from final),
    enough as (select item_id from (select item_id, round(avg(final) filter (where r <= 5), 4) as best, count(distinct source) filter (where r <= 8) as families from ranked where attempt = 1 group by item_id) where best >= 0.35 and families >= 2),
    p as (select attempt, item_id, list(doc_id order by r) as ids, list(final order by r) as rel, list(e order by r) as vecs, count(*) as n from ranked where attempt = 1 or item_id not in (select item_id from enough) group by all),
    g as (select attempt, item_id, ids, rel, vecs, n, 0 as place, []::bigint[] as taken from p union all
    select attempt, item_id, ids, rel, vecs, n, place + 1, list_append(taken, list_position(sc, list_max(sc))::bigint) from (select *, list_transform(range(1, n + 1), lambda i: case when list_contains(taken, i) then -9.0
        else round(0.7 * rel[i] - 0.3 * coalesce(list_max(list_transform(taken, lambda j: coalesce(list_cosine_similarity(vecs[i], vecs[j]), 0))), 0), 6) end) as sc from g where place < 12 and place < n)),
    picks as (select attempt, item_id, ids[taken[place]] as doc_id, place from g where place > 0), firsts as (select *, row_number() over (partition by item_id, doc_id order by attempt) as f from picks),
    answer as (select a.attempt, a.item_id, a.doc_id, source, quality, final as score, row_number() over (partition by a.item_id order by a.attempt, place) as rank from firsts a join final using (attempt, item_id, doc_id) where f = 1)"""


def _answers(spark, folder) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    facets = items.select("item_id", F.when(F.col("item_id") % 3 == 0, "en").when(F.col("item_id") % 3 == 1, "fr").alias("lang"))
    return answers(docs, items, table(spark, folder, "embeddings"), table(spark, folder, "labels"), facets)


@named("retrieve_answers", f"with recursive {_ANSWERS} select item_id, doc_id, attempt, score, rank::int as rank from answer where rank <= 24")
def retrieve_answers(spark, folder):
    """Every benchmark item's answer; two of three items ask for one language only, the rest for any."""
    return _answers(spark, folder).select("item_id", "doc_id", "attempt", "score", "rank")


@named("retrieve_explained", rf"""with recursive {_ANSWERS}, t as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) as q from benchmark), w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') as w from documents),
    c as (select doc_id, a // 100 as chunk, array_to_string(w[a + 1:a + 120], ' ') as text from (select doc_id, w, unnest(range(0, len(w), 100)) as a from w)),
    h as (select item_id, doc_id, chunk, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')), q)) as hits from answer join c using (doc_id) join t using (item_id) where rank <= 24),
    b as (select item_id, doc_id, max({{'hits': hits, 'chunk': -chunk}}) as x from h group by all), z as (select item_id, doc_id, x.hits as hits, -x.chunk as chunk from b)
    select item_id, doc_id, rank::int as rank, z.chunk as chunk, hits, quality = 1 as canon, count(*) over (partition by item_id, source) as of_family, md5(substr(string_agg(c.text, ' ' order by c.chunk), 1, 1500)) as passage_md5
    from answer join z using (item_id, doc_id) join c on c.doc_id = answer.doc_id and c.chunk between z.chunk - 1 and z.chunk + 1 where rank <= 24 group by item_id, doc_id, rank, z.chunk, hits, quality, source""")
def retrieve_explained(spark, folder):
    """Why each result is there, and what to read of it (VEC26): how many of the item's words its best chunk holds, whether it is canon, how many results share its
    source; and that chunk with its neighbours. Only chunks of answers are looked at."""
    found = _answers(spark, folder)
    words = lambda c: F.array_distinct(C.tokens(F.col(c)))
    items = table(spark, folder, "benchmark").select("item_id", words("text").alias("q"))
    cut = chunks(spark, folder).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "text").join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    around = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(-1, 1)
    cut = kept(cut.withColumn("passage", F.substring(F.array_join(F.collect_list("text").over(around), " "), 1, 1500)))
    hits = found.join(items, "item_id").join(cut, "doc_id").withColumn("hits", F.size(F.array_intersect(words("text"), F.col("q"))).cast("long"))
    best = hits.groupBy("item_id", "doc_id").agg(F.max_by(F.struct("chunk", "hits", "passage"), F.struct("hits", (-F.col("chunk")).alias("c"))).alias("x"))
    whole = found.join(best, ["item_id", "doc_id"]).withColumn("of_family", F.count("*").over(Window.partitionBy("item_id", "source")))
    return whole.select("item_id", "doc_id", "rank", "x.chunk", "x.hits", (F.col("quality") == 1).alias("canon"), "of_family", F.md5("x.passage").alias("passage_md5"))
