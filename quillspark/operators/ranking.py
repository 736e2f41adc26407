"""Many-query vector ranking, diversification, and measures of rankings. The queries are every twentieth vector."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.named import named
from ..sources.tables import table
from .neighbours import nearest, nearest_within
from .retrieval import bm25

_NEAR = """n as (select q.vec_id as query_id, q.label as wanted, r.vec_id, r.label, round(list_cosine_similarity(q.embedding::double[], r.embedding::double[]), 6) as cosine from embeddings q, embeddings r where q.vec_id % 20 = 0 and q.vec_id <> r.vec_id),
    k as (select * from (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from n) where rank <= {k})"""


def _near(spark, folder, k: int) -> DataFrame:
    """(query_id, wanted, vec_id, label, cosine, rank): the k nearest with the labels of both."""
    rows = table(spark, folder, "embeddings")
    label = rows.select("vec_id", "label")
    found = nearest(rows, rows.where("vec_id % 20 = 0"), k).join(label, "vec_id")
    return found.join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")


@named("retrieve_label_vote", f"""with {_NEAR.format(k=10)}, v as (select query_id, label, count(*) as votes, sum(cosine) as weight from k group by all)
    select query_id, label, votes from (select *, row_number() over (partition by query_id order by votes desc, round(weight, 4) desc, label) as r from v) where r = 1""")
def retrieve_label_vote(spark, folder):
    """The label most of the ten nearest carry; ties by summed cosine."""
    v = _near(spark, folder, 10).groupBy("query_id", "label").agg(F.count("*").alias("votes"), F.round(F.sum("cosine"), 4).alias("weight"))
    best = Window.partitionBy("query_id").orderBy(F.desc("votes"), F.desc("weight"), "label")
    return v.withColumn("r", F.row_number().over(best)).where("r = 1").select("query_id", "label", "votes")


@named("retrieve_merged", f"""with {_NEAR.format(k=10)}, m as (select wanted as label, vec_id, max(cosine) as cosine, count(*) as n_queries from k group by all)
    select label, vec_id, cosine, n_queries from (select *, row_number() over (partition by label order by cosine desc, vec_id) as r from m) where r <= 20""")
def retrieve_merged(spark, folder):
    """Several queries, one answer: the queries of a label share a list, where a vector counts by its best cosine."""
    m = _near(spark, folder, 10).groupBy(F.col("wanted").alias("label"), "vec_id").agg(F.max("cosine").alias("cosine"), F.count("*").alias("n_queries"))
    return m.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("cosine"), "vec_id"))).where("r <= 20").drop("r")


@named("retrieve_mean_query", """with e as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings where vec_id % 20 = 0), m as (select label, i, avg(x) as x from e group by all), q as (select label, list(x order by i) as q from m group by label),
    n as (select q.label, r.vec_id, round(list_cosine_similarity(q, r.embedding::double[]), 6) as cosine from q, embeddings r)
    select label, vec_id, cosine from (select *, row_number() over (partition by label order by cosine desc, vec_id) as r from n) where r <= 10""")
def retrieve_mean_query(spark, folder):
    """The ten nearest to the mean of each label's queries."""
    rows = table(spark, folder, "embeddings")
    e = rows.where("vec_id % 20 = 0").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = e.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))  # as many entries as dimensions
    query = mean.select((-1 - F.col("label")).cast("long").alias("vec_id"), F.col("p.x").alias("embedding"))
    return nearest(rows, query, 10).select((-1 - F.col("query_id")).cast("int").alias("label"), "vec_id", "cosine")


@named("retrieve_narrowed", """with e as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as x from e group by all), c as (select label, list(x order by i) as c from m group by label),
    s as (select vec_id as query_id, embedding::double[] as q, c.label, row_number() over (partition by vec_id order by round(list_cosine_similarity(embedding::double[], c), 6) desc, c.label) as r from embeddings, c where vec_id % 20 = 0),
    n as (select query_id, r.vec_id, round(list_cosine_similarity(q, r.embedding::double[]), 6) as cosine from s join embeddings r on r.label = s.label where s.r <= 2 and query_id <> r.vec_id)
    select query_id, vec_id, cosine from (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as r from n) where r <= 5""")
def retrieve_narrowed(spark, folder):
    """Sections first: the two labels whose centroids are nearest, then the five nearest vectors within these. A label's rows and queries meet
    as parts and blocks, so no row is joined with a query and no label is one task's."""
    rows = table(spark, folder, "embeddings")
    e = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = e.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select((-1 - F.col("label")).cast("long").alias("vec_id"), F.col("p.x").alias("embedding"))
    asked = rows.where("vec_id % 20 = 0").select("vec_id", "embedding")
    near = nearest(centre, asked, 2).select("query_id", (-1 - F.col("vec_id")).cast("int").alias("label"))
    asked = near.join(asked.withColumnRenamed("vec_id", "query_id"), "query_id").select(F.col("label").alias("team"), F.col("query_id").alias("vec_id"), "embedding")
    return nearest_within(rows.select(F.col("label").alias("team"), "vec_id", "embedding"), asked, 5).select("query_id", "vec_id", "cosine")


def diversified(pool: DataFrame, k: int, weight: float) -> DataFrame:
    """(query_id, vec_id, place): k picks of a query's pool, each the best by weight x relevance less (1 - weight) x its greatest
    cosine to the picks before. Greedy by nature, so a query's pool, which is bounded, is one group."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        x = np.stack(rows["embedding"].map(lambda v: np.asarray(v, np.float64)))
        x /= np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
        gain, crowd, taken = weight * rows["cosine"].to_numpy(), np.full(len(rows), -np.inf), []
        while len(taken) < min(k, len(rows)):
            score = np.round(gain - (1 - weight) * np.where(np.isinf(crowd), 0, crowd), 6)
            score[taken] = -np.inf
            taken.append(int(score.argmax()))
            crowd = np.maximum(crowd, x @ x[taken[-1]])
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "vec_id": rows["vec_id"].to_numpy()[taken], "place": range(1, len(taken) + 1)})

    return pool.groupBy("query_id").applyInPandas(pick, "query_id bigint, vec_id bigint, place int")


@named("retrieve_diverse", f"""with recursive {_NEAR.format(k=30)}, p as (select query_id, list(vec_id order by rank) as ids, list(cosine order by rank) as rel, list(embedding::double[] order by rank) as vecs, count(*) as n from k join embeddings using (vec_id) group by query_id),
    s as (select query_id, ids, rel, vecs, n, 0 as place, []::bigint[] as taken from p union all
    select query_id, ids, rel, vecs, n, place + 1, list_append(taken, list_position(sc, list_max(sc))::bigint) from (select *, list_transform(range(1, n + 1), lambda i: case when list_contains(taken, i) then -9.0
        else round(0.7 * rel[i] - 0.3 * coalesce(list_max(list_transform(taken, lambda j: list_cosine_similarity(vecs[i], vecs[j]))), 0), 6) end) as sc from s where place < 8 and place < n))
    select query_id, ids[taken[place]] as vec_id, place from s where place > 0""")
def retrieve_diverse(spark, folder):
    """Maximal marginal relevance: eight of a pool of thirty."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return diversified(_near(spark, folder, 30).join(vectors, "vec_id").select("query_id", "vec_id", "cosine", "rank", "embedding"), 8, 0.7)


@named("eval_ranking", f"""with {_NEAR.format(k=10)}, g as (select query_id, rank, (label = wanted)::int as hit from k), i as (select sum(1 / log2(r + 1)) as ideal from range(1, 11) t(r))
    select query_id, round(sum(hit) / 10, 4)::double as precision_10, round(coalesce(1 / min(case when hit = 1 then rank end), 0), 4)::double as reciprocal, round(sum(hit / log2(rank + 1)) / max(ideal), 4)::double as ndcg from g, i group by query_id""")
def eval_ranking(spark, folder):
    """Precision, reciprocal rank and discounted gain of the ten nearest, where a hit shares the query's label."""
    hit = (F.col("label") == F.col("wanted")).cast("int")
    ideal = sum(1 / np.log2(r + 1) for r in range(1, 11))
    return _near(spark, folder, 10).groupBy("query_id").agg(
        F.round(F.sum(hit) / 10, 4).alias("precision_10"), F.round(F.coalesce(1 / F.min(F.when(hit == 1, F.col("rank"))), F.lit(0.0)), 4).alias("reciprocal"),
        F.round(F.sum(hit / F.log2(F.col("rank") + 1)) / float(ideal), 4).alias("ndcg"),
    )


@named("eval_calibration", f"""with {_NEAR.format(k=5)}, c as (select query_id, least(0.95, 0.3 + 0.15 * sum((1 - cosine < 0.5)::int))::double as c from k group by query_id)
    select query_id, round(c, 4) as confidence, case when round(c, 4) >= 0.8 then 'high' when round(c, 4) >= 0.5 then 'medium' else 'low' end as level from c""")
def eval_calibration(spark, folder):
    """Confidence by how many of the five nearest are near."""
    c = F.round(F.least(F.lit(0.95), 0.3 + 0.15 * F.sum((1 - F.col("cosine") < 0.5).cast("int"))), 4)
    n = _near(spark, folder, 5).groupBy("query_id").agg(c.alias("confidence"))
    return n.withColumn("level", F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low"))


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{4,}}'))"


@named("retrieve_keyword", f"""with q as (select item_id, unnest({_WORDS.format('text')}) as w, len({_WORDS.format('text')}) as total from benchmark), d as (select doc_id, unnest({_WORDS.format('text')}) as w from documents),
    m as (select item_id, doc_id, count(*) as hits, round(count(*) / max(total), 4) as share from q join d using (w) group by all)
    select item_id, doc_id, hits, share from (select *, row_number() over (partition by item_id order by hits desc, doc_id) as r from m) where r <= 10""")
def retrieve_keyword(spark, folder):
    """Ten documents that hold the most of an item's longer words. Only words of items are kept before the shuffle."""
    word = lambda df, key: df.select(key, F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{4,}"), F.lit(0))).alias("w"))
    items = word(table(spark, folder, "benchmark"), "item_id").select("item_id", F.size("w").alias("total"), F.explode("w").alias("word"))
    docs = word(table(spark, folder, "documents"), "doc_id").select("doc_id", F.explode("w").alias("word"))
    m = docs.join(items, "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"), F.round(F.count("*") / F.max("total"), 4).alias("share"))
    return m.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id"))).where("r <= 10").drop("r")


@named("retrieve_diagnostics", """with recursive q0 as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) as token from benchmark), q as (select item_id, token, count(*) as times from q0 group by all),
    d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') as t from documents), s as (select count(*) as n, avg(len(t)) as mean from d),
    tf as (select doc_id, len(t) as l, token, count(*) as tf from (select doc_id, t, unnest(t) as token from d) group by all), f as (select token, count(*) as df from tf group by token),
    score as (select item_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))), 6) as score from tf join f using (token) join q using (token), s group by all),
    top as (select * from (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from score) where r <= 10)
    select item_id, max(score) as best, round(avg(score), 4) as mean, count(*) as n, count(distinct source) as families, round(count(distinct source) / count(*), 3) as diversity from top join documents using (doc_id) group by item_id""")
def retrieve_diagnostics(spark, folder):
    """How good and how varied the ten best of each item are."""
    docs = table(spark, folder, "documents")
    top = bm25(docs, table(spark, folder, "benchmark"), 10)
    out = top.join(docs.select("doc_id", "source"), "doc_id").groupBy("item_id").agg(F.max("score").alias("best"), F.round(F.avg("score"), 4).alias("mean"), F.count("*").alias("n"), F.countDistinct("source").alias("families"))
    return out.withColumn("diversity", F.round(F.col("families") / F.col("n"), 3))


@named("score_academic", """with c as (select l_partkey, count(*) as cites from lineitem group by 1), y as (select l_partkey, max(year(o_orderdate)) as y from lineitem join orders on l_orderkey = o_orderkey group by 1)
    select p_partkey, round(least(0.1, ln(1 + coalesce(cites, 0)) * 0.02) + case when y >= 2021 then 0.05 when y >= 2016 then 0.02 else 0 end, 4)::double as boost from part left join c on l_partkey = p_partkey left join y on y.l_partkey = p_partkey""")
def score_academic(spark, folder):
    """Boost by citations and recency; lines carry both, so parts meet one grouping."""
    line, order = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    seen = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("l_partkey").agg(F.count("*").alias("cites"), F.max(F.year("o_orderdate")).alias("y"))
    recent = F.when(F.col("y") >= 2021, 0.05).when(F.col("y") >= 2016, 0.02).otherwise(0.0)
    boost = F.least(F.lit(0.1), F.log(1 + F.coalesce("cites", F.lit(0))) * 0.02) + recent
    return table(spark, folder, "part").join(seen, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.round(boost, 4).alias("boost"))
