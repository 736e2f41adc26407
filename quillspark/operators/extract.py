"""What texts and pages hold: sections, addresses, threats, sentences, word pairs; and exports of rows as strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.named import named
from ..sources.tables import chunks, table
from .ranking import retrieve_keyword
from .text import _SQL_WORDS

#: Kinds of unsafe input and what shows them.
THREATS = {
    "sql": r"(?i)union\s+select|drop\s+table|;\s*--|or\s+1\s*=\s*1",
    "script": r"(?i)<script|javascript:|on(error|load|click)\s*=",
    "path": r"[.][.]/|%2e%2e",
}

#: Attempts to steer a model, and their weights; 5 together is unsafe.
STEERING = [(r"(?i)ignore (all |the )?(previous|above)", 5), (r"(?i)you are now", 3), (r"(?i)system prompt", 4), (r"(?i)act as", 2), (r"(?i)jailbreak|developer mode", 5)]


@named(
    "text_threats",
    "select page_id, array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(html, '{p}') then '{k}' end" for k, p in THREATS.items()) + "], lambda x: x is not null), ',') as threats, len(html)::bigint as n from pages",
)
def text_threats(spark, folder):
    kinds = F.array_compact(F.array(*[F.when(F.col("html").rlike(p), F.lit(k)) for k, p in THREATS.items()]))
    return table(spark, folder, "pages").select("page_id", F.array_join(kinds, ",").alias("threats"), F.length("html").cast("long").alias("n"))


_RISK = " + ".join(f"case when regexp_matches(text, '{p}') then {w} else 0 end" for p, w in STEERING)


@named("text_steering", f"select conv_id, turn, {_RISK} as risk, {_RISK} >= 5 as unsafe from conversations where role = 'user'")
def text_steering(spark, folder):
    risk = sum(F.when(F.col("text").rlike(p), w).otherwise(0) for p, w in STEERING)
    return table(spark, folder, "conversations").where("role = 'user'").select("conv_id", "turn", risk.alias("risk"), (risk >= 5).alias("unsafe"))


@named("text_address", r"""with u as (select page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) as query from pages)
    select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, host, regexp_extract(host, '([^.]+[.][^.]+)$', 1) as domain, case when query = '' then 0 else len(string_split(query, '&')) end::bigint as n_params from u""")
def text_address(spark, folder):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    query = F.regexp_extract("url", "^[^?#]*[?]([^#]*)", 1)
    p = table(spark, folder, "pages").withColumn("host", host).withColumn("q", query)
    return p.select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), "host", F.regexp_extract("host", "([^.]+[.][^.]+)$", 1).alias("domain"), F.when(F.col("q") == "", 0).otherwise(F.size(F.split("q", "&"))).cast("long").alias("n_params"))


@named("source_sections", r"""with s as (select page_id, regexp_split_to_array(html, '(?i)<h[1-6][^>]*>') as s from pages), e as (select page_id, unnest(s) as part, generate_subscripts(s, 1) - 1 as section from s)
    select page_id, section, len(t) as n, md5(t) as text_md5 from (select page_id, section, trim(regexp_replace(regexp_replace(part, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) as t from e)""")
def source_sections(spark, folder):
    """Pages cut at their headings, tags dropped."""
    e = table(spark, folder, "pages").select("page_id", F.posexplode(F.split("html", "(?i)<h[1-6][^>]*>")).alias("section", "part"))
    t = e.select("page_id", F.col("section").cast("long").alias("section"), F.trim(F.regexp_replace(F.regexp_replace("part", "<[^>]*>", " "), C.SPACES, " ")).alias("t"))
    return t.select("page_id", "section", F.length("t").cast("long").alias("n"), F.md5("t").alias("text_md5"))


@named("text_compress", r"""with d as (select doc_id, text, substr(text, 1, 400) as head from documents), c as (select doc_id, text, case when regexp_matches(head, '(?s)[.!?]') then regexp_extract(head, '(?s)^(.*[.!?])', 1) else head end as head from d)
    select doc_id, md5(case when len(text) <= 800 then text else head || ' [...] ' || right(text, 400) end) as text_md5, len(text) > 800 as cut from c""")
def text_compress(spark, folder):
    """Long texts as their first half-budget, to the end of a sentence, and their last."""
    head = F.substring("text", 1, 400)
    head = F.when(head.rlike("[.!?]"), F.regexp_extract(head, "(?s)^(.*[.!?])", 1)).otherwise(head)
    short = F.length("text") <= 800
    return table(spark, folder, "documents").select("doc_id", F.md5(F.when(short, F.col("text")).otherwise(F.concat(head, F.lit(" [...] "), F.substring("text", -400, 400)))).alias("text_md5"), (~short).alias("cut"))


@named(
    "chunk_filter",
    f"""with d as (select doc_id, source, {_SQL_WORDS.format('text')} as w from documents), s as (select *, unnest(range(0, len(w), 100)) as a from d), c as (select source, array_to_string(w[a + 1:a + 120], ' ') as t, len(w[a + 1:a + 120]) as n from s)
    select source, count(*) as chunks, sum((len(t) >= 20 and n >= 3 and len(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) >= 0.2 * len(t))::int)::bigint as good from c group by source""",
)
def chunk_filter(spark, folder):
    """Chunks that are long and wordy enough to index, by source."""
    t = F.col("text")
    good = (F.length(t) >= 20) & (F.size(C.words(t)) >= 3) & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 0.2 * F.length(t))
    return chunks(spark, folder).groupBy("source").agg(F.count("*").alias("chunks"), F.sum(good.cast("int")).alias("good"))


@named("text_bigrams", """with t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') as t from documents), p as (select doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as bigram from t)
    select bigram, count(*) as n, count(distinct doc_id) as n_docs from p group by bigram having count(distinct doc_id) >= 3""")
def text_bigrams(spark, folder):
    """Word pairs of three documents or more."""
    pairs = C.once(C.tokens(F.col("text")), lambda t: F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.size(t)), lambda a, b: F.concat_ws(" ", a, b)))
    return C.frequencies(table(spark, folder, "documents"), pairs, "bigram").where("n_docs >= 3")


@named("text_detail", r"""with d as (select doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) as s from documents)
    select doc_id, s::bigint as sentences, round(len(w) / s, 3) as words_a_sentence, round(len(list_distinct(w)) / greatest(len(w), 1), 3) as variety, round(len(list_filter(w, lambda x: len(x) > 6)) / greatest(len(w), 1), 3) as long_words from d""")
def text_detail(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"), F.greatest(F.regexp_count("text", F.lit("[.!?]+")), F.lit(1)).alias("s"))
    n = F.greatest(F.size("w"), F.lit(1))
    return d.select("doc_id", F.col("s").cast("long").alias("sentences"), F.round(F.size("w") / F.col("s"), 3).alias("words_a_sentence"), F.round(F.size(F.array_distinct("w")) / n, 3).alias("variety"), F.round(F.size(F.filter("w", lambda x: F.length(x) > 6)) / n, 3).alias("long_words"))


@named("agg_snapshot", """with h0 as (select source, doc_id as k, 1 as n, sha256(text) as h from documents), h1 as (select source, k // 1000 as k, sum(n) as n, sha256(string_agg(h, '' order by k)) as h from h0 group by 1, 2),
    h2 as (select source, k // 1000 as k, sum(n) as n, sha256(string_agg(h, '' order by k)) as h from h1 group by 1, 2), h3 as (select source, k // 1000 as k, sum(n) as n, sha256(string_agg(h, '' order by k)) as h from h2 group by 1, 2)
    select source, sum(n)::bigint as n, sha256(string_agg(h, '' order by k)) as snapshot from h3 group by source""")
def agg_snapshot(spark, folder):
    """A hash of each source's documents in order: of a thousand ids, of a thousand such blocks, and of a thousand of these, so that a list has a
    thousand hashes at most up to 10^12 ids."""
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda r: r["h"]), ""), 256).alias("h")
    h = table(spark, folder, "documents").select("source", F.col("doc_id").alias("k"), F.lit(1).cast("long").alias("n"), F.sha2("text", 256).alias("h"))
    for _ in range(3):
        h = h.groupBy("source", F.expr("k div 1000").alias("block")).agg(F.sum("n").alias("n"), joined).withColumnRenamed("block", "k")
    return h.groupBy("source").agg(F.sum("n").alias("n"), joined.alias("snapshot"))


@named("sink_bibtex", """select p_partkey, '@misc{' || lower(replace(p_brand, '#', '')) || '_' || p_partkey || ', title={' || p_name || '}, note={' || p_type || '}, pages={' || p_size || '}}' as entry from part""")
def sink_bibtex(spark, folder):
    """A reference entry for each part."""
    key = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    return table(spark, folder, "part").select("p_partkey", F.concat(F.lit("@misc{"), key, F.lit("_"), "p_partkey", F.lit(", title={"), "p_name", F.lit("}, note={"), "p_type", F.lit("}, pages={"), "p_size", F.lit("}}")).alias("entry"))


def first_of_each(lists: DataFrame, most: float) -> DataFrame:
    """(item_id, doc_id) of result lists (item_id, place, doc_id, words) without those whose words overlap an earlier kept one by
    more than `most`. Order is the meaning, so a list, which is a top-k, is one group."""

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows, kept = rows.sort_values("place"), []
        for doc, words in zip(rows["doc_id"], rows["words"].map(set), strict=True):
            if all(len(words & other) <= most * len(words | other) for _, other in kept):
                kept.append((doc, words))
        return pd.DataFrame({"item_id": rows["item_id"].iloc[0], "doc_id": [doc for doc, _ in kept]})

    return lists.groupBy("item_id").applyInPandas(keep, "item_id bigint, doc_id bigint")


@named("dup_result_lists", """with recursive q as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}'))) as w from benchmark), dw as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) as ws from documents),
    m as (select item_id, doc_id, count(*) as hits from q join (select doc_id, unnest(ws) as w from dw) using (w) group by all), k as (select * from (select *, row_number() over (partition by item_id order by hits desc, doc_id) as r from m) where r <= 10),
    p as (select item_id, list(doc_id order by r) as ids, list(ws order by r) as ws, count(*) as n from k join dw using (doc_id) group by item_id),
    s as (select item_id, ids, ws, n, 0 as i, []::bigint[] as kept from p union all select item_id, ids, ws, n, i + 1, case when len(list_filter(kept, lambda j: len(list_intersect(ws[i + 1], ws[j])) > 0.5 * len(list_distinct(ws[i + 1] || ws[j])))) = 0 then list_append(kept, i + 1) else kept end from s where i < n)
    select item_id, ids[unnest(kept)] as doc_id from s where i = n""")
def dup_result_lists(spark, folder):
    """The ten documents by shared words, less those that share over half their words with one above."""
    docs = table(spark, folder, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{4,}"), F.lit(0))).alias("words"))
    top = retrieve_keyword(spark, folder).withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id")))
    return first_of_each(top.join(docs, "doc_id").select("item_id", "place", "doc_id", "words"), 0.5)
