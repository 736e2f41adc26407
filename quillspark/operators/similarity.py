"""Exact duplicates, fingerprints and overlap of short texts."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import columns as C
from ..plans.named import named
from ..sources.tables import table
from .network import kept


@named("dup_exact_groups", r"""with k as (select doc_id, md5(trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g'))) as key from documents)
    select key, count(*) as n, min(doc_id) as keep from k group by key having count(*) > 1""")
def dup_exact_groups(spark, folder):
    key = F.md5(C.clean(F.lower("text")))
    return table(spark, folder, "documents").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("keep")).where("n > 1")


@named("dup_keep_first", r"""select min(doc_id) as doc_id from documents group by md5(trim(regexp_replace(regexp_replace(lower(text), '\b(a|an|the|is|are|was|were)\b', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')))""")
def dup_keep_first(spark, folder):
    """First document of each text, articles and forms of be aside; counted as a minimum, so copies meet before the shuffle."""
    key = F.md5(F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"\b(a|an|the|is|are|was|were)\b", " "), C.SPACES, " ")))
    return table(spark, folder, "documents").groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@named("dup_families", "select source, count(*) as n from documents group by source having count(*) > 1")
def dup_families(spark, folder):
    return table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n")).where("n > 1")


_GRAMS = "list_distinct(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 3], ' ')))"


@named(
    "dup_benchmark_share",
    f"""with b as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]{{2,}}') as w from benchmark where len(text) >= 50), q as (select item_id, {_GRAMS} as g from b where len(w) >= 4),
    d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]{{2,}}') as w from documents), dg as (select doc_id, unnest({_GRAMS}) as g from d where len(w) >= 4),
    one as (select item_id, len(g) as total, unnest(g) as g from q)
    select item_id, doc_id, round(count(*) / max(total), 4) as share from one join dg using (g) group by item_id, doc_id having count(*) / max(total) > 0.7""",
)
def dup_benchmark_share(spark, folder):
    """Share of a benchmark item's 4-grams that a document holds, where over 0.7."""
    def four(df, key):
        return df.select(key, C.grams(C.tokens(F.col("text")), 4).alias("g"))

    items = four(table(spark, folder, "benchmark").where(F.length("text") >= 50), "item_id")
    one = items.select("item_id", F.size("g").alias("total"), F.explode("g").alias("gram"))
    docs = four(table(spark, folder, "documents"), "doc_id").select("doc_id", F.explode("g").alias("gram"))
    both = docs.join(one, "gram").groupBy("item_id", "doc_id").agg((F.count("*") / F.max("total")).alias("share"))
    return both.where("share > 0.7").select("item_id", "doc_id", F.round("share", 4).alias("share"))


@named("dup_similar_titles", """with t as (select p_partkey, list_distinct(string_split(lower(p_name), ' ')) as w, p_brand from part),
    g as (select p_brand, w, min(p_partkey) as keep, count(*) as n from t group by all) select keep, n, len(w) as n_words from g where n > 1""")
def dup_similar_titles(spark, folder):
    """Parts of a brand whose names are the same set of words."""
    w = F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " ")))
    g = table(spark, folder, "part").groupBy("p_brand", w.alias("w")).agg(F.min("p_partkey").alias("keep"), F.count("*").alias("n"))
    return g.where("n > 1").select("keep", "n", F.size("w").cast("long").alias("n_words"))


def dealt(rows: DataFrame, keys: list[str], by: str, bucket: int) -> tuple[DataFrame, DataFrame]:
    """rows twice, to be joined on keys and deal: every two rows of a key meet once in either order. Keys of one row go; those of many are
    cut in deals of about `bucket` rows, each against all of the key, so no task holds a hot key, and a small table still fills the cores.
    Exploded rows are planned by the size of the few they come from, so joins are asked to merge: else the planner may send them whole through the driver."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys, F.ceil(F.col("n") / bucket).cast("int").alias("deals"))
    rows, parts = rows.join(n.hint("merge"), keys), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = rows.withColumn("deal", F.pmod(F.xxhash64(by), F.col("deals")).cast("int")).drop("deals").repartition(parts, *keys, "deal")
    return mine, rows.select("*", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal")).drop("deals")


def title_links(titles: DataFrame, id: str, title: str, share: float = 0.6, bucket: int = 200) -> DataFrame:
    """One row a title: id, class_id (least id of titles of the same words, repeats included), n_links (other classes that share more than
    `share` of the longer title's words). Words are those of ASCII letters and digits, others are cut out; titles without any are left out.

    Classes meet on prefixes only: of n words in one order, so many that titles over the share must have one of them in common."""
    w = F.sort_array(F.filter(F.split(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", ""), r"\s+"), lambda x: x != ""))
    rows = titles.select(F.col(id), w.alias("w")).where(F.size("w") > 0)
    classes = rows.groupBy("w").agg(F.min(id).alias("class_id")).withColumn("s", F.array_distinct("w")).withColumn("n", F.size("w"))
    least = F.floor(F.col("n") * share).cast("int") + 1
    heads = classes.where(F.size("s") >= least).select("class_id", "s", "n", F.explode(F.slice("s", F.lit(1), F.size("s") - least + 1)).alias("word"))
    heads, other = dealt(heads, ["word"], "class_id", bucket)
    other = other.select("word", "deal", F.col("class_id").alias("b"), F.col("s").alias("t"), F.col("n").alias("m"))
    both = F.array_intersect("s", "t")
    met = (F.col("class_id") != F.col("b")) & (F.size(both) / F.greatest("n", "m") > share) & (F.col("word") == both[0])
    links = heads.join(other.hint("merge"), ["word", "deal"]).where(met).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return rows.join(classes.select("w", "class_id"), "w").join(links, "class_id", "left").select(id, "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


@named("dup_title_links", r"""with t as (select p_partkey, list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(p_name || ' ' || p_type || ' size ' || p_size), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda x: x <> '')) as w from part),
    c as (select w, min(p_partkey) as class_id from t where len(w) > 0 group by w), n as (select a.class_id, count(*) as n from c a join c b on a.class_id <> b.class_id and len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) > 0.6 group by 1)
    select p_partkey, class_id, coalesce(n, 0) as n_links from t join c using (w) left join n using (class_id)""")
def dup_title_links(spark, folder):
    """Titles that share over 0.6 of the longer one's words (DUP7): classes of the same words, and how many others each links to."""
    title = F.concat_ws(" ", "p_name", "p_type", F.lit("size"), F.col("p_size").cast("string"))
    return title_links(table(spark, folder, "part").select("p_partkey", title.alias("title")), "p_partkey", "title")


@F.pandas_udf(LongType())
def simhash64(words: pd.Series) -> pd.Series:
    """64-bit fingerprints of lists of words: a bit is set if it is in the low half of more than half the words' md5, repeats included."""
    out = np.zeros(len(words), np.int64)
    for i, row in enumerate(words):
        counts = Counter(() if row is None else row)
        if counts:
            low = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[8:] for w in counts), np.uint8).reshape(-1, 8)
            votes = np.fromiter(counts.values(), np.int64) @ np.unpackbits(low, axis=1).astype(np.int64)
            out[i] = np.packbits(votes * 2 > len(row)).view(">i8")[0]
    return pd.Series(out)


def bit_links(prints: DataFrame, distance: int = 5, bucket: int = 1000) -> DataFrame:
    """(f, n_links, first): for each distinct fingerprint f that has others at `distance` bits or fewer (5 at most), how many, and the least `id` among theirs.
    prints: (f long, id), one row a fingerprint.

    Of 5 differing bits at most 2 are in one half, so two fingerprints share that half with one bit turned at most on either side: each goes
    to 66 keys of 32 bits. A pair counts at one of the keys it shares, and is summed before the shuffle."""
    if not 0 <= distance <= 5:
        raise ValueError("distance must be 0 to 5")
    low = F.col("f").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("f", 32)
    turned = lambda side, half: F.transform(F.concat(F.array(F.lit(0).cast("long")), F.array(*[F.lit(1 << i).cast("long") for i in range(32)])), lambda b: F.struct(F.lit(side).alias("side"), half.bitwiseXOR(b).alias("k")))
    keys = prints.select("f", "id", F.explode(F.concat(turned(0, high), turned(1, low))).alias("x")).select("f", "id", "x.side", "x.k")
    mine, theirs = dealt(keys, ["side", "k"], "f", bucket)
    theirs = theirs.select("side", "k", "deal", F.col("f").alias("g"), F.col("id").alias("other"))
    part = lambda c, side: F.shiftrightunsigned(c, 32) if side == 0 else F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    half = lambda c: F.when(F.col("side") == 0, part(c, 0)).otherwise(part(c, 1))
    apart = half("f").bitwiseXOR(half("g"))
    last = apart.bitwiseAND(-apart)
    meets = F.col("k") == F.least(half("f").bitwiseXOR(last), half("g").bitwiseXOR(last))
    first = (F.col("side") == 0) | (F.bit_count(part("f", 0).bitwiseXOR(part("g", 0))) > 2)
    linked = (F.col("f") != F.col("g")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= distance) & (F.bit_count(apart) <= 2) & first & meets
    return mine.join(theirs.hint("merge"), ["side", "k", "deal"]).where(linked).groupBy("f").agg(F.count("*").alias("n_links"), F.min("other").alias("first"))


def simhash_links(docs: DataFrame, id: str, text: str, distance: int = 5) -> DataFrame:
    """One row a document: id, fingerprint (16 hex digits), class_id (least id with the same fingerprint), n_links (other fingerprints at
    `distance` bits or fewer), kept (no lesser id in its class or directly linked). Null and empty texts have fingerprint 0, linked like others."""
    rows = kept(docs.select(F.col(id), simhash64(C.words(F.lower(text))).alias("f")))
    prints = rows.groupBy("f").agg(F.min(id).alias("id"))
    links = bit_links(prints, distance)
    each = prints.withColumnRenamed("id", "class_id").join(links.hint("merge"), "f", "left")
    first = (F.col(id) == F.col("class_id")) & (F.col("first").isNull() | (F.col("first") > F.col(id)))
    return rows.join(each.hint("merge"), "f").select(id, F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), first.alias("kept"))


@named("dup_simhash", r"""with w as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) as w from documents), c as (select doc_id, w, count(*) as n from w group by all),
    h as (select w, ('0x' || substr(md5(w), 17, 16))::ubigint as h from c group by w), v as (select doc_id, i, sum(case when (h >> i::ubigint) % 2 = 1 then n else -n end) as s from c join h using (w), range(64) r(i) group by all),
    f as (select d.doc_id, coalesce(sum(case when s > 0 then 1::hugeint << i::int end), 0)::ubigint as f from documents d left join v using (doc_id) group by 1), p as (select f, min(doc_id) as class_id from f group by f),
    n as (select a.f, count(*) as n, min(b.class_id) as first from p a join p b on a.f <> b.f and bit_count(xor(a.f, b.f)) <= 5 group by a.f)
    select doc_id, lower(lpad(to_hex(f), 16, '0')) as fingerprint, class_id, coalesce(n, 0) as n_links, doc_id = class_id and coalesce(first > doc_id, true) as kept from f join p using (f) left join n using (f)""")
def dup_simhash(spark, folder):
    """Near copies by 64-bit fingerprints of md5 of words up to 5 bits apart, over all documents (DUP5)."""
    return simhash_links(table(spark, folder, "documents"), "doc_id", "text")


@named("dup_timeline_events", "select distinct year(o_orderdate)::int as year, o_orderpriority as label from orders")
def dup_timeline_events(spark, folder):
    return table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("label")).distinct()


@named("dup_turns", """select conv_id, turn, text from (select *, row_number() over (partition by conv_id, md5(lower(text)) order by turn) as rn from conversations) where rn = 1""")
def dup_turns(spark, folder):
    """Turns of a conversation without those that repeat an earlier one."""
    first = Window.partitionBy("conv_id", F.md5(F.lower("text"))).orderBy("turn")
    return table(spark, folder, "conversations").withColumn("rn", F.row_number().over(first)).where("rn = 1").select("conv_id", "turn", "text")
