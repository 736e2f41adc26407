"""Text normalisation, chunking and tagging of whole tables, a row in and rows out, without shuffles unless a key groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.named import named
from ..sources.tables import chunks, table

_SQL_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"


@named("text_clean", r"select doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))) as clean_md5, len(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))) as n from documents")
def text_clean(spark, folder):
    clean = C.clean(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast("long").alias("n"))


@named(
    "text_density",
    rf"""with d as (select doc_id, trim(text) as t, {_SQL_WORDS.format('lower(trim(text))')} as w from documents)
    select doc_id, case when len(t) < 20 then 0.0 else round(len(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / greatest(len(t), 1) * 0.3 + len(list_distinct(w)) / greatest(len(w), 1) * 0.3
    + least(len(regexp_extract_all(t, '[.!?]+')) / 5.0, 1.0) * 0.2 + case when regexp_matches(t, '\([A-Z][a-z]+.*?(19|20)\d{{2}}\)') then 1.0 else 0.5 end * 0.2, 3) end::double as density from d""",
)
def text_density(spark, folder):
    return table(spark, folder, "documents").select("doc_id", C.density(F.col("text")).alias("density"))


@named("text_tokens", "with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) as token from documents) select token, count(*) as n, count(distinct doc_id) as n_docs from t group by token")
def text_tokens(spark, folder):
    """Corpus and document frequency of every token. A row gives its tokens, and each once more for the document, so both are sums of the same rows."""
    return C.frequencies(table(spark, folder, "documents"), C.tokens(F.col("text")), "token")


@named("text_token_estimate", "select source, count(*) as docs, sum(len(text))::bigint as chars, round(sum(len(text) / 4.0), 2) as tokens from documents group by source")
def text_token_estimate(spark, folder):
    n = F.length("text")
    return table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(n).alias("chars"), F.round(F.sum(n / 4.0), 2).alias("tokens"))


@named(
    "text_language",
    "with w as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as w from documents), s as (select doc_id, "
    + ", ".join(f"len(list_intersect(w, string_split('{v}', ' '))) as {k}" for k, v in C.LANGUAGE_WORDS.items())
    + " from w) select doc_id, case when greatest(en, es, fr, de, pt) <= 3 then 'unknown' "
    + " ".join(f"when {k} = greatest(en, es, fr, de, pt) then '{k}'" for k in C.LANGUAGE_WORDS)
    + " end as language, round(greatest(en, es, fr, de, pt) / 15, 3) as confidence from s",
)
def text_language(spark, folder):
    """Share of a language's frequent words that the whole text holds; over 0.2, or unknown. Ties go to the first. C.languages takes a number of first words, too."""
    found = C.languages(F.col("text"))
    s = table(spark, folder, "documents").select("doc_id", *[n.alias(k) for k, n in found])
    best = F.greatest(*[k for k, _ in found])
    named_ = F.when(best <= 3, F.lit("unknown"))
    for k, _ in found:
        named_ = named_.when(F.col(k) == best, F.lit(k))
    return s.select("doc_id", named_.alias("language"), F.round(best / 15, 3).alias("confidence"))


@named(
    "text_redact",
    "with r as (select doc_id, text, "
    + "".join("regexp_replace(" for _ in C.REDACTED) + "text" + "".join(f", '{p}', '{t}', 'g')" for p, t in C.REDACTED)
    + " as clean from documents) select doc_id, md5(clean) as clean_md5, clean <> text as changed from r",
)
def text_redact(spark, folder):
    clean = C.redact(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), (clean != F.col("text")).alias("changed"))


@named(
    "text_sanitize_html",
    r"select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '(?i)javascript:|on[a-z]+\s*=', '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'))) as clean_md5 from pages",
)
def text_sanitize_html(spark, folder):
    bare = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"(?i)javascript:|on[a-z]+\s*=", "")
    return table(spark, folder, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(bare, C.SPACES, " "))).alias("clean_md5"))


@named(
    "text_path_topics",
    r"""with p as (select page_id, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') as p from pages)
    select page_id, p[1] as project, case when len(p) >= 3 then p[2] else p[1] end as topic from p""",
)
def text_path_topics(spark, folder):
    """Project is a path's first part, topic the second if there are three parts, else the first."""
    p = F.split(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/")
    return table(spark, folder, "pages").select("page_id", p[0].alias("project"), F.when(F.size(p) >= 3, p[1]).otherwise(p[0]).alias("topic"))


@named(
    "text_doc_type",
    """select page_id, case when regexp_matches(lower(url), 'chapter') then 'chapter' when regexp_matches(lower(url), 'slide') then 'slides' when regexp_matches(lower(url), '[.](pdf|docx)') then 'paper'
    when regexp_matches(lower(url), '[.](csv|dta)') then 'data' when regexp_matches(lower(url), '[?]') then 'query' else 'other' end as doc_type from pages""",
)
def text_doc_type(spark, folder):
    url, kind = F.lower("url"), None
    for pattern, name in (("chapter", "chapter"), ("slide", "slides"), ("[.](pdf|docx)", "paper"), ("[.](csv|dta)", "data"), ("[?]", "query")):
        kind = (F if kind is None else kind).when(url.rlike(pattern), F.lit(name))
    return table(spark, folder, "pages").select("page_id", kind.otherwise("other").alias("doc_type"))


@named("text_heading", r"""with d as (select doc_id, string_split(text, chr(10))[1] as line from documents), w as (select *, """ + _SQL_WORDS.format("line") + r""" as w from d)
    select doc_id, line as heading from w where len(w) between 2 and 12 and len(line) <= 90""")
def text_heading(spark, folder):
    """The first line, where it is short enough to be a heading."""
    d = table(spark, folder, "documents").select("doc_id", F.split("text", "\n", 2)[0].alias("heading"))
    return d.where(F.size(C.words(F.col("heading"))).between(2, 12) & (F.length("heading") <= 90))


@named(
    "chunk_overlap",
    f"""with d as (select doc_id, {_SQL_WORDS.format('text')} as w from documents), s as (select doc_id, w, unnest(range(0, greatest(len(w), 1), 450)) as a from d where len(w) > 0)
    select doc_id, a // 450 as chunk, len(w[a + 1:a + 500]) as n_words, md5(array_to_string(w[a + 1:a + 500], ' ')) as chunk_md5 from s""",
)
def chunk_overlap(spark, folder):
    c = chunks(spark, folder, 500, 50)
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size(C.words(F.col("text"))).cast("long").alias("n_words"), F.md5("text").alias("chunk_md5"))


@named(
    "chunk_graph",
    f"""with d as (select doc_id, source, {_SQL_WORDS.format('text')} as w from documents), s as (select *, unnest(range(0, len(w), 500)) as a from d),
    c as (select doc_id, source, a, array_to_string(w[a + 1:a + 500], ' ') as t from s) select doc_id, source || '_' || substr(sha256(substr(t, 1, 100)), 1, 12) as chunk_id, a // 800 + 1 as page from c""",
)
def chunk_graph(spark, folder):
    c = chunks(spark, folder, 500, 0)
    key = F.concat_ws("_", "source", F.substring(F.sha2(F.substring("text", 1, 100), 256), 1, 12))
    return c.select("doc_id", key.alias("chunk_id"), (F.floor(F.col("chunk") * 500 / 800) + 1).alias("page"))


@named(
    "chunk_levels",
    f"""with d as (select doc_id, {_SQL_WORDS.format('text')} as w from documents),
    l as (select doc_id, 'paragraph' as level, len(w) as n, unnest(range(0, len(w), 220)) as a, 250 as size, 20 as least from d union all select doc_id, 'section', len(w), unnest(range(0, len(w), 740)), 800, 50 from d)
    select doc_id, level, count(*) as chunks, sum(least(size, n - a))::bigint as words from l where least(size, n - a) >= least group by all
    union all select doc_id, 'document', 1, 300 from d where len(w) > 100""",
)
def chunk_levels(spark, folder):
    """Paragraph, section and document level chunks: how many of each and their words."""
    d = table(spark, folder, "documents").select("doc_id", F.size(C.words(F.col("text"))).alias("n"))
    out = d.where("n > 100").select("doc_id", F.lit("document").alias("level"), F.lit(1).cast("long").alias("chunks"), F.lit(300).cast("long").alias("words"))
    for level, size, step, least in (("paragraph", 250, 220, 20), ("section", 800, 740, 50)):
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(step)), lambda a: F.least(F.lit(size), F.col("n") - a))  # noqa: B023
        each = F.filter(each, lambda x: x >= least)  # noqa: B023
        rows = d.withColumn("e", each).where("size(e) > 0")
        out = out.unionAll(rows.select("doc_id", F.lit(level), F.size("e").cast("long"), F.aggregate("e", F.lit(0).cast("long"), lambda s, x: s + x)))
    return out


@named(
    "chunk_tree",
    f"""with d as (select doc_id, {_SQL_WORDS.format('text')} as w from documents),
    l as (select doc_id, 'paragraph' as level, w, unnest(range(0, len(w), 220)) as a, 250 as size, 20 as least, 220 as step from d union all select doc_id, 'section', w, unnest(range(0, len(w), 740)), 800, 50, 740 from d),
    c as (select doc_id, level, a // step as chunk, w[a + 1:a + size] as t, a // 740 as section from l where least(size, len(w) - a) >= least union all select doc_id, 'document', 0, w[1:300], null from d where len(w) > 100)
    select doc_id, level, chunk, case level when 'document' then null when 'section' then 0 else section end as parent, len(t) as words, md5(array_to_string(t, ' ')) as text_md5 from c""",
)
def chunk_tree(spark, folder):
    """The chunks of three levels themselves (CHK3): paragraphs of 250 words, sections of 800, and a document's first 300, each with its text and the section, or the
    document, that it begins in."""
    w = C.words(F.col("text"))
    d = table(spark, folder, "documents").select("doc_id", "text", F.size(w).alias("n"))

    def level(name: str, size: int, step: int, least: int, parent) -> DataFrame:
        cut = d.select("doc_id", F.posexplode(C.windows_of_words(F.col("text"), size, size - step)).alias("chunk", "t"))
        n = F.size(F.split("t", " "))
        return cut.where(n >= least).select("doc_id", F.lit(name).alias("level"), F.col("chunk").cast("long").alias("chunk"), parent.cast("long").alias("parent"), n.cast("long").alias("words"), F.md5("t").alias("text_md5"))

    head = F.array_join(F.slice(w, 1, 300), " ")
    whole = d.where("n > 100").select("doc_id", F.lit("document").alias("level"), F.lit(0).cast("long").alias("chunk"), F.lit(None).cast("long").alias("parent"), F.least(F.col("n"), F.lit(300)).cast("long").alias("words"), F.md5(head).alias("text_md5"))
    return level("paragraph", 250, 220, 20, F.floor(F.col("chunk") * 220 / 740)).unionAll(level("section", 800, 740, 50, F.lit(0))).unionAll(whole)


@named("text_repetition", """with s as (select doc_id, unnest(regexp_split_to_array(lower(text), '[.!?\\n]+')) as s from documents), t as (select doc_id, trim(s) as s from s where len(trim(s)) >= 30)
    select doc_id, md5(s) as sentence_md5, count(*) as n from t group by doc_id, s having count(*) >= 3""")
def text_repetition(spark, folder):
    """Sentences of 30 characters or more that a document holds three times or more."""
    s = table(spark, folder, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"[.!?\n]+")).alias("s")).select("doc_id", F.trim("s").alias("s"))
    return s.where(F.length("s") >= 30).groupBy("doc_id", F.md5("s").alias("sentence_md5")).agg(F.count("*").alias("n")).where("n >= 3")


@named(
    "chunk_topics",
    r"""with recursive d as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda p: p <> '') as p from documents),
    w as (select *, list_transform(p, lambda x: list_distinct(regexp_extract_all(lower(x), '[\p{L}\p{N}_]{3,}'))) as w from d where list_sum(list_transform(p, lambda x: len(x))) > 1800),
    s as (select doc_id, p, w, 1 as i, [[]]::varchar[][] as raw, p[1] as cur from w union all
    select doc_id, p, w, i + 1, case when len(here) > 1800 then list_append(case when cur = '' then raw else list_append(raw, [cur]) end, list_transform(range(0, (ceil((len(here) - 1800) / 1550.0) + 1)::int), lambda k: substr(here, k * 1550 + 1, 1800)))
    when cur <> '' and over then list_append(raw, [cur]) else raw end,
    case when len(here) > 1800 then '' when cur = '' then here when over and len(p[i]) < 250 and not shift then p[i] || chr(10) || chr(10) || here when over then here else cur || chr(10) || chr(10) || here end
    from (select *, len(cur) + len(here) + 2 > 1800 or (shift and len(cur) > 600) as over from (select *, p[i + 1] as here, len(list_intersect(w[i], w[i + 1])) / greatest(len(list_distinct(w[i] || w[i + 1])), 1) < 0.15 as shift from s where i < len(p)))),
    r as (select doc_id, flatten(case when cur = '' then raw else list_append(raw, [cur]) end) as c from s where i = len(p)),
    u as (select doc_id, unnest(c) as t, generate_subscripts(c, 1) as k from r), h as (select *, sum((k = 1 or len(t) >= 100)::int) over (partition by doc_id order by k) as g from u),
    m as (select doc_id, g, string_agg(t, chr(10) || chr(10) order by k) as t from h group by all),
    f as (select doc_id, t, row_number() over (partition by doc_id order by g) - 1 as chunk from m where len(trim(t)) >= 20 and len(list_filter(regexp_split_to_array(t, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) >= 3 and len(regexp_replace(t, '[^\p{L}]', '', 'g')) >= 0.2 * len(t)),
    o as (select doc_id, array_to_string(p, chr(10) || chr(10)) as t, 0 as chunk from d where len(p) > 0 and list_sum(list_transform(p, lambda x: len(x))) <= 1800)
    select doc_id, chunk::bigint as chunk, len(t)::bigint as n, md5(t) as chunk_md5 from (select doc_id, t, chunk from f union all select doc_id, t, chunk from o)""",
)
def chunk_topics(spark, folder, size: int = 1800, overlap: int = 250, boundary: str = "\n"):
    """Chunks that end where the topic does; paragraphs are lines here."""
    d = table(spark, folder, "documents").select("doc_id", C.paragraphs(F.col("text"), boundary).alias("p"))
    c = d.select("doc_id", F.posexplode(C.chunks_by_topic(F.col("p"), size, overlap)).alias("chunk", "t"))
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("t").cast("long").alias("n"), F.md5("t").alias("chunk_md5"))
