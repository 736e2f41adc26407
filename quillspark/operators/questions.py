"""Rules over questions, names and texts: intent, width and parts of a question, names of files, markers, debate, support, unions and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.named import named
from ..sources.tables import table
from .quantiles import quantiles
from .ranking import _NEAR, _near

#: What a question holds if it asks for details, or for an overview; the weights of vectors, words and variety for each and for others.
DETAIL = ("methods", "methodology", "data", "sample", "dataset", "source", "table", "figure", "fig", "results", "estimate", "model", "identification", "quote", "page", "citation")
OVERVIEW = ("compare", "synthesize", "literature", "review", "history", "trend", "evolution", "summary", "overview")
WEIGHTS = ((0.45, 0.55, 0.5), (0.75, 0.25, 0.8), (0.65, 0.35, 0.65))
#: Patterns of an author in a question, and words that are none.
AUTHOR = (
    r"what does (\w+(?:\s\w+)?)\s+(?:argue|say|claim|find|show|propose|suggest|write)", r"according to (\w+(?:\s\w+)?)", r"(\w+(?:\s\w+)?)'s (?:argument|theory|model|finding|work|paper|claim)",
    r"(\w+(?:\s\w+)?) (?:\(\d{4}\)|\d{4})", r"in (\w+(?:\s\w+)?) and (?:\w+)",
)
NO_AUTHOR = ("how", "what", "why", "when", "the", "this", "that", "it")
#: Words of questions and of questions with several parts.
ASKING = ("what", "who", "when", "where", "why", "how")
SEVERAL = ("and", "or", "also", "both", "versus", "vs", "compare", "contrast", "difference", "between", "relationship", "relate")
#: Markers of disagreement, and patterns of it in answers.
DEBATE = (
    "however", "in contrast", "contradicts", "challenge this", "dispute", "on the other hand", "critics argue", "disagrees with", "rejects", "contrary to", "opposite finding", "mixed results", "no effect",
    "fails to find", "does not support", "inconsistent with",
)
DISAGREE = (
    r"however,?\s+(?:the|this|i|we|it)", "in contrast", "this (?:contradicts|challenges|disputes|overlooks)", "the (?:methodologist|librarian|analyst|skeptic) (?:ignores|misses|overlooks)",
    "insufficient evidence", "alternative interpretation",
)
#: Words of praise and of blame.
PRAISE = ("effective", "successful", "improved", "strengthened", "enhanced", "democratic", "equitable", "transparent", "efficient", "innovative", "progress", "achievement", "benefit", "empowerment")
BLAME = ("failure", "erosion", "decline", "dysfunction", "inequality", "corruption", "crisis", "fragmented", "inadequate", "problematic", "privatization", "retrenchment", "deficiency", "undermine")
#: Stages of a file by its name, first match first.
STAGES = (("final", r"\b(?:final|camera[-\s]?ready|accepted|published)\b"), ("preprint", r"\b(?:preprint|submission)\b"), ("draft", r"\b(?:draft|wip|working)\b"), ("revision", r"\b(?:v[0-9]+|rev[0-9]+|revision)\b"))
#: Citations by author and year.
CITED = (r"([A-Z][a-z]+)\s*\((\d{4})\)", r"\(([A-Z][a-z]+),?\s*(\d{4})\)", r"([A-Z][a-z]+)\s+et\s+al\.\s*\((\d{4})\)", r"([A-Z][a-z]+)\s+and\s+[A-Z][a-z]+\s*\((\d{4})\)")


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any(text: Column, values: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(v) for v in values))


def _how_many(text: Column, values: tuple[str, ...]) -> Column:
    return sum((text.contains(v).cast("int") for v in values), F.lit(0))


def _sql_any(text: str, values: tuple[str, ...]) -> str:
    return f"(list_sum(list_transform({_sql_list(values)}, lambda v: contains({text}, v)::int)) > 0)"


def _case(cond_values, other: str) -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in cond_values) + f" else {other} end"


@named("query_intent", "with q as (select conv_id, turn, lower(text) as q from conversations) select conv_id, turn, " + ", ".join(
    _case([(_sql_any("q", DETAIL), f"{WEIGHTS[0][i]}"), (_sql_any("q", OVERVIEW), f"{WEIGHTS[1][i]}")], f"{WEIGHTS[2][i]}") + f"::double as {name}" for i, name in enumerate(("vector_weight", "word_weight", "variety"))) + " from q")
def query_intent(spark, folder):
    """How a question weighs vectors, words and variety (QRY1, without learnt shifts)."""
    q = F.lower("text")
    by = lambda i: F.when(_any(q, DETAIL), WEIGHTS[0][i]).when(_any(q, OVERVIEW), WEIGHTS[1][i]).otherwise(WEIGHTS[2][i])
    return table(spark, folder, "conversations").select("conv_id", "turn", by(0).alias("vector_weight"), by(1).alias("word_weight"), by(2).alias("variety"))


def _author_sql(pattern: str) -> str:
    p = pattern.replace("'", "''")
    found = f"nullif(regexp_extract(text, '(?i){p}', 1), '')"
    return f"case when lower(trim({found})) not in ({', '.join(repr(w) for w in NO_AUTHOR)}) then trim({found}) end"


@named("query_author", f"with t as (select conv_id, turn, text || ' according to ' || split_part(text, ' ', 2) || ' (' || (1990 + conv_id % 30) || ')' as text from conversations where text is not null) select conv_id, turn, coalesce({', '.join(map(_author_sql, AUTHOR))}) as author from t")
def query_author(spark, folder):
    """The author a question names (QRY4). The turns name none, so each gets a clause that does."""
    year = (1990 + F.col("conv_id") % 30).cast("string")
    t = table(spark, folder, "conversations").where("text is not null")
    t = t.select("conv_id", "turn", F.concat("text", F.lit(" according to "), F.split_part(F.col("text"), F.lit(" "), F.lit(2)), F.lit(" ("), year, F.lit(")")).alias("text"))
    found = [F.trim(F.nullif(F.regexp_extract("text", f"(?i){p}", 1), F.lit(""))) for p in AUTHOR]
    return t.select("conv_id", "turn", F.coalesce(*[F.when(~F.lower(f).isin(*NO_AUTHOR), f) for f in found]).alias("author"))


_SPLIT = r"list_filter(regexp_split_to_array({}, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')"


@named("query_width", f"""with t as (select item_id, {_SPLIT.format('text')} as w from benchmark), n as (select item_id, len(w) as n, len(list_filter(w, lambda x: list_contains({_sql_list(ASKING)}, rtrim(lower(x), '?')))) as asks,
    len(list_filter(w, lambda x: list_contains({_sql_list(SEVERAL)}, lower(x)))) as several, len(list_filter(w, lambda x: regexp_matches(x, '^(?:[A-Z]|[0-9]{{4}})'))) as exact from t)
    select item_id, greatest(5, least(30, trunc(round(10 + 3 * (least(n / 10, 2.0) + several * 1.5 + greatest(0, asks - 1) * 0.5 - exact * 0.3), 6))::int)) as top_k from n""")
def query_width(spark, folder, base: int = 10, least: int = 5, most: int = 30):
    """How many results a question needs: more for long ones and several parts, fewer for exact names and years (QRY5)."""
    def width(w: Column) -> Column:
        count = lambda test: F.size(F.filter(w, test))
        several, exact = count(lambda x: F.lower(x).isin(*SEVERAL)), count(lambda x: x.rlike("^(?:[A-Z]|[0-9]{4})"))
        asks = count(lambda x: F.rtrim(F.lower(x), F.lit("?")).isin(*ASKING))
        score = F.least(F.size(w) / 10, F.lit(2.0)) + several * 1.5 + F.greatest(F.lit(0), asks - 1) * 0.5 - exact * 0.3
        return F.greatest(F.lit(least), F.least(F.lit(most), F.round(base + 3 * score, 6).cast("int")))

    return table(spark, folder, "benchmark").select("item_id", C.once(C.words(F.col("text")), width).alias("top_k"))


@named("query_parts", r"""with t as (select conv_id, turn, text, regexp_split_to_array(regexp_replace(regexp_replace(text, '\?(\s)', chr(1) || '\1', 'g'), ',\s*(\w{3,})', chr(1) || '\1', 'g'), '(?i)\band\b|\bor\b|\balso\b|;|' || chr(1)) as raw from conversations where text is not null),
    p as (select conv_id, turn, text, list_transform(list_filter(raw, lambda x: length(trim(x)) > 10), lambda x: rtrim(trim(x), '?.,')) as parts from t)
    select conv_id, turn, unnest(case when len(regexp_split_to_array(trim(text), '\s+')) > 5 and len(parts) > 1 then parts[1:5] else [text] end) as part from p""")
def query_parts(spark, folder, most: int = 5):
    """A question of several parts as rows (QRY6): cut at conjunctions and marks, at most five parts over ten characters; others whole."""
    t = table(spark, folder, "conversations").where("text is not null")
    marked = F.regexp_replace(F.regexp_replace("text", r"\?(\s)", "\x01$1"), r",\s*(\w{3,})", "\x01$1")
    raw = F.split(marked, r"(?i)\band\b|\bor\b|\balso\b|;|" + "\x01")
    parts = F.transform(F.filter(raw, lambda x: F.length(F.trim(x)) > 10), lambda x: F.rtrim(F.trim(x), F.lit("?.,")))
    long = F.size(F.split(F.trim("text"), r"\s+")) > 5
    return t.select("conv_id", "turn", F.explode(F.when(long & (F.size(parts) > 1), F.slice(parts, 1, most)).otherwise(F.array("text"))).alias("part"))


_FILE = "p_brand || '_' || (1990 + p_size % 25) || '_' || p_name || case p_size % 6 when 0 then ' Final' when 1 then ' [draft]' when 2 then ' #v2' when 3 then ' preprint v3' when 4 then ' rev1 working' else '' end || '.pdf'"


def _files(spark, folder) -> DataFrame:
    """(p_partkey, stem): names of files made of parts."""
    end = reduce(lambda c, k: c.when(F.col("p_size") % 6 == k[0], k[1]), [(1, " [draft]"), (2, " #v2"), (3, " preprint v3"), (4, " rev1 working")], F.when(F.col("p_size") % 6 == 0, " Final")).otherwise("")
    name = F.concat("p_brand", F.lit("_"), (1990 + F.col("p_size") % 25).cast("string"), F.lit("_"), "p_name", end, F.lit(".pdf"))
    return table(spark, folder, "part").select("p_partkey", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))


@named("name_tags", rf"""with f as (select p_partkey, regexp_replace({_FILE}, '\.[^.]*$', '') as stem from part) select p_partkey, coalesce(nullif(regexp_extract(stem, '#([A-Za-z0-9_-]+)', 1), ''), nullif(regexp_extract(stem, '\[([A-Za-z0-9_-]+)\]', 1), ''), '') as tag,
    {_case([(f"regexp_matches(lower(stem), '{p}')", f"'{s}'") for s, p in STAGES], "'unknown'")} as stage from f""")
def name_tags(spark, folder):
    """Tag and stage of a file by its name (PRJ3, PRJ6)."""
    f = _files(spark, folder)
    tag = F.coalesce(*[F.nullif(F.regexp_extract("stem", p, 1), F.lit("")) for p in (r"#([A-Za-z0-9_-]+)", r"\[([A-Za-z0-9_-]+)\]")], F.lit(""))
    stage = reduce(lambda c, k: c.when(F.lower("stem").rlike(k[1]), k[0]), STAGES[1:], F.when(F.lower("stem").rlike(STAGES[0][1]), STAGES[0][0])).otherwise("unknown")
    return f.select("p_partkey", tag.alias("tag"), stage.alias("stage"))


@named("name_citation", rf"""with f as (select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace({_FILE}, '\.[^.]*$', ''), '[_-]+', ' ', 'g'), '\s+', ' ', 'g')) as c from part), y as (select *, regexp_extract(c, '(?:19|20)\d{{2}}') as year from f),
    t as (select p_partkey, year, trim(split_part(trim(split_part(c, year, 1), ' -_()'), ',', 1)) as author, coalesce(nullif(trim(substr(c, strpos(c, year) + 4), ' -_()'), ''), c) as title from y)
    select *, trim(regexp_replace(lower(split_part(author, ' ', 1)), '[^a-z0-9]+', '_', 'g'), '_') || '_' || year || '_' || substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_'), 1, 50) as family from t""")
def name_citation(spark, folder):
    """Author, year and title that a file's name tells, and the family of its versions (PRJ8, PRJ10). All these names hold a year."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("stem", "[_-]+", " "), r"\s+", " "))
    f = _files(spark, folder).select("p_partkey", clean.alias("c")).withColumn("year", F.regexp_extract("c", r"(?:19|20)\d{2}", 0))
    ends, slug = F.lit(" -_()"), lambda x: F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_"))
    author = F.trim(F.split_part(F.btrim(F.split_part("c", "year", F.lit(1)), ends), F.lit(","), F.lit(1)))
    title = F.coalesce(F.nullif(F.btrim(F.substring(F.col("c"), F.instr(F.col("c"), F.col("year")) + 4, F.length("c")), ends), F.lit("")), F.col("c"))
    f = f.select("p_partkey", "year", author.alias("author"), title.alias("title"))
    return f.withColumn("family", F.concat_ws("_", slug(F.split_part("author", F.lit(" "), F.lit(1))), "year", F.substring(slug(F.col("title")), 1, 50)))


@named("text_concept", r"select doc_id, substr(regexp_replace(regexp_replace(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13))), '[ \t\n\r\f\x0B]+', ' ', 'g'), '^(?:the|a|an) +', ''), 1, 50) as concept from documents")
def text_concept(spark, folder):
    """The head of a text as a concept's key: lower case, one space, no leading article (PRJ28)."""
    t = F.regexp_replace(F.lower(F.btrim(F.col("text"), F.lit(" \t\n\r"))), C.SPACES, " ")
    return table(spark, folder, "documents").select("doc_id", F.substring(F.regexp_replace(t, "^(?:the|a|an) +", ""), 1, 50).alias("concept"))


_PARTS_OF = "text || ' See Figure ' || (doc_id % 9) || ', fig. 2 and Table 3: growth_rate = alpha * beta + ' || doc_id || '; Figure 2 again.'"


@named("text_markers", rf"""with d as (select doc_id, regexp_extract_all({_PARTS_OF}, '(?i)(?:figure|fig\.|table|tab\.|diagram)\s+\d+[:.]?\d*') as m, regexp_matches({_PARTS_OF}, '[A-Za-z][A-Za-z0-9_]{{0,20}}\s*=\s*[^.;\n]{{3,80}}') as equation from documents)
    select doc_id, array_to_string(list_filter(m, lambda x, i: list_position(list_transform(m, lambda y: lower(y)), lower(x)) = i)[1:6], '|') as markers, equation from d where m is not null""")
def text_markers(spark, folder, most: int = 6):
    """Figures and tables a text names, in order and once each, and whether it holds an equation (PRJ11, PRJ18). A sentence with some is put at the end of each text."""
    t = F.concat("text", F.lit(" See Figure "), (F.col("doc_id") % 9).cast("string"), F.lit(", fig. 2 and Table 3: growth_rate = alpha * beta + "), F.col("doc_id").cast("string"), F.lit("; Figure 2 again."))
    found = F.regexp_extract_all(t, F.lit(r"(?i)(?:figure|fig\.|table|tab\.|diagram)\s+\d+[:.]?\d*"), F.lit(0))
    once = C.once(found, lambda m: F.filter(m, lambda x, i: F.array_position(F.transform(m, F.lower), F.lower(x)) == i + 1))
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.array_join(F.slice(once, 1, most), "|").alias("markers"), t.rlike(r"[A-Za-z][A-Za-z0-9_]{0,20}\s*=\s*[^.;\n]{3,80}").alias("equation"))


@named("text_debate", f"select doc_id, list_sum(list_transform({_sql_list(DEBATE)}, lambda v: contains(lower(text), v)::int))::int as signals, substr(text, 1, 200) as preview from documents where {_sql_any('lower(text)', DEBATE)}")
def text_debate(spark, folder):
    """Texts with markers of disagreement, how many, and how they begin (TXT3)."""
    low = F.lower("text")
    return table(spark, folder, "documents").where(_any(low, DEBATE)).select("doc_id", _how_many(low, DEBATE).alias("signals"), F.substring("text", 1, 200).alias("preview"))


@named("text_consensus", f"""with d as (select source, {' + '.join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in DISAGREE)} as n from documents where text <> ''), g as (select source, count(*) as texts, sum(n)::bigint as signals from d group by source)
    select source, texts, signals, case when texts < 2 or signals = 0 then 'unanimous' when signals / texts < 1.5 then 'majority' when signals / texts < 3 then 'split' else 'contested' end as level, greatest(0, least(100, trunc(round(100 - signals / texts * 20, 6))))::int as score from g""")
def text_consensus(spark, folder):
    """Agreement among a source's texts by signs of disagreement a text (QRY14)."""
    n = sum((F.regexp_count(F.lower("text"), F.lit(p)) for p in DISAGREE), F.lit(0))
    g = table(spark, folder, "documents").where("text <> ''").groupBy("source").agg(F.count("*").alias("texts"), F.sum(n.cast("long")).alias("signals"))
    ratio = F.col("signals") / F.col("texts")
    level = F.when((F.col("texts") < 2) | (F.col("signals") == 0), "unanimous").when(ratio < 1.5, "majority").when(ratio < 3, "split").otherwise("contested")
    return g.select("source", "texts", "signals", level.alias("level"), F.greatest(F.lit(0), F.least(F.lit(100), F.round(100 - ratio * 20, 6).cast("int"))).alias("score"))


_CITING = "text || ' As ' || p || ' (' || y || ') shows (' || p || ', ' || y || '), and ' || p || ' et al. (' || (y + 1) || ') doubts.'"


@named("text_citations", f"""with d as (select doc_id, text, upper(substr(source, 1, 1)) || 'mith' as p, 1990 + doc_id % 30 as y from documents), t as (select doc_id, {_CITING} as t from d where regexp_matches(p, '^[A-Z]')),
    c as ({' union '.join(f"select doc_id, unnest(list_zip(regexp_extract_all(t, '{p}', 1), regexp_extract_all(t, '{p}', 2))) as z from t" for p in CITED)})
    select distinct doc_id, lower(z[1]) || '_' || z[2] as cited from c""")
def text_citations(spark, folder):
    """Author and year of what a text cites, once each (TXT7). A sentence that cites is put at the end of each text."""
    d = table(spark, folder, "documents").select("doc_id", "text", F.concat(F.upper(F.substring("source", 1, 1)), F.lit("mith")).alias("p"), (1990 + F.col("doc_id") % 30).alias("y")).where("p rlike '^[A-Z]'")
    y = F.col("y").cast("string")
    t = F.concat("text", F.lit(" As "), "p", F.lit(" ("), y, F.lit(") shows ("), "p", F.lit(", "), y, F.lit("), and "), "p", F.lit(" et al. ("), (F.col("y") + 1).cast("string"), F.lit(") doubts."))
    key = lambda z: F.concat_ws("_", F.lower(z["a"]), z["y"])
    found = [F.transform(F.arrays_zip(F.regexp_extract_all("t", F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all("t", F.lit(p), F.lit(2)).alias("y")), key) for p in CITED]
    return d.select("doc_id", t.alias("t")).select("doc_id", F.explode(F.array_distinct(F.concat(*found))).alias("cited"))


@named("text_sentiment", f"""with d as (select doc_id, lower(text) as t from documents), n as (select doc_id, list_sum(list_transform({_sql_list(PRAISE)}, lambda v: contains(t, v)::int)) as p, list_sum(list_transform({_sql_list(BLAME)}, lambda v: contains(t, v)::int)) as b from d)
    select doc_id, round((p - b) / greatest(1, p + b), 4)::double as sentiment from n where p is not null""")
def text_sentiment(spark, folder):
    """Praise less blame by words that a text holds (TXT20)."""
    low = F.lower("text")
    p, b = _how_many(low, PRAISE), _how_many(low, BLAME)
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.round((p - b) / F.greatest(F.lit(1), p + b), 4).alias("sentiment"))


@named("text_paragraphs", r"""with c as (select conv_id, turn, unnest(string_split(text, '. ')) as p, generate_subscripts(string_split(text, '. '), 1) as k from conversations where role = 'assistant'), m as (select conv_id, turn, k, case when k % 3 = 0 then p || ' [S1] [S2]' when k % 3 = 1 then p || ' [S' || (k + turn) || ']' else p end as p from c where trim(p) <> ''),
    n as (select *, list_transform(regexp_extract_all(p, '\[S(\d+)\]', 1), lambda x: x::int) as s from m), v as (select *, len(list_filter(s, lambda x: x between 1 and 4)) as good from n)
    select conv_id, turn, k::int as k, good::int as good, case when good >= 2 then 0.9 when good = 1 then 0.6 when len(s) > 0 then 0.1 when len(string_split(p, ' ')) < 15 then 0.5 else 0.2 end::double as confidence from v""")
def text_paragraphs(spark, folder, sources: int = 4):
    """Confidence of each part of an answer by the sources it cites (TXT24). Sentences stand for paragraphs, and get marks of sources, some of none."""
    c = table(spark, folder, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.split("text", r"\. ")).alias("k", "p")).withColumn("k", F.col("k") + 1).where("trim(p) <> ''")
    p = F.when(F.col("k") % 3 == 0, F.concat("p", F.lit(" [S1] [S2]"))).when(F.col("k") % 3 == 1, F.concat("p", F.lit(" [S"), (F.col("k") + F.col("turn")).cast("string"), F.lit("]"))).otherwise(F.col("p"))
    c = c.withColumn("p", p).withColumn("s", F.transform(F.regexp_extract_all("p", F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))
    good = F.size(F.filter("s", lambda x: x.between(1, sources)))
    level = F.when(good >= 2, 0.9).when(good == 1, 0.6).when(F.size("s") > 0, 0.1).when(F.size(F.split("p", " ")) < 15, 0.5).otherwise(0.2)
    return c.select("conv_id", "turn", "k", good.alias("good"), level.alias("confidence"))


@named("join_support", r"""with w as (select conv_id, turn, role, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) as w from conversations), a as (select conv_id, turn, w from w where role = 'assistant'), u as (select conv_id, w, min(turn) as since from w where role <> 'assistant' group by all)
    select a.conv_id, a.turn, count(*) as words, count(u.w) as held, round(count(u.w) / count(*), 4)::double as support from a left join u on a.conv_id = u.conv_id and a.w = u.w and u.since < a.turn group by a.conv_id, a.turn""")
def join_support(spark, folder):
    """Share of an answer's words that earlier turns of others hold (JN22)."""
    w = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("w"))
    held = w.where("role <> 'assistant'").groupBy("conv_id", "w").agg(F.min("turn").alias("since"))
    a = w.where("role = 'assistant'").join(held, ["conv_id", "w"], "left").withColumn("hit", F.col("since") < F.col("turn"))
    n = F.count(F.when(F.col("hit"), 1))
    return a.groupBy("conv_id", "turn").agg(F.count("*").alias("words"), n.alias("held"), F.round(n / F.count("*"), 4).alias("support"))


@named("join_sources", """with m as (select c.conv_id, c.turn, d.doc_id, d.source from conversations c left join documents d on d.doc_id = c.conv_id) select m.conv_id, m.turn, coalesce(m.source, p.url) as label from m left join pages p on m.source is null and p.page_id = m.conv_id""")
def join_sources(spark, folder):
    """A turn's source from the documents, else from the pages (JN5): two left joins, the second only where the first found none."""
    c, d, p = (table(spark, folder, t) for t in ("conversations", "documents", "pages"))
    first = c.join(d.select("doc_id", "source"), c.conv_id == d.doc_id, "left").select("conv_id", "turn", "source")
    return first.join(p.select("page_id", "url"), F.col("source").isNull() & (F.col("conv_id") == F.col("page_id")), "left").select("conv_id", "turn", F.coalesce("source", "url").alias("label"))


@named("set_collections", """with u as (select 'documents' as collection, 0 as o, doc_id as id, text from documents union all select 'benchmark', 1, item_id, text from benchmark union all select 'conversations', 2, conv_id * 1000 + turn, text from conversations)
    select collection, id from (select *, row_number() over (partition by md5(substr(coalesce(text, ''), 1, 200)) order by o, id) as r from u) where r = 1""")
def set_collections(spark, folder):
    """Collections as one, first wins among texts that begin alike (VEC14, VEC15, SET1); a minimum, so copies meet before the shuffle."""
    take = lambda name, o, key: table(spark, folder, name).select(F.struct(F.lit(o).alias("o"), key.alias("id"), F.lit(name).alias("collection")).alias("first"), F.md5(F.substring(F.coalesce("text", F.lit("")), 1, 200)).alias("head"))
    every = take("documents", 0, F.col("doc_id")).unionAll(take("benchmark", 1, F.col("item_id"))).unionAll(take("conversations", 2, F.col("conv_id") * 1000 + F.col("turn")))
    return every.groupBy("head").agg(F.min("first").alias("first")).select("first.collection", "first.id")


@named("filter_facets", "select doc_id, lang, source from documents d left join labels using (doc_id) where lang in ('en', 'de') and (contains(lower(source), '1') or contains(lower(text), 'the')) and coalesce(quality, 1) <> 0 and doc_id not in (select doc_id from labels where toxic = 1)")
def filter_facets(spark, folder):
    """Facets, a substring over columns, a tier, and an exclude list (FLT1, FLT2, FLT5, FLT6): column filters reach the scan, the list is an anti join."""
    labels = table(spark, folder, "labels")
    d = table(spark, folder, "documents").where(F.col("lang").isin("en", "de") & (F.lower("source").contains("1") | F.lower("text").contains("the")))
    d = d.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").join(labels, "doc_id", "left")
    return d.where("coalesce(quality, 1) <> 0").select("doc_id", "lang", "source")


@named("filter_after_rank", f"with {_NEAR.format(k=10)} select query_id, k.vec_id, cosine from k join (select vec_id, embedding[1] > 0 as up from embeddings) e on e.vec_id = k.vec_id where up")
def filter_after_rank(spark, folder):
    """Filters after the ten nearest are taken, so fewer may be left (FLT3, FLT4)."""
    up = table(spark, folder, "embeddings").where(F.col("embedding")[0] > 0).select("vec_id")
    return _near(spark, folder, 10).join(up, "vec_id").select("query_id", "vec_id", "cosine")


@named("retrieve_sufficient", f"""with {_NEAR.format(k=10)}, s as (select query_id, round(avg(cosine) filter (where rank <= 5), 4) as best, count(distinct label) filter (where rank <= 8) as labels, count(*) as n from k group by query_id)
    select query_id, best, labels, case when best < 0.35 then 'low_relevance' when labels < 2 and n >= 4 then 'low_diversity' else 'ok' end as reason from s""")
def retrieve_sufficient(spark, folder):
    """Whether a question's results are good and varied enough (VEC17)."""
    s = _near(spark, folder, 10).groupBy("query_id").agg(F.round(F.avg(F.when(F.col("rank") <= 5, F.col("cosine"))), 4).alias("best"), F.countDistinct(F.when(F.col("rank") <= 8, F.col("label"))).alias("labels"), F.count("*").alias("n"))
    return s.select("query_id", "best", "labels", F.when(F.col("best") < 0.35, "low_relevance").when((F.col("labels") < 2) & (F.col("n") >= 4), "low_diversity").otherwise("ok").alias("reason"))


@named("eval_gate", """with s as (select c_mktsegment as segment, avg((o_orderstatus = 'F')::int) as precision, quantile_cont(o_totalprice, 0.95) as p95, count(*) as n from orders join customer on o_custkey = c_custkey group by 1)
    select segment, round(precision, 4)::double as precision, round(p95, 2) as p95, n, case when precision < 0.3 then 'precision' when p95 > 450000 then 'latency' else 'pass' end as verdict from s""")
def eval_gate(spark, folder):
    """Aggregates of a group against its gates, the first that fails named (STA26); shares of filled orders stand for precision, prices for latencies."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("segment"), "o_orderstatus", "o_totalprice")
    s = rows.groupBy("segment").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("a"), F.count("*").alias("n"))
    s = s.join(quantiles(rows, "segment", "o_totalprice", {"b": 0.95}), "segment", "left")
    return s.select("segment", F.round("a", 4).alias("precision"), F.round("b", 2).alias("p95"), "n", F.when(F.col("a") < 0.3, "precision").when(F.col("b") > 450000, "latency").otherwise("pass").alias("verdict"))


@named("agg_halves", """with d as (select event_type, ts::date as day, avg(value) as v from events group by all), r as (select *, row_number() over (partition by event_type order by day) as i, count(*) over (partition by event_type) as n from d),
    h as (select event_type, avg(v) filter (where i <= n // 2) as early, avg(v) filter (where i > n // 2) as late from r group by 1) select event_type, round(late - early, 4) as change, case when late - early > 0.05 then 'improving' when late - early < -0.05 then 'declining' else 'stable' end as trend from h""")
def agg_halves(spark, folder):
    """Trend by the means of the days' first and second half (AGG27). Days are few, whatever the events."""
    d = table(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("event_type")
    first = F.row_number().over(w.orderBy("day")) <= F.floor(F.count("*").over(w) / 2)
    h = d.withColumn("first", first).groupBy("event_type").agg((F.avg(F.when(~F.col("first"), F.col("v"))) - F.avg(F.when(F.col("first"), F.col("v")))).alias("c"))
    return h.select("event_type", F.round("c", 4).alias("change"), F.when(F.col("c") > 0.05, "improving").when(F.col("c") < -0.05, "declining").otherwise("stable").alias("trend"))


@named("agg_quality", "select lang, count(*) as n, count(quality) as labelled, round(avg(nullif(n_chars, 0)), 2) as mean, min(nullif(n_chars, 0)) as least, max(n_chars) as most, sum((quality = 1)::int)::bigint as good from documents left join labels using (doc_id) group by lang")
def agg_quality(spark, folder):
    """Counts, and mean, least and most of non-zero sizes, by language (AGG19)."""
    d, n = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left"), F.nullif(F.col("n_chars"), F.lit(0))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.round(F.avg(n), 2).alias("mean"), F.min(n).alias("least"), F.max("n_chars").alias("most"), F.sum((F.col("quality") == 1).cast("int")).alias("good"))


@named("train_queue", "with c as (select l_orderkey, round(avg(l_discount) * 10, 4) as confidence from lineitem group by 1) select l_orderkey, confidence from c where confidence <= 0.5 order by confidence, l_orderkey limit 100")
def train_queue(spark, folder):
    """The hundred least sure, for labelling next (STA23); a top-k report."""
    c = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg("l_discount") * 10, 4).alias("confidence"))
    return c.where("confidence <= 0.5").orderBy("confidence", "l_orderkey").limit(100)


@named("score_recommended", """with b as (select o_custkey, l_partkey from lineitem join orders on l_orderkey = o_orderkey group by all), k as (select o_custkey, p_brand, count(*) as n from b join part on l_partkey = p_partkey group by all),
    top as (select * from (select *, row_number() over (partition by o_custkey order by n desc, p_brand) as r from k) where r = 1), s as (select t.o_custkey, p_partkey, 2 * n + p_size % 3 + 1 as score from top t join part p on p.p_brand = t.p_brand left join b on b.o_custkey = t.o_custkey and b.l_partkey = p_partkey where b.l_partkey is null)
    select o_custkey, p_partkey, score from (select *, row_number() over (partition by o_custkey order by score desc, p_partkey) as r from s) where r <= 3""")
def score_recommended(spark, folder):
    """Three parts a customer has not bought, of the brand bought most (STA18). What a
    customer's score adds to a part's is the same for all parts of the brand, so parts are ranked once a brand, and a customer who bought n of it needs the first n + 3."""
    line, order, part = (table(spark, folder, t) for t in ("lineitem", "orders", "part"))
    b = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct()
    k = b.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("o_custkey", "p_brand").agg(F.count("*").alias("n"))
    top = k.groupBy("o_custkey").agg(F.min(F.struct((-F.col("n")).alias("n"), "p_brand")).alias("t")).select("o_custkey", (-F.col("t.n")).alias("n"), "t.p_brand")
    most = (top.agg(F.max("n")).first()[0] or 0) + 3
    order = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc(F.col("p_size") % 3), "p_partkey"))
    first = part.select("p_brand", "p_partkey", "p_size", order.alias("place")).where(F.col("place") <= most)
    s = top.select("o_custkey", "n", "p_brand", F.explode(F.sequence(F.lit(1), (F.col("n") + 3).cast("int"))).alias("place")).join(first, ["p_brand", "place"])
    s = s.join(b.withColumnRenamed("l_partkey", "p_partkey"), ["o_custkey", "p_partkey"], "left_anti")
    s = s.select("o_custkey", "p_partkey", (2 * F.col("n") + F.col("p_size") % 3 + 1).alias("score"))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("score"), "p_partkey"))).where("r <= 3").drop("r")


_EXPORTS = {
    "ris": "'TY  - GEN' || chr(10) || 'TI  - ' || p_name || chr(10) || 'AU  - ' || p_brand || chr(10) || 'PY  - ' || (1990 + p_size) || chr(10) || 'ER  - '",
    "refworks": "'RT Generic' || chr(10) || 'T1 ' || p_name || chr(10) || 'A1 ' || p_brand || chr(10) || 'YR ' || (1990 + p_size)",
    "apa": "p_brand || ' (' || (1990 + p_size) || '). ' || p_name || '.'",
    "chicago": "p_brand || '. ' || (1990 + p_size) || '. \"' || p_name || '.\"'",
    "latex": "'\\bibitem{part' || p_partkey || '} ' || p_brand || ', \\emph{' || p_name || '}, ' || (1990 + p_size) || '.'",
    "anki": "p_name || chr(9) || p_brand || ' (' || (1990 + p_size) || ')'",
}


@named("sink_references", " union all ".join(f"select p_partkey, '{k}' as style, md5({v}) as entry_md5 from part" for k, v in _EXPORTS.items()))
def sink_references(spark, folder):
    """References of parts in six styles (SNK6)."""
    year = (1990 + F.col("p_size")).cast("string")
    entry = {
        "ris": F.concat(F.lit("TY  - GEN\nTI  - "), "p_name", F.lit("\nAU  - "), "p_brand", F.lit("\nPY  - "), year, F.lit("\nER  - ")),
        "refworks": F.concat(F.lit("RT Generic\nT1 "), "p_name", F.lit("\nA1 "), "p_brand", F.lit("\nYR "), year),
        "apa": F.concat("p_brand", F.lit(" ("), year, F.lit("). "), "p_name", F.lit(".")),
        "chicago": F.concat("p_brand", F.lit(". "), year, F.lit('. "'), "p_name", F.lit('."')),
        "latex": F.concat(F.lit("\\bibitem{part"), F.col("p_partkey").cast("string"), F.lit("} "), "p_brand", F.lit(", \\emph{"), "p_name", F.lit("}, "), year, F.lit(".")),
        "anki": F.concat("p_name", F.lit("\t"), "p_brand", F.lit(" ("), year, F.lit(")")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("style"), F.md5(v).alias("entry_md5")) for k, v in entry.items()])
    return table(spark, folder, "part").select("p_partkey", F.explode(rows).alias("x")).select("p_partkey", "x.style", "x.entry_md5")


@named("text_restored", """with w as (select item_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as i from benchmark) select item_id, md5(string_agg(w, ' ' order by i)) as text_md5 from w group by item_id""")
def text_restored(spark, folder):
    """Texts put together again from inverted indexes, words with their places (PRJ26)."""
    w = table(spark, folder, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    index = w.groupBy("item_id", "w").agg(F.sort_array(F.collect_list("i")).alias("places"))
    placed = index.select("item_id", "w", F.explode("places").alias("i")).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("p"))
    return placed.select("item_id", F.md5(F.array_join("p.w", " ")).alias("text_md5"))


#: Greetings that need no search, starts of simple questions, words of hard ones.
GREETINGS = (
    "hello", "hi ", "hey ", "hey!", "hi!", "thanks", "thank you", "help", "who are you", "what can you do", "how do you work", "good morning", "good afternoon", "good evening", "goodbye", "bye",
    "hi there", "hey there", "what's up", "sup",
)
SIMPLE = ("what is", "define", "when was", "who", "list", "name", "how many", "yes or no", "true or false", "which year")
HARD = (
    "compare", "contrast", "synthesize", "analyze", "evaluate", "critique", "causal", "counterfactual", "mechanism", "endogeneity", "instrument", "regression discontinuity", "difference-in-differences",
    "deep dive", "methodological", "literature review", "theoretical framework", "explain how", "explain why", "what are the implications",
)


@named("query_kind", f"""with q as (select conv_id, turn, lower(trim(text)) as q from conversations where text is not null), n as (select *, len(regexp_split_to_array(q, ' +')) as n, list_sum(list_transform({_sql_list(HARD)}, lambda v: contains(q, v)::int)) as hard from q)
    select conv_id, turn, n <= 3 and {_sql_any('q', GREETINGS)} as skipped, case when n < 8 and list_sum(list_transform({_sql_list(SIMPLE)}, lambda v: starts_with(q, v)::int)) > 0 then 'simple' when hard >= 2 or hard >= 1 and n > 20 or len(q) - len(replace(q, '?', '')) > 1 then 'complex' else 'standard' end as kind from n""")
def query_kind(spark, folder):
    """Whether a question needs no search, and how hard it is (FLT7, QRY11)."""
    q = table(spark, folder, "conversations").where("text is not null").select("conv_id", "turn", F.lower(F.trim("text")).alias("q"))
    n, hard, text = F.size(F.split("q", " +")), _how_many(F.col("q"), HARD), F.col("q")
    simple = (n < 8) & reduce(lambda a, b: a | b, (text.startswith(v) for v in SIMPLE))
    complex_ = (hard >= 2) | (hard >= 1) & (n > 20) | (F.length("q") - F.length(F.replace("q", F.lit("?"), F.lit(""))) > 1)
    return q.select("conv_id", "turn", ((n <= 3) & _any(text, GREETINGS)).alias("skipped"), F.when(simple, "simple").when(complex_, "complex").otherwise("standard").alias("kind"))


@named("text_similar_parts", r"""with w as (select doc_id, unnest(string_split(text, chr(10))) as p, generate_subscripts(string_split(text, chr(10)), 1) as k from documents), s as (select doc_id, k, list_distinct(regexp_extract_all(lower(p), '[a-z]{4,}')) as s from w),
    n as (select doc_id, k, s, lag(s) over (partition by doc_id order by k) as b from s) select doc_id, k::int as k, round(len(list_intersect(s, b)) / greatest(1, len(list_distinct(list_concat(s, b)))), 4)::double as likeness from n where b is not null""")
def text_similar_parts(spark, folder):
    """Likeness of each line to the one before by the words of both (DUP8), within the row."""
    lines = F.split("text", "\n")
    sets = F.transform(lines, lambda p: F.array_distinct(F.regexp_extract_all(F.lower(p), F.lit("[a-z]{4,}"), F.lit(0))))
    like = lambda s: F.transform(s, lambda x, i: F.when(i > 0, F.round(F.size(F.array_intersect(x, F.get(s, i - 1))) / F.greatest(F.lit(1), F.size(F.array_union(x, F.get(s, i - 1)))), 4)))
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", F.posexplode(C.once(sets, like)).alias("k", "likeness"))
    return rows.where("likeness is not null").select("doc_id", (F.col("k") + 1).alias("k"), "likeness")


@named("graph_confounders", """with up as (select 's' || s_suppkey as node, 'n' || s_nationkey as above from supplier union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation),
    a as (select node, above from up union all select u.node, v.above from up u join up v on v.node = u.above), t as (select distinct 's' || l_suppkey as cause, 'c' || o_custkey as effect from lineitem join orders on l_orderkey = o_orderkey)
    select cause, effect, count(b.above) as confounders from t left join a on a.node = t.cause left join a b on b.node = t.effect and b.above = a.above group by cause, effect""")
def graph_confounders(spark, folder):
    """Ancestors that cause and effect share (GRF14): suppliers and customers of an order, under nations and regions. Nodes have few ancestors, so pairs stay about as many as links."""
    name = lambda prefix, column: F.concat(F.lit(prefix), F.col(column))
    up = table(spark, folder, "supplier").select(name("s", "s_suppkey").alias("node"), name("n", "s_nationkey").alias("above"))
    up = up.unionAll(table(spark, folder, "customer").select(name("c", "c_custkey"), name("n", "c_nationkey"))).unionAll(table(spark, folder, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    above = up.unionAll(up.alias("u").join(up.alias("v"), F.col("u.above") == F.col("v.node")).select("u.node", "v.above")).groupBy("node").agg(F.collect_set("above").alias("above"))
    line, order = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    pairs = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(name("s", "l_suppkey").alias("cause"), name("c", "o_custkey").alias("effect")).distinct()
    one, two = above.select(F.col("node").alias("cause"), F.col("above").alias("x")), above.select(F.col("node").alias("effect"), F.col("above").alias("y"))
    return pairs.join(one, "cause", "left").join(two, "effect", "left").select("cause", "effect", F.coalesce(F.size(F.array_intersect("x", "y")), F.lit(0)).cast("long").alias("confounders"))
