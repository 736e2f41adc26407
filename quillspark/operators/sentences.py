"""Claims, terms and tone of texts, turns of topic in conversations, readers of marked-up texts, and weights of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.named import SQL, named
from ..sources.files import scratch
from ..sources.tables import table
from .network import parts_of
from .questions import _how_many, _sql_list, text_citations
from .ranking import _NEAR, _near

_SIDE, _BEFORE = r"([A-Za-z0-9_][A-Za-z0-9_ \t\n\r\f]{2,40})", r"(?:^|[^A-Za-z0-9_])"
_MOVE = r"(?:increase|decrease|change)\s+in\s+"
#: Forms of claims, their names and how sure they are, two sides each; words of doubt; causes that name nothing.
LINKS = tuple((_BEFORE + _SIDE + link + _SIDE, name, sure) for link, name, sure in (
    (r"\s+(?:causes?|caus(?:ed|ing))\s+", "causes", 0.9), (r"\s+(?:leads?\s+to|led\s+to)\s+", "leads_to", 0.85), (r"\s+(?:results?\s+in|resulted\s+in)\s+", "results_in", 0.85),
    (r"\s+(?:produces?|produced)\s+", "produces", 0.8), (r"\s+(?:triggers?|triggered)\s+", "triggers", 0.85), (r"\s+(?:drives?|drove)\s+", "drives", 0.8),
    (r"\s+(?:is\s+associated\s+with|correlates?\s+with)\s+", "association", 0.5), (r"\s+(?:shapes?|shaped|influences?|influenced)\s+", "influences", 0.7),
    (r"\s+(?:enables?|enabled|constrains?|constrained)\s+", "enables_constrains", 0.75),
    (r"\s+(?:mediates?|mediated)\s+(?:the\s+)?(?:effect|relationship|link)\s+(?:between|of)\s+", "mediator", 0.85),
    (r"\s+(?:moderates?|moderated)\s+(?:the\s+)?(?:effect|relationship)\s+(?:of|between)\s+", "moderator", 0.8),
)) + (
    (_MOVE + _SIDE + r"\s+(?:leads?\s+to|causes?|results?\s+in)\s+(?:an?\s+)?" + _MOVE + _SIDE, "mechanism", 0.9),
    (r"without\s+" + _SIDE + r",?\s+" + _SIDE + r"\s+would", "counterfactual", 0.9),
    (r"if\s+" + _SIDE + r"\s+(?:were|was|had\s+been)\s+(?:not\s+)?(?:[A-Za-z0-9_]+),?\s+" + _SIDE, "counterfactual", 0.85),
)
#: One of these is in every claim; sentences without are left out before the forms, which are dear, are tried.
_CLUES = r"(?i)caus|leads?\s+to|led\s+to|results?\s+in|resulted\s+in|produce|trigger|drive|drove|associated\s+with|correlates?\s+with|shape|influence|enable|constrain|mediate|moderate|without\s.*would|if\s.*\s(?:were|was|had\s+been)\s"
DOUBT = ("may", "might", "could", "possibly", "suggests")
NO_CAUSE = ("this", "that", "it", "they", "which")
#: What tells the tone of a text, by tone, in order of preference on ties.
TONES = {
    "theoretical": ("framework", "mechanism", "causal", "hypothesis", "theory", "operationalize", "construct", "endogenous", "exogenous"),
    "empirical": ("data", "regression", "coefficient", "significant", "sample", "variable", "estimate", "robust", "standard error"),
    "descriptive": ("describes", "shows", "example", "case", "story", "narrative", "situation", "context", "background"),
    "journalistic": ("shocking", "amazing", "incredible", "huge", "clearly", "obviously", "everyone knows", "it is clear that"),
    "institutional": ("institution", "rules", "norms", "constraints", "actors", "incentives", "equilibrium", "transaction costs"),
}
#: Words that tell nothing of what goes with a term, and of a turn's topic; methods that speak for a source.
NO_COMPANY = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "for", "and", "nor", "but", "or", "yet", "so", "at", "by",
    "in", "of", "on", "to", "up", "it", "its", "with", "from", "this", "that", "not", "no", "which", "who", "whom", "what", "how", "when", "where",
)
NO_TOPIC = ("about", "their", "these", "would", "could", "should", "there", "where", "which", "think", "really", "being")
METHODS = (
    "regression", "instrumental variable", "fixed effect", "difference-in-differences", "rdd", "rct", "randomized", "natural experiment", "panel data", "cross-sectional", "time series", "bayesian",
    "maximum likelihood",
)

_CLAIMING = """text || '. Growth in ' || source || case doc_id % 6 when 0 then ' may lead to change of ' when 1 then ' LEADS' || chr(10) || 'to change of ' when 2 then ' shapes the course of ' when 3 then ' mediates the effect of '
    when 4 then ' would end. Without help from ' || source || ', growth of the state would stop. A change in ' || source || ' causes an increase in ' else ' would end. If rent in ' || source || ' had been not lower, births of ' end || lang || case when doc_id % 2 = 0 then ' (2001).' else '.' end"""


def claims(text: Column) -> Column:
    """Array of (cause, effect, link, confidence): what a text's sentences of 20 characters or more say to follow from what, less sure by 0.3 of it with words of doubt, surer by 0.15 of it with a year cited.
    Case doesn't matter, and a claim may go over the end of a line."""
    sentences = F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.btrim(s, F.lit(" \t\n\r\f\x0b"))), lambda s: (F.length(s) >= 20) & s.rlike(_CLUES.replace(".*", r"[\s\S]*")))

    def of(s: Column) -> Column:
        doubt, cited = _how_many(F.lower(s), DOUBT) > 0, s.rlike(r"\d{4}\)")

        def one(link: str, name: str, sure: float) -> Column:
            side = lambda i: F.transform(F.regexp_extract_all(s, F.lit("(?i)" + link), F.lit(i)), lambda x: F.substring(F.btrim(x, F.lit(" \t\n\r\f\x0b")), 1, 60))
            level = F.when(doubt, sure * 0.7).otherwise(sure)
            level = F.round(F.when(cited, F.least(level * 1.15, F.lit(1.0))).otherwise(level), 3)
            return F.zip_with(side(1), side(2), lambda a, b: F.struct(a.alias("cause"), b.alias("effect"), F.lit(name).alias("link"), level.alias("confidence")))

        found = F.concat(*[one(*x) for x in LINKS])
        return F.filter(found, lambda c: (F.length(c["cause"]) >= 3) & (F.length(c["effect"]) >= 3) & ~F.lower(c["cause"]).isin(*NO_CAUSE))

    return F.flatten(F.transform(sentences, of))


_ONE_CLAIM = " union all ".join(
    f"select doc_id, s, unnest(list_zip(regexp_extract_all(s, '(?i){link}', 1), regexp_extract_all(s, '(?i){link}', 2))) as z, '{name}' as link, {sure}::double as sure from s" for link, name, sure in LINKS
)


@named("text_claims", rf"""with t as (select doc_id, unnest(regexp_split_to_array({_CLAIMING}, '[.!?]+')) as s from documents), s as (select doc_id, trim(s, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) as s from t where len(trim(s, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) >= 20),
    c as ({_ONE_CLAIM}), n as (select doc_id, link, substr(trim(z[1], chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), 1, 60) as cause, substr(trim(z[2], chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), 1, 60) as effect, sure * case when list_sum(list_transform({_sql_list(DOUBT)}, lambda v: contains(lower(s), v)::int)) > 0 then 0.7::double else 1 end as sure, regexp_matches(s, '\d{{4}}\)') as cited from c)
    select doc_id, cause, effect, link, round(case when cited then least(sure * 1.15::double, 1) else sure end, 3) as confidence from n where len(cause) >= 3 and len(effect) >= 3 and lower(cause) not in {NO_CAUSE}""")
def text_claims(spark, folder):
    """What texts say to follow from what (TXT11), within the row. Sentences that claim are put at the end of each text."""
    return table(spark, folder, "documents").select("doc_id", F.explode(claims(F.expr(_CLAIMING.replace("chr(10)", "char(10)")))).alias("c")).select("doc_id", "c.*")


@named("agg_claims", f"""with c as ({SQL["text_claims"]}) select cause, effect, count(*) as n, round(avg(confidence), 4) as confidence, count(distinct link) as links, round(count(*) * avg(confidence), 3) as weight from c group by cause, effect""")
def agg_claims(spark, folder):
    """Claims of all texts as links with how often, how sure and by how many kinds (AGG24)."""
    sure = F.avg("confidence")
    return text_claims(spark, folder).groupBy("cause", "effect").agg(F.count("*").alias("n"), F.round(sure, 4).alias("confidence"), F.countDistinct("link").alias("links"), F.round(F.count("*") * sure, 3).alias("weight"))


_TERM, _MEANS = r"([A-Z][A-Za-z0-9\- ]{3,90})\s+\(([A-Z]{2,12})\)", r"([A-Z][A-Za-z0-9\- ]{2,90})\s+(?:is|are|refers to|means)\s+([^.;]{20,260})"
_DEFINING = "text || '. Rate Of Return (ROR) is what a holding of ' || source || ' yields in a year; Mean Loss (ML) means the average of what is lost over ' || doc_id || ' cases.'"


@named("text_terms", rf"""with t as (select doc_id, {_DEFINING} as t from documents where text is not null), c as (select doc_id, 'short' as kind, unnest(list_zip(regexp_extract_all(t, '{_TERM}', 1), regexp_extract_all(t, '{_TERM}', 2))) as z from t
    union all select doc_id, 'meaning', unnest(list_zip(regexp_extract_all(t, '{_MEANS}', 1), regexp_extract_all(t, '{_MEANS}', 2))) from t), n as (select kind, trim(z[1]) as term, trim(z[2]) as said from c)
    select kind, term, count(*) as n, arg_min(said, (len(said), said)) as said from n group by kind, term""")
def text_terms(spark, folder):
    """Terms with their short forms and shortest meanings over all texts (TXT9). A sentence that defines two is put at the end of each text."""
    t = F.concat("text", F.lit(". Rate Of Return (ROR) is what a holding of "), "source", F.lit(" yields in a year; Mean Loss (ML) means the average of what is lost over "), F.col("doc_id").cast("string"), F.lit(" cases."))
    pairs = lambda pattern, kind: F.zip_with(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)), lambda a, b: F.struct(F.lit(kind).alias("kind"), F.trim(a).alias("term"), F.trim(b).alias("said")))
    rows = table(spark, folder, "documents").where("text is not null").select(F.explode(F.concat(pairs(_TERM, "short"), pairs(_MEANS, "meaning"))).alias("c")).select("c.*")
    return rows.groupBy("kind", "term").agg(F.count("*").alias("n"), F.min(F.struct(F.length("said").alias("l"), F.col("said"))).getField("said").alias("said"))


_TONE = ", ".join(f"round(list_sum(list_transform({_sql_list(v)}, lambda v: contains(lower(text), v)::int)) / {len(v)}, 2) as {k}" for k, v in TONES.items())
_TOP = "greatest(" + ", ".join(TONES) + ")"


@named("text_tone", f"""with s as (select doc_id, {_TONE} from documents where text is not null) select doc_id, {_TOP}::double as share, case {' '.join(f"when {k} = {_TOP} then '{k}'" for k in TONES)} end as tone,
    case when journalistic > theoretical then 'journalism' when descriptive > 0.5 and theoretical < 0.2 then 'description' end as drift from s""")
def text_tone(spark, folder):
    """The tone whose words a text holds most of, and where it drifts (TXT26)."""
    shares = [F.round(_how_many(F.lower("text"), v) / len(v), 2).alias(k) for k, v in TONES.items()]
    s, top = table(spark, folder, "documents").where("text is not null").select("doc_id", *shares), F.greatest(*TONES)
    tone = F.coalesce(*[F.when(F.col(k) == top, F.lit(k)) for k in TONES])
    drift = F.when(F.col("journalistic") > F.col("theoretical"), "journalism").when((F.col("descriptive") > 0.5) & (F.col("theoretical") < 0.2), "description")
    return s.select("doc_id", top.alias("share"), tone.alias("tone"), drift.alias("drift"))


@named("agg_tones", f"""with s as ({SQL["text_tone"]}) select tone, count(*) as n, count(distinct source) as sources, array_to_string(list_sort(list(distinct source))[1:10], '|') as first_sources from s join documents using (doc_id) group by tone""")
def agg_tones(spark, folder):
    """Texts by tone with the first ten sources of each (AGG34); sources are made distinct before they are gathered."""
    tones = text_tone(spark, folder).join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    each = tones.groupBy("tone", "source").agg(F.count("*").alias("n"))
    placed = each.withColumn("r", F.row_number().over(Window.partitionBy("tone").orderBy(F.asc_nulls_last("source"))))
    first = F.sort_array(F.collect_list(F.when(F.col("r") <= 10, F.col("source"))))
    return placed.groupBy("tone").agg(F.sum("n").alias("n"), F.count("source").alias("sources"), F.array_join(first, "|").alias("first_sources"))


@named("text_company", f"""select doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda x: not list_contains({_sql_list(NO_COMPANY)}, x) and x <> lang)[1:10], ' ') as company from documents where text is not null""")
def text_company(spark, folder):
    """The first ten words beside a term that tell something (TXT21)."""
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)), lambda x: ~x.isin(*NO_COMPANY) & (x != F.coalesce("lang", F.lit(""))))
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.array_join(F.slice(w, 1, 10), " ").alias("company"))


_TOPIC_WORDS = f"list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{{5,}}')), lambda x: not list_contains({_sql_list(NO_TOPIC)}, x))"


@named("train_topics", f"""with recursive u as (select conv_id, turn, {_TOPIC_WORDS} as w, row_number() over (partition by conv_id order by turn) as i from conversations where role = 'user' and text <> ''),
    f as (select conv_id, i, turn, w as k, 1 as topic from u where i = 1 union all
    select conv_id, i, turn, case when shift then w else list_distinct(list_concat(k, w)) end, topic + shift::int from (select u.conv_id, u.i, u.turn, u.w, f.k, f.topic, len(f.k) > 0 and len(u.w) > 2 and len(list_intersect(u.w, f.k)) / greatest(1, len(f.k)) < 0.15 as shift from f join u on u.conv_id = f.conv_id and u.i = f.i + 1))
    select conv_id, turn, topic from f""")
def train_topics(spark, folder):
    """Which topic each turn of a user is on (WIN6): a new one begins where under 0.15 of the topic's words come back and there are over two words. A fold over a conversation's user turns."""
    w = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))), lambda x: ~x.isin(*NO_TOPIC))
    u = table(spark, folder, "conversations").where("role = 'user' and text <> ''").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", w.alias("w")))).alias("turns"))
    start = F.struct(F.array().cast("array<string>").alias("k"), F.lit(1).alias("topic"), F.array().cast("array<struct<turn:bigint,topic:int>>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        shift = (F.size(s["k"]) > 0) & (F.size(t["w"]) > 2) & (F.size(F.array_intersect(t["w"], s["k"])) / F.greatest(F.lit(1), F.size(s["k"])) < 0.15)
        topic = s["topic"] + shift.cast("int")
        return F.struct(F.when(shift, t["w"]).otherwise(F.array_union(s["k"], t["w"])).alias("k"), topic.alias("topic"), F.concat(s["out"], F.array(F.struct(t["turn"].alias("turn"), topic.alias("topic")))).alias("out"))

    return u.select("conv_id", F.explode(F.aggregate("turns", start, step, lambda s: s["out"])).alias("x")).select("conv_id", "x.turn", "x.topic")


@named("score_sources", f"""with s as (select source, doc_id, round(greatest(25 - (2026 - (1990 + doc_id % 37)) * 2, 0) + least(doc_id % 400 / 10, 25) + least(4 * list_sum(list_transform({_sql_list(METHODS)}, lambda v: contains(lower(text), v)::int)), 20) + least(len(text) / 500, 15), 4)::double as score from documents where text is not null)
    select source, doc_id, score from (select *, row_number() over (partition by source order by score desc, doc_id) as r from s) where r <= 8""")
def score_sources(spark, folder, now: int = 2026):
    """A source's eight best texts by year, citations, methods and length (VEC22). Years and citations come from ids; the ranks are cut before the shuffle."""
    age = now - (1990 + F.col("doc_id") % 37)
    score = F.greatest(25 - age * 2, F.lit(0)) + F.least(F.col("doc_id") % 400 / 10, F.lit(25)) + F.least(4 * _how_many(F.lower("text"), METHODS), F.lit(20)) + F.least(F.length("text") / 500, F.lit(15))
    s = table(spark, folder, "documents").where("text is not null").select("source", "doc_id", F.round(score, 4).alias("score"))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id"))).where("r <= 8").drop("r")


@named("graph_strengthened", """with e as (select user_id, event_type, count(*) as n, max(ts) as last from events group by all), w as (select *, least(2, 0.5 + list_sum(list_transform(range(1, least(n, 100) + 1), lambda k: 0.05 / (1 + k * 0.01::double)))) as w, max(last) over () as now from e)
    select user_id, event_type, n, round(case when epoch(now) - epoch(last) > 168 * 3600 then greatest(0.1, w * 0.95::double) else w end, 3)::double as weight from w""")
def graph_strengthened(spark, folder):
    """Weights of links that grow with use, by less each time and to 2 at most, and fade after a week (GRF24). As what is added is never negative, the cap may come last, and a count tells the weight: no fold over events."""
    e = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    now = table(spark, folder, "events").agg(F.max("ts")).scalar()
    grown = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(100)).cast("int")), F.lit(0.0), lambda s, k: s + 0.05 / (1 + k * 0.01))
    w = e.withColumn("w", F.least(F.lit(2.0), 0.5 + grown)).withColumn("week", now - F.expr("interval 168 hours"))
    faded = F.when(F.col("last") < F.col("week"), F.greatest(F.lit(0.1), F.col("w") * 0.95)).otherwise(F.col("w"))
    return w.select("user_id", "event_type", "n", F.round(faded, 3).alias("weight"))


@named("graph_weak_claims", f"""with {_NEAR.format(k=10)}, s as (select query_id, count(*) filter (where cosine > 0.5) as n, count(*) filter (where cosine > 0.5 and label <> wanted) as against from k group by query_id)
    select query_id, n, against, round(least(1, 0.5 + 0.05 * (n - against)), 4)::double as confidence, case when against > n - against then 'contested' else 'weak' end as status from s where least(1, 0.5 + 0.05 * (n - against)) < 0.7 or against > n - against""")
def graph_weak_claims(spark, folder):
    """Questions with little near them, or more of other labels than of their own (GRF29)."""
    near, other = F.col("cosine") > 0.5, F.col("label") != F.col("wanted")
    s = _near(spark, folder, 10).groupBy("query_id").agg(F.count(F.when(near, 1)).alias("n"), F.count(F.when(near & other, 1)).alias("against"))
    sure, contested = F.least(F.lit(1.0), 0.5 + 0.05 * (F.col("n") - F.col("against"))), F.col("against") * 2 > F.col("n")
    return s.where((sure < 0.7) | contested).select("query_id", "n", "against", F.round(sure, 4).alias("confidence"), F.when(contested, "contested").otherwise("weak").alias("status"))


_PLACE = "round(greatest(0.02, least(0.98, 0.2 + 0.15 * (({label} + {i}) % 5) + v[{k}] / sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3] + 1e-10) * 0.12)), 4)::double as {name}"


@named("atlas_places", f"with v as (select vec_id, label, embedding::double[] as v from embeddings where len(embedding) >= 3) select vec_id, {', '.join(_PLACE.format(label='label', i=i, k=i + 1, name=n) for i, n in enumerate('xyz'))} from v")
def atlas_places(spark, folder):
    """Places on a map: the label's centre, moved by the direction of a vector's first three parts (GRF19)."""
    v = table(spark, folder, "embeddings").where("size(embedding) >= 3").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    part = lambda i: F.col("v")[i]
    norm = F.sqrt(part(0) * part(0) + part(1) * part(1) + part(2) * part(2) + 1e-10)
    place = lambda i: F.round(F.greatest(F.lit(0.02), F.least(F.lit(0.98), 0.2 + 0.15 * ((F.col("label") + i) % 5) + part(i) / norm * 0.12)), 4)
    return v.select("vec_id", *[place(i).alias(n) for i, n in enumerate("xyz")])


@named("graph_effects", """with p as (select distinct n_regionkey, n_nationkey, l_partkey from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
    e as (select 'nation' as kind, n_nationkey as cause, l_partkey, 0.8::double * 0.8 as effect from p union select 'region', n_regionkey, l_partkey, 0.8::double * 0.8 * 0.8 from p) select kind, cause::bigint as cause, l_partkey, round(effect, 4) as effect from e""")
def graph_effects(spark, folder, decay: float = 0.8, lines: int = 250_000):
    """What a change of a nation or region does to parts, fading by 0.8 a step down to suppliers and their parts (GRF15). Nations and regions are few, so reached pairs grow as parts do.
    Both steps are dealt to as many parts as have about `lines` lines each."""
    line, supplier, nation = table(spark, folder, "lineitem"), table(spark, folder, "supplier"), table(spark, folder, "nation")
    homes = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_nationkey", "n_regionkey")
    parts = parts_of(line, lines)
    p = line.select("l_suppkey", "l_partkey").repartition(parts, "l_suppkey", "l_partkey").distinct().join(homes, F.col("l_suppkey") == F.col("s_suppkey"))
    steps = F.array(F.struct(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("cause"), F.lit(decay**2).alias("effect")), F.struct(F.lit("region").alias("kind"), F.col("n_regionkey").cast("long").alias("cause"), F.lit(decay**3).alias("effect")))
    return p.select("l_partkey", F.explode(steps).alias("x")).select("x.kind", "x.cause", "l_partkey", F.round("x.effect", 4).alias("effect")).repartition(parts, "kind", "cause", "l_partkey").distinct()


@named("graph_citing", f"""with c as ({SQL["text_citations"]}), d as (select doc_id, lower(substr(source, 1, 1)) || 'mith_' || (1990 + (doc_id * 7) % 30) as node from documents), e as (select node as citing, cited, count(*) as texts from c join d using (doc_id) where node <> cited group by all)
    select e.citing, e.cited, e.texts, n.node is not null as held from e left join (select distinct node from d) n on n.node = e.cited""")
def graph_citing(spark, folder):
    """Who cites whom by author and year, in how many texts, and whether the cited is among the texts (GRF1, JN14). Nodes are keys, so texts of a key don't multiply."""
    d = table(spark, folder, "documents").select("doc_id", F.concat(F.lower(F.substring("source", 1, 1)), F.lit("mith_"), (1990 + F.col("doc_id") * 7 % 30).cast("string")).alias("node"))
    e = text_citations(spark, folder).join(d.withColumnRenamed("node", "citing"), "doc_id").where("citing <> cited").groupBy("citing", "cited").agg(F.count("*").alias("texts"))
    held = d.select(F.col("node").alias("cited")).distinct().withColumn("held", F.lit(True))
    return e.join(held, "cited", "left").select("citing", "cited", "texts", F.coalesce("held", F.lit(False)).alias("held"))


@named("agg_top_topics", """with c as (select user_id, event_type, count(*) as n, min(ts)::date as first_day, max(ts)::date as last_day from events group by all)
    select user_id, event_type, n, first_day, last_day from (select *, row_number() over (partition by user_id order by n desc, event_type) as r from c) where r <= 3""")
def agg_top_topics(spark, folder):
    """A user's three commonest kinds of event, with when they were first and last seen (AGG36, AGG38)."""
    c = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).where("r <= 3").drop("r")


@named("eval_sides", """with s as (select source, avg(quality) filter (where doc_id % 2 = 0) as a, avg(quality) filter (where doc_id % 2 = 1) as b, count(quality) as n from documents join labels using (doc_id) group by source)
    select source, n, round(a, 4) as a, round(b, 4) as b, case when a is null or b is null or abs(a - b) < 0.05 then 'tie' when a > b then 'a' else 'b' end as better from s""")
def eval_sides(spark, folder):
    """Two sides compared by the mean of their marks, by source (STA24); even ids against odd ones."""
    d = table(spark, folder, "documents").select("doc_id", "source").join(table(spark, folder, "labels"), "doc_id")
    mean = lambda k: F.avg(F.when(F.col("doc_id") % 2 == k, F.col("quality")))
    s = d.groupBy("source").agg(mean(0).alias("a"), mean(1).alias("b"), F.count("quality").alias("n"))
    better = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) < 0.05), "tie").when(F.col("a") > F.col("b"), "a").otherwise("b")
    return s.select("source", "n", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), better.alias("better"))


@named("set_shared", "select c_nationkey as nation from customer intersect select s_nationkey from supplier")
def set_shared(spark, folder):
    """Nations of customers that have suppliers, too (SET3)."""
    return table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, folder, "supplier").select("s_nationkey"))


def markdown_blocks(rows: DataFrame, text: str) -> DataFrame:
    """rows with block, heading and body in place of text: a block begins at a line that starts with #, after spaces; the lines before the
    first are headed Document, an empty heading is Section, and blocks without a body are left out. Null texts have no blocks."""
    parts = F.split(F.concat(F.lit("Document\n"), text), r"\n[ \t]*#+[ \t]*")
    rest = [c for c in rows.columns if c != text]
    cut = rows.select(*rest, F.posexplode(parts).alias("block", "part"))
    heading = F.trim(F.split_part("part", F.lit("\n"), F.lit(1)))
    body = C.clean(F.substring(F.col("part"), F.length(F.split_part("part", F.lit("\n"), F.lit(1))) + 2, F.length("part")))
    return cut.select(*rest, "block", F.when(heading == "", "Section").otherwise(heading).alias("heading"), body.alias("body")).where("body <> ''")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, heading, body) of a folder's Markdown files."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return markdown_blocks(files.select(F.col("_metadata.file_path").alias("path"), "value"), "value")


@named("source_markdown", r"""with t as (select doc_id, unnest(regexp_split_to_array('Document' || chr(10) || 'On ' || lang || chr(10) || '# Of ' || source || chr(10) || text || chr(10) || '  ##' || chr(10) || 'End of ' || doc_id, '\n[ \t]*#+[ \t]*')) as part,
    generate_subscripts(regexp_split_to_array('Document' || chr(10) || 'On ' || lang || chr(10) || '# Of ' || source || chr(10) || text || chr(10) || '  ##' || chr(10) || 'End of ' || doc_id, '\n[ \t]*#+[ \t]*'), 1) - 1 as block from documents),
    b as (select doc_id, block, trim(split_part(part, chr(10), 1)) as heading, trim(regexp_replace(replace(substr(part, len(split_part(part, chr(10), 1)) + 2), chr(0), ' '), '[ \t\n\r\f\x0B]+', ' ', 'g')) as body from t)
    select doc_id, block::int as block, case when heading = '' then 'Section' else heading end as heading, md5(body) as body_md5 from b where body <> ''""")
def source_markdown(spark, folder):
    """Blocks of Markdown texts by heading (SRC5). Headings are put around each text."""
    t = F.concat(F.lit("On "), "lang", F.lit("\n# Of "), "source", F.lit("\n"), "text", F.lit("\n  ##\nEnd of "), F.col("doc_id").cast("string"))
    return markdown_blocks(table(spark, folder, "documents").select("doc_id", t.alias("t")), "t").select("doc_id", "block", "heading", F.md5("body").alias("body_md5"))


NOTEBOOK = "cells array<struct<cell_type string, source array<string>, outputs array<struct<text array<string>>>>>"


def notebook_blocks(rows: DataFrame, text: str) -> DataFrame:
    """rows with cell, heading and body in place of text, the JSON of a notebook: notes are headed by their first line (80 characters), code by its number, with what it printed below it. Empty cells, other kinds and broken JSON give nothing."""
    rest = [c for c in rows.columns if c != text]
    cells = rows.select(*rest, F.posexplode(F.from_json(text, NOTEBOOK)["cells"]).alias("cell", "c")).withColumn("cell", F.col("cell") + 1)
    code = F.array_join("c.source", "")
    printed = C.clean(F.array_join(F.transform(F.slice("c.outputs", 1, 5), lambda o: F.array_join(o["text"], "")), "\n"))
    body = F.when(F.col("c.cell_type") == "markdown", C.clean(code)).when(F.col("c.cell_type") == "code", F.concat(C.clean(code), F.when(F.size("c.outputs") > 0, F.concat(F.lit("\n\nOutput:\n"), printed)).otherwise(F.lit(""))))
    heading = F.when(F.col("c.cell_type") == "code", F.concat(F.lit("Code cell "), F.col("cell").cast("string"))).otherwise(F.substring(F.split_part(F.btrim(code, F.lit(" \t\n\r")), F.lit("\n"), F.lit(1)), 1, 80))
    return cells.where(F.btrim(code, F.lit(" \t\n\r")) != "").select(*rest, "cell", heading.alias("heading"), body.alias("body")).where("body <> ''")


@named("source_notebooks", r"""with c as (select conv_id, turn, text, trim(regexp_replace(replace(text, chr(0), ' '), '[ \t\n\r\f\x0B]+', ' ', 'g')) as body from conversations where trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> '')
    select conv_id, turn, 1 as cell, substr(split_part(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), chr(10), 1), 1, 80) as heading, md5(body) as body_md5 from c where body <> ''
    union all select conv_id, turn, 2, 'Code cell 2', md5('x = ' || turn || chr(10) || chr(10) || 'Output:' || chr(10) || turn || ' ' || role) from conversations""")
def source_notebooks(spark, folder):
    """Cells of notebooks (SRC11). Each turn is made a notebook of a note, a cell of code with what it prints, and an empty cell."""
    cell = lambda kind, source, outputs: F.struct(F.lit(kind).alias("cell_type"), source.alias("source"), outputs.alias("outputs"))
    none, n = F.array().cast("array<struct<text:array<string>>>"), F.col("turn").cast("string")
    printed = F.array(F.struct(F.array(F.concat(n, F.lit("\n")), F.col("role")).alias("text")))
    book = F.to_json(F.struct(F.array(cell("markdown", F.array(F.coalesce("text", F.lit(""))), none), cell("code", F.array(F.lit("x = "), n), printed), cell("code", F.array(F.lit(" \n")), none)).alias("cells")))
    return notebook_blocks(table(spark, folder, "conversations").select("conv_id", "turn", book.alias("book")), "book").select("conv_id", "turn", "cell", "heading", F.md5("body").alias("body_md5"))


def write_mbox(rows: DataFrame, path: str) -> None:
    """Writes (sender, subject, body) as mail folders; lines of a body that start with From, after any number of >, get one more >."""
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"(?m)^(>*From )", ">$1")
    rows.select(F.concat(F.lit("From "), "sender", F.lit("\nSubject: "), "subject", F.lit("\n\n"), body, F.lit("\n"))).write.text(path)


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """(sender, subject, body) of mail folders. Files are split where a line starts with From, so they are read in parallel."""
    mail = spark.read.option("lineSep", "\nFrom ").text(path).select(F.regexp_replace("value", "^From ", "").alias("m")).where("m <> ''")
    at = F.instr("m", F.lit("\n\n"))
    head, body = F.substring(F.col("m"), F.lit(1), at - 1), F.substring(F.col("m"), at + 2, F.length("m"))
    body = F.regexp_replace(F.regexp_replace(body, r"\n+\z", ""), r"(?m)^>(>*From )", "$1")
    return mail.where(at > 0).select(F.split_part(head, F.lit("\n"), F.lit(1)).alias("sender"), F.regexp_extract(head, r"(?m)^Subject: (.*)$", 1).alias("subject"), body.alias("body"))


@named("source_mbox", r"""select role as sender, conv_id || '/' || turn as subject, md5(regexp_replace(coalesce(text, ''), '\n+$', '')) as body_md5 from conversations""")
def source_mbox(spark, folder):
    """Turns written as mail folders and read back (SRC17)."""
    at = scratch(spark)
    c = table(spark, folder, "conversations")
    write_mbox(c.select(F.col("role").alias("sender"), F.concat_ws("/", "conv_id", "turn").alias("subject"), F.col("text").alias("body")), at)
    return read_mbox(spark, at).select("sender", "subject", F.md5("body").alias("body_md5"))
