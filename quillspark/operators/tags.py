"""Tags of texts by tables of keywords: one automaton over all keywords reads each text once, however many there are; and counts over the tags."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.named import named
from ..sources.tables import table
from .network import kept

#: Keywords by tag, in lower case; those of the original tables that hold capitals never match lower-cased texts and are left out.
METHODS = {
    "RCT": "randomized control|randomized experiment|random assignment|experimental group|treatment group|control group|placebo",
    "Diff-in-Diff": "difference-in-difference|diff-in-diff|did estimate|parallel trends|treatment effect|pre-treatment",
    "Regression Discontinuity": "regression discontinuity|cutoff|bandwidth|running variable|forcing variable",
    "Instrumental Variables": "instrumental variable|two-stage|first stage|exclusion restriction|instrument",
    "Synthetic Control": "synthetic control|counterfactual unit|donor pool|pre-treatment fit",
    "Case Study": "case study|process tracing|within-case|most-similar|most-different|comparative case",
    "Survey": "survey data|respondents|sample size|polling|cross-sectional survey|panel survey|survey experiment",
    "Formal Model": "formal model|game theory|equilibrium|utility function|payoff|strategic interaction",
    "Content Analysis": "content analysis|coding scheme|intercoder reliability|textual analysis|corpus|sentiment analysis",
    "QCA": "qualitative comparative analysis|fuzzy set|crisp set|truth table|necessity|sufficiency",
}
THEORIES = {
    "Institutionalism": "institutional|path dependence|critical juncture|institutional design|rules of the game",
    "Rational Choice": "rational choice|utility maximiz|collective action|free rider|prisoner's dilemma|strategic",
    "Constructivism": "constructivist|social construction|norms|identity|ideational|discourse|intersubjective",
    "Selectorate Theory": "selectorate|winning coalition|leader survival|private goods|public goods",
    "Democratic Peace": "democratic peace|democracies don't fight|liberal peace",
    "Modernization Theory": "modernization theory|economic development|middle class|prerequisite",
    "Dependency Theory": "dependency theory|world-system|core periphery|unequal exchange",
    "Realism": "realist|balance of power|security dilemma|anarchy|self-help",
    "Liberalism (IR)": "liberal institutionalism|international cooperation|regime theory|interdependence",
    "Behavioralism": "behavioralism|voting behavior|political behavior|public opinion|survey research",
    "Historical Institutionalism": "historical institutionalism|path depend|increasing returns",
    "Veto Players": "veto player|policy stability|status quo",
    "Principal-Agent": "principal-agent|moral hazard|adverse selection|delegation|accountability",
}
THEMES = {
    "welfare": "welfare|snap|tanf|medicaid|food stamp|social program|safety net|public assistance|benefit",
    "governance": "governance|institution|state capacity|bureaucracy|public administration|government|regime",
    "criminal": "criminal|cartel|violence|organized crime|extortion|drug|trafficking|enforcement",
    "rural": "rural|county|agricultural|small town|heartland|non-metropolitan",
    "charity": "charity|nonprofit|non-state|ngo|faith-based|volunteer|philanthropy|civil society",
    "voter": "voter|turnout|participation|election|ballot|partisan|mobilization|campaign",
    "race": "race|racial|ethnic|minority|discrimination|segregation|diversity",
    "inequality": "inequality|poverty|income|wealth|class|stratification|redistribution",
    "methodology": "regression|experiment|quasi-experiment|difference-in-differences|instrumental variable|causal|panel data",
}
DATASETS = {x: x.lower() for x in "ANES|WVS|V-Dem|Afrobarometer|ESS|CPS|GSS|CCES|World Bank|UN|LAPOP|Eurobarometer|Gallup".split("|")}

FIXED = [(kind, tag, word) for kind, tags in (("method", METHODS), ("theory", THEORIES), ("theme", THEMES), ("dataset", DATASETS)) for tag, words in tags.items() for word in words.split("|")]
KEYWORD_BYTES = 32 << 20
#: Texts whose tags a task holds at once.
HELD = 256


def keyword_blocks(keywords: DataFrame, most: int) -> Iterator[list[tuple[str, list[int]]]]:
    """(keyword, numbers of its tags) of at most about `most` bytes a block."""
    rows = keywords.groupBy("keyword").agg(F.sort_array(F.collect_set("n")).alias("tags"))
    held, size = [], 0
    for word, tags in rows.toLocalIterator():
        held.append((word, tags))
        size += len(word) * 4 + 8 * len(tags)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _hits(batches: Iterator[pa.RecordBatch], words: list[tuple[str, list[int]]], floor: int) -> Iterator[pa.RecordBatch]:
    """(id, n, hits) of `floor` hits or more for batches (id, text), a few texts at once, whatever the size of a batch."""
    machine = ahocorasick.Automaton()
    for i, (word, _) in enumerate(words):
        machine.add_word(word, i)
    machine.make_automaton()
    for batch in batches:
        for start in range(0, batch.num_rows, HELD):
            part = batch.slice(start, HELD)
            at, tags, hits = [], [], []
            for row, t in enumerate(part.column(1)):
                n = Counter(tag for i in {i for _, i in machine.iter(t.as_py())} for tag in words[i][1])
                some = [(tag, k) for tag, k in n.items() if k >= floor]
                at += [row] * len(some)
                tags += [tag for tag, _ in some]
                hits += [k for _, k in some]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(tags, pa.int64()), pa.array(hits, pa.int64())], ["id", "n", "hits"])


def tagged(docs: DataFrame, keywords: DataFrame, id: str, text: str, least: int = 1, most: int = KEYWORD_BYTES) -> DataFrame:
    """(id, kind, tag, hits): which tags of keywords (kind, tag, keyword) a text has, those of which it holds `least` different keywords, anywhere and
    in any case; hits is how many. A keyword is taken as it is, so one with capitals is found nowhere.

    The automaton goes to all tasks in blocks of bounded size, and each block is one pass over the texts. Null and empty texts and keywords have no tags."""
    spark = docs.sparkSession
    words = keywords.where("keyword <> ''").select("kind", "tag", "keyword").distinct()
    names = kept(words.select("kind", "tag").distinct().select("kind", "tag", F.xxhash64("kind", "tag").alias("n")))
    words = words.join(names, ["kind", "tag"])
    texts = docs.where(F.col(text) != "").select(F.col(id).alias("id"), F.lower(F.col(text)).alias("t"))
    kind = docs.schema[id].dataType.simpleString()
    found = []
    blocks = keyword_blocks(words, most)
    block, after = next(blocks, None), next(blocks, None)
    floor = least if after is None else 1  # a tag whose keywords are in several blocks is counted over all of them first
    while block is not None:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            return _hits(batches, sent.value, floor)

        found.append(texts.mapInArrow(run, f"id {kind}, n long, hits long"))
        block, after = after, next(blocks, None)
    if not found:
        return spark.createDataFrame([], f"`{id}` {kind}, kind string, tag string, hits long")
    one = reduce(DataFrame.unionAll, found)
    if len(found) > 1:
        one = one.groupBy("id", "n").agg(F.sum("hits").alias("hits"))
    return one.where(F.col("hits") >= least).join(names, "n").select(F.col("id").alias(id), "kind", "tag", "hits")


def _keywords(spark, folder) -> DataFrame:
    """The fixed keywords, and as stand-ins, since the given texts are invented, the words of six letters or more of each benchmark item as its keywords."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("keyword")
    items = table(spark, folder, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").cast("string").alias("tag"), word)
    return spark.createDataFrame(FIXED, "kind string, tag string, keyword string").union(items)


_quoted = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in FIXED)
_TAGS = f"""k(kind, tag, keyword) as (select * from (values {_quoted}) union all select 'item', item_id::varchar, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{6,}}'))) from benchmark),
    t as (select doc_id, lang, kind, tag, count(distinct keyword) as hits from documents, k where contains(lower(text), keyword) group by all)"""


@named("text_tags", f"with {_TAGS} select doc_id, kind, tag, hits from t where hits >= case when kind = 'theme' then 2 when kind = 'item' then 5 else 1 end")
def text_tags(spark, folder):
    """Methods, theories, themes and data sets that texts name (TXT2, TXT5, TXT8): a theme by two keywords, a stand-in by five, others by one."""
    found = tagged(table(spark, folder, "documents"), _keywords(spark, folder), "doc_id", "text")
    return found.where(F.col("hits") >= F.when(F.col("kind") == "theme", 2).when(F.col("kind") == "item", 5).otherwise(1))


@named("agg_tag_papers", f"with {_TAGS} select kind, tag, count(*) as papers, min(doc_id) as first, max(hits) as most, count(distinct lang) as langs from t where hits >= 3 group by kind, tag")
def agg_tag_papers(spark, folder):
    """Papers of each tag (AGG4, AGG30): how many, the first, and how many languages they are in; three keywords make a tag here."""
    docs = table(spark, folder, "documents")
    found = tagged(docs, _keywords(spark, folder), "doc_id", "text", 3).join(docs.select("doc_id", "lang"), "doc_id")
    return found.groupBy("kind", "tag").agg(F.count("*").alias("papers"), F.min("doc_id").alias("first"), F.max("hits").alias("most"), F.countDistinct("lang").alias("langs"))


@named("agg_tag_years", f"with {_TAGS}, y as (select *, 1995 + doc_id % 30 as year from t where hits >= 3), p as (select tag, count(*) as papers, count(distinct year) as years from y where kind = 'item' group by tag having count(*) >= 2) select tag, papers, years, year::bigint as year, n from p join (select tag, year, count(*) as n from y where kind = 'item' group by all) using (tag)")
def agg_tag_years(spark, folder):
    """Tags of two papers or more by year, with how many papers and years they have in all (AGG35)."""
    year = (1995 + F.col("doc_id") % 30).alias("year")
    found = kept(tagged(table(spark, folder, "documents"), _keywords(spark, folder).where("kind = 'item'"), "doc_id", "text", 3).select("tag", year))
    whole = found.groupBy("tag").agg(F.count("*").alias("papers"), F.countDistinct("year").alias("years")).where("papers >= 2")
    return whole.join(found.groupBy("tag", "year").agg(F.count("*").alias("n")), "tag")


@named("agg_tag_pairs", f"with {_TAGS}, s as (select * from t where hits >= 3 and kind = 'item') select a.tag as a, b.tag as b, count(*) as papers, min(a.doc_id) as first from s a join s b using (doc_id) where a.tag < b.tag group by 1, 2")
def agg_tag_pairs(spark, folder):
    """Pairs of tags that papers have both of (AGG30's map): pairs within a paper, counted before the shuffle."""
    found = tagged(table(spark, folder, "documents"), _keywords(spark, folder).where("kind = 'item'"), "doc_id", "text", 3)
    own = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))  # at most as many as there are tags
    pairs = F.flatten(F.transform("tags", lambda x, i: F.transform(F.slice("tags", i + 2, F.size("tags")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return own.select("doc_id", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("papers"), F.min("doc_id").alias("first"))
