"""JSON lines and CSV written and read back, and keyed tables that are updated by rewriting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.named import named
from .tables import table


def scratch(spark: SparkSession) -> str:
    """A new folder that executors share, under spark.checkpoint.dir, which goes when the driver's JVM ends. Where the setting is missing, a local
    folder will do only if all tasks run in this machine; on a cluster that is an error, as each executor would write to its own disk."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    jvm = spark.sparkContext._jvm
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = jvm.System.getProperty("quillspark.shared")
        if not shared:
            shared = "file://" + tempfile.mkdtemp(prefix="quillspark-")
            jvm.System.setProperty("quillspark.shared", shared)
    path = jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/quillspark/{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def removed(spark: SparkSession, at: str) -> None:
    """Deletes a table of scratch() that no later plan reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def upsert(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace rows of held with the same key."""
    both = held.withColumn("__at", F.lit(0)).unionByName(new.withColumn("__at", F.lit(1)))
    return both.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__at")))).where("__rn = 1").drop("__at", "__rn")


@named("sink_jsonl", "select conv_id, turn, role, text from conversations")
def sink_jsonl(spark, folder):
    """Conversations as JSON lines by role, read back; lines that don't parse are dropped."""
    at = scratch(spark)
    table(spark, folder, "conversations").write.partitionBy("role").json(at)
    got = spark.read.schema("conv_id bigint, turn bigint, role string, text string").option("mode", "DROPMALFORMED").json(at)
    return got.select("conv_id", "turn", "role", "text")


@named("sink_csv", "select source, count(*) as docs, sum(n_chars)::bigint as chars from documents group by source")
def sink_csv(spark, folder):
    """The index report as CSV, read back."""
    at = scratch(spark)
    table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars")).write.option("header", True).csv(at)
    return spark.read.option("header", True).schema("source string, docs bigint, chars bigint").csv(at)


@named("sink_upsert", "select doc_id, case when doc_id % 7 = 0 then n_chars + 1 else n_chars end as n_chars from documents")
def sink_upsert(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "n_chars")
    return upsert(d, d.where("doc_id % 7 = 0").withColumn("n_chars", F.col("n_chars") + 1), "doc_id")


@named("sink_prune", "select doc_id, lang from documents where doc_id in (select doc_id from labels)")
def sink_prune(spark, folder):
    """What is no longer active goes."""
    return table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels"), "doc_id", "left_semi")


@named("source_datasets", "select n_name, count(*) as n, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey group by 1 order by n desc, n_name limit 10")
def source_datasets(spark, folder):
    """A top-10 report."""
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")).orderBy(F.desc("n"), "n_name").limit(10)


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, fields) of BibTeX entries. Files are split where a line starts with @, so they are read in parallel. A value may hold
    one level of braces, or be quoted or a bare word; names of fields are lower-cased, and what is no entry is left out."""
    raw = spark.read.option("lineSep", "\n@").text(path).select(F.regexp_replace("value", "^@", "").alias("e"))
    body = r"([A-Za-z][A-Za-z0-9_-]*)\s*=\s*(\{(?:[^{}]|\{[^{}]*\})*\}|\"[^\"]*\"|\w+)"
    names, values = (F.regexp_extract_all("e", F.lit(body), F.lit(i)) for i in (1, 2))
    values = F.transform(values, lambda v: F.trim(F.when(v.rlike(r'^[{"]'), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)))
    rows = raw.where(F.col("e").rlike(r"^[A-Za-z]+\s*\{[^,}]+,"))
    fields = F.map_from_entries(F.arrays_zip(F.transform(names, F.lower).alias("name"), values.alias("value")))
    return rows.select(F.lower(F.regexp_extract("e", r"^([A-Za-z]+)", 1)).alias("kind"), F.trim(F.regexp_extract("e", r"^[A-Za-z]+\s*\{([^,}]+),", 1)).alias("key"), fields.alias("fields"))


@named("source_bibtex", """select 'misc' as kind, 'part' || p_partkey as key, p_name as title, p_brand as first_author, 2 as n_authors, p_size::int as pages from part""")
def source_bibtex(spark, folder):
    """Parts written as bibliography entries of several lines, read back and parsed."""
    at = scratch(spark)
    entry = F.format_string("@Misc{part%d,\n  Title = {%s},\n  author = {%s and {%s}},\n  pages = \"%d\"\n}", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    table(spark, folder, "part").select(entry).write.text(at)
    f = F.col("fields")
    authors = F.split(f["author"], r"\s+and\s+")
    return read_bibtex(spark, at).select("kind", "key", f["title"].alias("title"), authors[0].alias("first_author"), F.size(authors).alias("n_authors"), f["pages"].cast("int").alias("pages"))
