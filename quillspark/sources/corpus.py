"""A folder of files as a corpus, and an index of its chunks that follows changes: files in, only what changed is cut anew, what went is pruned."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import windows_of_words
from ..plans.named import named
from .files import scratch
from .tables import chunks, table

SUFFIXES = ("txt", "md", "rst", "csv", "tsv", "json", "jsonl", "bib", "tex", "html", "htm", "py", "sql", "yaml", "yml", "log")
SKIPPED = ("node_modules", "__pycache__", "venv", "dist", "build")
CHANGES = "rel_path string, modified timestamp, text string"


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES, skipped: tuple[str, ...] = SKIPPED, most: int = 50 << 20) -> DataFrame:
    """(path, rel_path, suffix, modified, size, content) of the files under root, at any depth (SRC1, SRC2): of known suffixes and at most `most` bytes, none
    that is hidden or in a hidden or skipped folder. Spark lists and reads them, and leaves out empty files; contents are read only where a column of them is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", ""), "^(?:[^/]*?/)?" + _quoted(base) + "/", "")
    rows = files.select("path", rel.alias("rel_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    rows = rows.withColumn("suffix", F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1)))
    hidden = F.exists(F.split("rel_path", "/"), lambda x: x.startswith(".") | x.isin(*skipped) | x.endswith(".gdb"))
    return rows.where(F.col("suffix").isin(*suffixes) & ~hidden & (F.col("size") <= most)).select("path", "rel_path", "suffix", "modified", "size", "content")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def file_text(suffix: Column, content: Column) -> Column:
    """The text of a file by its suffix (SRC3): markup goes from HTML, commands from TeX, quotes and braces from JSON; others are taken as they are. Bytes that
    are not UTF-8 become replacement characters."""
    raw = F.make_valid_utf8(content.cast("string"))
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    tex = F.regexp_replace(F.regexp_replace(raw, r"(?m)(?<!\\)%.*$", ""), r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?|[{}]", " ")
    return F.when(suffix.isin("html", "htm"), bare).when(suffix == "tex", tex).when(suffix.isin("json", "jsonl"), F.regexp_replace(raw, r'["{}\[\],]+', " ")).otherwise(raw)


def manifest_diff(held: DataFrame, seen: DataFrame) -> DataFrame:
    """(rel_path, change): new, changed or gone, by the digests of (rel_path, sha256); what is the same is left out (JN3, JN4)."""
    both = held.select("rel_path", F.col("sha256").alias("old")).join(seen.select("rel_path", F.col("sha256").alias("new")), "rel_path", "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed")
    return both.select("rel_path", change.alias("change")).where("change is not null")


class CorpusIndex:
    """Chunks of files at a folder: every batch writes its changed files' chunks and manifest rows apart, and the last batch of a path holds. So a batch
    rewrites nothing of others, one that runs again writes the same again, and readers see whole batches."""

    MANIFEST = "rel_path string, modified timestamp, sha256 string, chunks long, home long, batch long"  # home: the batch that has the chunks
    CHUNKS = "rel_path string, chunk long, text string, batch long"

    def __init__(self, spark: SparkSession, at: str, size: int = 120, overlap: int = 20):
        self.spark, self.at, self.size, self.overlap = spark, at, size, overlap

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.at}/{name}").parquet(f"{self.at}/{name}")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], schema)

    def manifest(self, before: int | None = None) -> DataFrame:
        """The last row of each path, of batches before one if given; a path that went has no sha256."""
        rows = self._read("manifest", self.MANIFEST)
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return rows.groupBy("rel_path").agg(F.max_by(F.struct("modified", "sha256", "chunks", "home", "batch"), "batch").alias("x")).select("rel_path", "x.*")

    def chunks(self) -> DataFrame:
        """(rel_path, chunk, text) of the files as they are."""
        live = self.manifest().where("sha256 is not null").select("rel_path", F.col("home").alias("batch"))
        return self._read("chunks", self.CHUNKS).join(live, ["rel_path", "batch"]).select("rel_path", "chunk", "text")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Takes in changes (rel_path, modified, text; null for a file that went). Of a path's changes the last counts; changes older than what is held do
        nothing, and those that leave the text as it was leave its chunks. batch numbers rise; one that comes again replaces itself."""
        last = changes.where("rel_path is not null").groupBy("rel_path").agg(F.max_by(F.struct("modified", "text"), F.struct("modified", F.xxhash64("text"))).alias("x")).select("rel_path", "x.*")
        last = last.withColumn("sha256", F.sha2("text", 256))
        held = self.manifest(batch).select("rel_path", F.col("sha256").alias("old"), F.col("modified").alias("since"), F.col("chunks").alias("n"), "home")
        both = last.join(held, "rel_path", "left").where("since is null or modified > since or (modified = since and not (old <=> sha256))")
        same = F.col("since").isNotNull() & F.col("old").eqNullSafe(F.col("sha256"))
        cut = both.select("rel_path", "modified", "sha256", "n", "home", same.alias("same"), F.when(~same & F.col("text").isNotNull(), windows_of_words(F.col("text"), self.size, self.overlap)).alias("c"))
        at = scratch(self.spark)
        cut.write.parquet(at)  # read twice below
        cut = self.spark.read.schema(cut.schema).parquet(at)
        cut.select("rel_path", F.posexplode("c").alias("chunk", "text")).select("rel_path", F.col("chunk").cast("long").alias("chunk"), "text").write.mode("overwrite").parquet(f"{self.at}/chunks/batch={batch}")
        n = F.when(F.col("same"), F.col("n")).otherwise(F.greatest(F.coalesce(F.size("c"), F.lit(0)), F.lit(0))).cast("long")
        home = F.when(F.col("same"), F.col("home")).otherwise(F.lit(batch)).cast("long")
        cut.select("rel_path", "modified", "sha256", n.alias("chunks"), home.alias("home")).write.mode("overwrite").parquet(f"{self.at}/manifest/batch={batch}")

    def sync(self, files: DataFrame) -> DataFrame:
        """Brings the index to files (rel_path, modified, text), a whole listing, and tells what changed: (rel_path, change)."""
        seen = files.select("rel_path", F.sha2("text", 256).alias("sha256"))
        held = self.manifest().where("sha256 is not null")
        at = scratch(self.spark)
        manifest_diff(held, seen).write.parquet(at)
        diff = self.spark.read.schema("rel_path string, change string").parquet(at)
        gone = diff.where("change = 'gone'").join(held.select("rel_path", "modified"), "rel_path").select("rel_path", "modified", F.lit(None).cast("string").alias("text"))
        some = files.select("rel_path", "modified", "text").join(diff.where("change <> 'gone'"), "rel_path", "left_semi")
        batch = self._read("manifest", self.MANIFEST).agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]
        self.apply(some.unionByName(gone), batch)
        return diff

    def follow(self, changes: DataFrame, checkpoint: str) -> None:
        """Takes in all that is available of a stream of changes, batch by batch; the checkpoint says where to go on (STR11)."""
        changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def compacted(self, at: str) -> CorpusIndex:
        """The same files as one batch at another folder; the old folder can go when no reader holds it."""
        self.chunks().write.parquet(f"{at}/chunks/batch=0")
        self.manifest().where("sha256 is not null").drop("batch").withColumn("home", F.lit(0).cast("long")).write.parquet(f"{at}/manifest/batch=0")
        return CorpusIndex(self.spark, at, self.size, self.overlap)


_CUT = r"list_filter(regexp_split_to_array(coalesce(t, ''), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')"


@named("index_incremental", f"""with d as (select doc_id, case when doc_id % 7 = 0 then text || ' altered once' else text end as t from documents where doc_id % 11 <> 0), w as (select 'doc/' || doc_id || '.txt' as rel_path, {_CUT} as w from d),
    c as (select rel_path, w, unnest(range(0, greatest(len(w), 1), 100)) as a from w) select rel_path, a // 100 as chunk, md5(array_to_string(w[a + 1:a + 120], ' ')) as text_md5 from c where len(w) > 0""")
def index_incremental(spark, folder):
    """An index that follows three drops of changes, a file a batch: most documents; then changed, new and gone ones; then changes too old to count."""
    d = table(spark, folder, "documents").where("doc_id is not null and text is not null")
    path, at = F.format_string("doc/%d.txt", "doc_id").alias("rel_path"), scratch(spark)
    day = lambda n: F.lit(f"2024-01-0{n}").cast("timestamp").alias("modified")
    changed = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" altered once"))).otherwise(F.col("text")).alias("text")
    drops = [
        d.where("doc_id % 10 <> 0").select(path, day(2), "text"),
        d.where("doc_id % 7 = 0 or doc_id % 11 = 0 or doc_id % 10 = 0").select(path, day(3), changed),
        d.where("doc_id % 5 = 0").select(path, day(1), F.lit("too old").alias("text")),
    ]
    index = CorpusIndex(spark, f"{at}/index")
    for drop in drops:
        drop.write.mode("append").parquet(f"{at}/drops")
        index.follow(spark.readStream.schema(CHANGES).parquet(f"{at}/drops"), f"{at}/state")
    return index.chunks().select("rel_path", "chunk", F.md5("text").alias("text_md5"))


def full_documents(chunks: DataFrame, wanted: DataFrame, tokens: int) -> DataFrame:
    """(id, text, n): whole texts of the wanted ids from chunks (id, chunk, text), in order, joined by blank lines, up to 4 characters a token (SNK8). Chunks beyond
    the budget are left out before any is gathered, so a text's list is bounded by the budget."""
    before = F.sum(F.length("text") + 2).over(Window.partitionBy("id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    rows = chunks.join(wanted.select("id").distinct(), "id", "left_semi").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 4 * tokens)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "\n\n")
    return rows.groupBy("id").agg(F.substring(joined, 1, 4 * tokens).alias("text"), F.count("*").alias("n"))


@named("sink_full_documents", f"""with d as (select doc_id, {_CUT.replace("coalesce(t, '')", "coalesce(text, '')")} as w from documents where doc_id % 20 = 0), c as (select doc_id, unnest(range(0, len(w), 100)) as a, w from d), t as (select doc_id, a, array_to_string(w[a + 1:a + 120], ' ') as t from c),
    b as (select *, coalesce(sum(length(t) + 2) over (partition by doc_id order by a rows between unbounded preceding and 1 preceding), 0) as before from t), j as (select doc_id, count(*) as n, string_agg(t, chr(10) || chr(10) order by a) as t from b where before < 2000 group by doc_id)
    select doc_id, n, length(substr(t, 1, 2000)) as chars, md5(substr(t, 1, 2000)) as text_md5 from j""")
def sink_full_documents(spark, folder):
    """Every twentieth document from its chunks, 500 tokens at most each."""
    rows = chunks(spark, folder).select(F.col("doc_id").alias("id"), "chunk", "text")
    found = full_documents(rows, table(spark, folder, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("id")), 500)
    return found.select(F.col("id").alias("doc_id"), "n", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))
