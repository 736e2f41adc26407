"""Column expressions for text; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[ \t\n\r\f\x0B]+"

#: Frequent words by language, in order of preference on ties.
LANGUAGE_WORDS = {
    "en": "the and is in of to that for it with as was are by this",
    "es": "de la el en que los del las una por con para es su al",
    "fr": "le de la les des un une du en est que pour dans qui sur",
    "de": "der die und den von ein mit das ist des auf eine dem nicht sich",
    "pt": "de que do da em para uma com não os das dos por mais na",
}

#: What is redacted, in order.
REDACTED = [
    (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"\b\d{3}[\-.\s]?\d{3}[\-.\s]?\d{4}\b", "[PHONE]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "[CC]"),
    (r"AIzaSy[A-Za-z0-9_\-]{33}", "[GOOGLE_KEY]"),
    (r"sk-[A-Za-z0-9]{20,}", "[OPENAI_KEY]"),
]


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\0"), F.lit(" ")), SPACES, " "))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Runs of two or more ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))


def once(value: Column, use) -> Column:
    """use(value) with value worked out once a row, also where use() reads it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def windows_of_words(text: Column, size: int, overlap: int) -> Column:
    """Runs of `size` words that start every size - overlap words; the last may be shorter."""
    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(size - overlap))
        return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " ")), lambda x: x != "")

    return once(words(text), cut)


def paragraphs(text: Column, boundary: str) -> Column:
    ends = " \t\n\r\f\x0b"
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), boundary), lambda p: F.btrim(p, F.lit(ends))), lambda p: p != "")


def chunks_by_topic(parts: Column, size: int, overlap: int, tiny: int = 100, alike: float = 0.15, split_first: bool = False) -> Column:
    """Paragraphs in chunks of about `size` characters. A chunk ends where the next paragraph would overfill it, or where it is a third full
    and the next shares few words with the last; the last paragraph is carried over if it is short and alike. A paragraph over the size is
    cut in overlapping windows, the first one only if `split_first`. Chunks under `tiny` characters join the one before.

    The fold runs over lengths and yes-or-no shifts only: it gives ranges of paragraphs, and texts are joined once, after it."""
    n = F.size(parts)
    lens = F.transform(parts, F.length)
    sets = F.transform(parts, lambda p: F.array_distinct(F.regexp_extract_all(F.lower(p), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0))))
    likeness = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    shifts = once(sets, lambda s: F.transform(s, lambda w, i: F.when(i > 0, likeness(w, F.get(s, i - 1)) < alike).otherwise(F.lit(False))))
    pair = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    state = lambda cuts, a, length: F.struct(cuts.alias("cuts"), a.cast("int").alias("a"), length.cast("int").alias("length"))

    def fold(given: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            here, last, shift = F.get(given["lens"], i - 1), F.get(given["lens"], i - 2), F.get(given["shifts"], i - 1)
            done = F.concat(s["cuts"], F.array(pair(s["a"], i - 1)))
            over = (s["length"] + here + 2 > size) | (shift & (s["length"] > size // 3))
            return (
                F.when(here > size, state(F.concat(F.when(s["a"] > 0, done).otherwise(s["cuts"]), F.array(pair(i, i))), F.lit(0), F.lit(0)))
                .when(s["a"] == 0, state(s["cuts"], i, here))
                .when(over & (last < overlap) & ~shift, state(done, i - 1, last + here + 2))
                .when(over, state(done, i, here))
                .otherwise(state(s["cuts"], s["a"], s["length"] + here + 2))
            )

        rest = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i > 1)
        start = state(F.array().cast("array<struct<a:int,b:int>>"), F.lit(1), F.get(given["lens"], F.lit(0)))
        return F.aggregate(rest, start, step, lambda s: F.when(s["a"] > 0, F.concat(s["cuts"], F.array(pair(s["a"], n)))).otherwise(s["cuts"]))

    def texts(cut: Column) -> Column:
        joined = F.array_join(F.slice(parts, cut["a"], cut["b"] - cut["a"] + 1), "\n\n")
        long = F.get(parts, cut["a"] - 1)
        starts = F.sequence(F.lit(0), F.ceil(F.greatest(F.length(long) - size, F.lit(0)) / (size - overlap)).cast("int"))
        windows = F.transform(starts, lambda k: F.substring(long, k * (size - overlap) + 1, F.lit(size)))
        return F.when((F.length(long) > size) & ((cut["a"] > 1) | F.lit(split_first)), windows).otherwise(F.array(joined))

    def merged(raw: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(raw)), lambda k: (k == 1) | (F.length(F.get(raw, k - 1)) >= tiny))
        return once(heads, lambda h: F.transform(h, lambda k, i: F.array_join(F.slice(raw, k, F.coalesce(F.get(h, i + 1), F.size(raw) + 1) - k), "\n\n")))

    cuts = once(F.struct(lens.alias("lens"), shifts.alias("shifts")), fold)
    whole = F.array(F.array_join(parts, "\n\n"))
    short = F.aggregate(lens, F.lit(0), lambda s, x: s + x) <= size
    good = lambda t: (F.length(F.btrim(t)) >= 20) & (F.size(words(t)) >= 3) & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 0.2 * F.length(t))
    long = F.filter(once(F.flatten(F.transform(cuts, texts)), merged), good)
    return F.when(n == 0, F.array().cast("array<string>")).when(short, whole).otherwise(long)


def grams(parts: Column, n: int) -> Column:
    """Distinct runs of n parts, joined by spaces."""
    def cut(w: Column) -> Column:
        last = F.size(w) - n + 1
        runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return once(parts, cut)


def redact(text: Column) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1].replace("$", r"\$")), REDACTED, text)


def density(text: Column) -> Column:
    """Chunk quality from 0 to 1: letters, distinct words, sentences and a citation, weighted."""
    t = F.trim(text)
    w = words(F.lower(t))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.greatest(F.length(t), F.lit(1))
    distinct = F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))
    sentences = F.least(F.regexp_count(t, F.lit("[.!?]+")) / 5.0, F.lit(1.0))
    cited = F.when(t.rlike(r"\([A-Z][a-z]+.*?(19|20)\d{2}\)"), 1.0).otherwise(0.5)
    return F.when(F.length(t) < 20, F.lit(0.0)).otherwise(F.round(letters * 0.3 + distinct * 0.3 + sentences * 0.2 + cited * 0.2, 3))


def languages(text: Column, first: int | None = None) -> list[tuple[str, Column]]:
    """(language, how many of its words the text holds, or its first so many words)."""
    every = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    held = F.array_distinct(every if first is None else F.slice(every, 1, first))
    return [(k, F.size(F.array_intersect(held, F.array(*map(F.lit, v.split()))))) for k, v in LANGUAGE_WORDS.items()]


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def frequencies(docs: DataFrame, values: Column, name: str, chars: int = 4_000_000) -> DataFrame:
    """(name, n, n_docs) of the values, an array, of documents (doc_id, text): how often each occurs, and in how many rows. Texts are dealt to parts of about so many characters, whose values
    are counted there, and counts to as many parts, so a task's memory doesn't grow with the table."""
    mark = lambda x, n, docs: F.struct(x.alias(name), F.lit(n).cast("long").alias("n"), F.lit(docs).cast("long").alias("docs"))
    every = F.concat(F.transform("t", lambda x: mark(x, 1, 0)), F.transform(F.array_distinct("t"), lambda x: mark(x, 0, 1)))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // chars))
    dealt = docs.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part")).repartitionById(parts, F.col("part"))
    own = dealt.select("part", values.alias("t")).select("part", F.explode(every).alias("x")).groupBy("part", f"x.{name}").agg(F.sum("x.n").alias("n"), F.sum("x.docs").alias("docs"))
    return own.repartition(parts, name).groupBy(name).agg(F.sum("n").alias("n"), F.sum("docs").alias("n_docs"))
