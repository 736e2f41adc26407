"""Files, an index that follows changes, and streams whose rows don't depend on batches."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark import registry
from quillspark.operators import questions, quantiles
from quillspark.operators.sentences import claims
from quillspark.sources import corpus
from quillspark.streaming import ordered


def test_files_of_a_folder(spark, tmp_path):
    root = tmp_path / "a folder (1)"
    for name, data in {
        "a.txt": b"plain", "sub/b.MD": b"# head", "sub/.hid/c.txt": b"x", ".d.txt": b"x", "node_modules/e.txt": b"x", "f.bin": b"x", "big.txt": b"x" * 500, "g.html": b"<p>one</p><script>bad()</script> two<!-- no -->",
        "h.json": b'{"k": ["v", 1]}', "i.tex": b"\\section{Top} text % note\nmore 5\\% \\emph{x}", "bad.txt": b"a\xffb", "empty.txt": b"", "map.gdb/j.txt": b"x",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    rows = corpus.list_files(spark, str(root), most=100).withColumn("text", corpus.file_text(F.col("suffix"), F.col("content")))
    got = {r.rel_path: " ".join(r.text.split()) for r in rows.collect()}
    assert got == {"a.txt": "plain", "sub/b.MD": "# head", "g.html": "one two", "h.json": "k : v 1", "i.tex": "Top text more 5\\% x", "bad.txt": "a�b"}


def test_manifests_differ(spark):
    df = lambda rows: spark.createDataFrame(rows, "rel_path string, sha256 string")
    got = corpus.manifest_diff(df([("a", "1"), ("b", "1"), ("c", "1")]), df([("b", "1"), ("c", "2"), ("d", "1")]))
    assert {tuple(r) for r in got.collect()} == {("a", "gone"), ("c", "changed"), ("d", "new")}


def day(n):
    return datetime.datetime(2024, 1, n)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    index = corpus.CorpusIndex(spark, f"file://{tmp_path}/index", 4, 1)
    df = lambda rows: spark.createDataFrame(rows, corpus.CHANGES)
    text = lambda: {(r.rel_path, r.chunk): r.text for r in index.chunks().collect()}
    assert text() == {}
    index.apply(df([("a", day(1), "one two three four five"), ("b", day(1), "x y"), ("b", day(2), "x z"), ("gone", day(5), None), (None, day(1), "q"), ("void", day(1), "")]), 0)
    first = text()
    assert first == {("a", 0): "one two three four", ("a", 1): "four five", ("b", 0): "x z"}
    again = df([("a", day(3), "one two three four five"), ("b", day(3), None), ("c", day(3), "new"), ("gone", day(4), "too old")])
    index.apply(again, 1)
    held = text()
    assert held == {("a", 0): "one two three four", ("a", 1): "four five", ("c", 0): "new"}
    before = Counter(map(tuple, index.manifest().collect()))
    index.apply(again, 1)
    assert text() == held and Counter(map(tuple, index.manifest().collect())) == before
    assert index.manifest().where("rel_path = 'a'").first().home == 0  # a changed file replaces its own chunks only
    index.apply(df([("a", day(2), "older than what is held")]), 2)
    assert text() == held
    index.apply(df([]), 3)
    small = index.compacted(f"file://{tmp_path}/small")
    assert {(r.rel_path, r.chunk): r.text for r in small.chunks().collect()} == held and small.manifest().count() == 3  # a, c and void, which has no chunks


def test_an_index_is_brought_to_a_folder(spark, tmp_path):
    index = corpus.CorpusIndex(spark, f"file://{tmp_path}/index")
    root = tmp_path / "files"
    root.mkdir()
    seen = lambda: corpus.list_files(spark, str(root)).select("rel_path", "modified", corpus.file_text(F.col("suffix"), F.col("content")).alias("text"))
    (root / "a.txt").write_text("first words")
    (root / "b.txt").write_text("other words")
    assert {tuple(r) for r in index.sync(seen()).collect()} == {("a.txt", "new"), ("b.txt", "new")}
    assert index.sync(seen()).collect() == []
    (root / "a.txt").write_text("changed words")
    (root / "b.txt").unlink()
    assert {tuple(r) for r in index.sync(seen()).collect()} == {("a.txt", "changed"), ("b.txt", "gone")}
    assert [r.text for r in index.chunks().collect()] == ["changed words"]


@pytest.mark.parametrize("files", [1, 6])
def test_rows_in_order_whatever_the_batches(spark, tmp_path, files):
    rng = random.Random(4)
    events = [(f"k{rng.randrange(3)}" if i % 50 else None, i, rng.gauss(0, 1) * (9 if i % 37 == 0 else 1), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(4000))) for i in range(400)]
    events.sort(key=lambda e: (e[3] + datetime.timedelta(seconds=rng.randrange(600))))  # out of order by less than the delay
    kind = "kind string, event_id long, value double, t timestamp"
    for n in range(files):
        spark.createDataFrame(events[n * len(events) // files : (n + 1) * len(events) // files], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    rule = ordered.anomaly(window=20, cooldown=datetime.timedelta(seconds=300))
    got = ordered.closed(spark, stream, lambda e: ordered.in_order(e, "kind", F.col("value"), "values array<double>, last bigint", ([], -1), rule, "10 minutes")).collect()
    want, state = set(), {}
    for key, event, value, t in sorted(events, key=lambda e: (e[3], e[1])):
        state[key], result = rule(state.get(key, ([], -1)), round((t - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6), value)
        if result is not None:
            want.add((key, event, round(result, 9)))
    assert {(r.kind, r.event_id, round(r.result, 9)) for r in got} == want and len(got) == len(want) > 3


@pytest.mark.parametrize("few", [10_000, 3])
def test_order_statistics_of_skewed_values(spark, few):
    rng = random.Random(8)
    rows = [("a", rng.gauss(0, 1) ** 9) for _ in range(700)] + [("b", float(rng.randrange(3))) for _ in range(300)] + [("c", 5.0), ("a", None), (None, 1.0), ("d", -1e12), ("d", 1e12)]
    held = {k: sorted(v for x, v in rows if x == k and v is not None) for k in "abcd"}
    want = {(k, p): v[p] for k, v in held.items() for p in {0, len(v) // 2, len(v) - 1, len(v) * 9 // 10}}
    df = spark.createDataFrame(rows, "k string, v double")
    places = spark.createDataFrame([*want, ("a", 5000), ("z", 0)], "k string, place long")
    assert {(r.k, r.place): r.v for r in quantiles.at_places(df, "k", "v", places, few).collect()} == want
    got = {r.k: (r.x, r.y) for r in quantiles.quantiles(df, "k", "v", {"x": 0.95, "y": 0.0}, few).collect()}
    for k, v in held.items():
        at = (len(v) - 1) * 0.95
        low = int(at)
        assert abs(got[k][0] - (v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low))) <= 1e-9 * max(1, abs(got[k][0])) and got[k][1] == v[0]


def test_claims_of_any_case_over_lines_and_of_all_forms(spark):
    texts = [
        "Rising RENT LEADS\nTO fewer births in town.", "Without cheap credit, the growth of cities would stop.", "If the old law were not passed, turnout rises.",
        "A change in local rent causes an increase in crime rates.", "Social trust mediates the effect of local income.", "Party size moderates the relationship between rules.",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", F.explode(claims(F.col("t"))).alias("c")).collect()
    got = {(r.id, r.c["link"], r.c["cause"], r.c["effect"]) for r in rows}
    assert {
        (0, "leads_to", "Rising RENT", "fewer births in town"), (1, "counterfactual", "cheap credit", "the growth of cities"), (2, "counterfactual", "the old law", "turnout rises"),
        (3, "mechanism", "local rent", "crime rates"), (4, "mediator", "Social trust", "local income"), (5, "moderator", "Party size", "rules"),
    } <= got


def test_debate_and_consensus_by_the_rules(spark, tmp_path):
    marker = questions.DEBATE[0]
    rows = [(1, f"On this {marker.upper()} point", "a"), (2, "no doubt about it", "a"), (3, "NO! no! NO!", "b"), (4, None, "b"), (5, "calm", "b"), (6, "", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    debate = registry.queries()["text_debate"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in debate} >= {1} and not {3, 4, 5, 6} & {r.doc_id for r in debate}
    got = {r.source: (r.texts, r.signals, r.level) for r in registry.queries()["text_consensus"](spark, str(tmp_path)).collect()}
    assert got["b"] == (2, 0, "unanimous") and set(got) == {"a", "b"}
