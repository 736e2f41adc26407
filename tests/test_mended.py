"""What the fourth round of findings asked for."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quillspark import registry
from quillspark.operators import sets, walks
from quillspark.operators.network import kept_at


def shuffled(spark):
    """Rows written to shuffles so far, by stage."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}


def test_sets_meet_without_a_row_for_each_token(spark):
    rng = random.Random(4)
    rows = [(i, rng.sample(range(90), 60)) for i in range(500)] + [(1000 + i, [*range(200, 259), 300 + i]) for i in range(3)]
    df = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in rows], "id long, s array<string>").repartition(2).localCheckpoint()
    before = shuffled(spark)
    got = {(r.a, r.b) for r in sets.set_pairs(df, 0.75).collect()}
    moved = sum(n for k, n in shuffled(spark).items() if k not in before)
    assert got == {(1000, 1001), (1000, 1002), (1001, 1002)}
    assert moved < 10_000  # of 30,180 tokens


@pytest.mark.parametrize("share, strict", [(0.75, False), (0.8, True), (0.92, True)])
def test_pairs_of_sets_of_many_sizes(spark, share, strict):
    rng = random.Random(int(share * 100))
    rows = []
    for i in range(160):
        s = set(rng.sample(range(900), rng.randrange(1, 500))) if i % 4 == 0 else set(rows[-1][1])
        drop = rng.randrange(0, max(1, int(len(s) * 0.16)))
        s = set(sorted(s)[drop:] if i % 2 else rng.sample(sorted(s), len(s) - drop)) | set(rng.sample(range(900), rng.randrange(0, 1 + len(s) // 12)))
        rows.append((i, s))
    df = spark.createDataFrame([(i, [f"w{x}" for x in sorted(s)]) for i, s in rows], "id long, s array<string>")
    want = {}
    for (a, s), (b, t) in combinations(rows, 2):
        j = len(s & t) / len(s | t)
        if j > share if strict else j >= share:
            want[a, b] = len(s & t)
    assert {(r.a, r.b): r.common for r in sets.set_pairs(df, share, strict, 50).collect()} == want and len(want) > 20


def test_classes_of_ids_with_several_texts(spark):
    rows = [(5, ["a"]), (3, ["a"]), (5, ["b"]), (5, ["b"]), (6, ["b"]), (7, ["c"]), (7, ["d"]), (8, [])]
    own, held = sets.classes(spark.createDataFrame(rows, "doc_id long, t array<string>"), F.col("t"))
    assert sorted((r.doc_id, r["id"], r.size) for r in own.select("doc_id", "id", F.col("size").alias("size")).collect()) == [(3, 3, 1), (5, 3, 1), (5, 5, 1), (5, 5, 1), (6, 5, 1), (7, 7, 1), (7, 7, 1), (8, 8, 0)]
    assert sorted((r["id"], r.s) for r in held.collect()) == [(3, ["a"]), (5, ["b"]), (7, ["c"]), (7, ["d"]), (8, [])]


def test_sparse_scores_are_rounded_from_exact_sums(spark, tmp_path):
    rng = random.Random(2)
    some = lambda most: " ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) for _ in range(rng.randrange(1, most)))
    docs, items = [(i, some(60)) for i in range(800)], [(i, some(25)) for i in range(150)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    weights = lambda t: {x: round(math.log(1 + n) * 10_000) for x, n in Counter(t.split()).items()}
    held, want, halves = [(i, weights(t)) for i, t in docs], {}, 0
    for item, text in items:
        asked = weights(text)
        sums = [(sum(w * asked.get(x, 0) for x, w in d.items()), i) for i, d in held]
        for rank, (score, i) in enumerate(sorted((-((s + 50) // 100), i) for s, i in sums if s)[:10], 1):
            want[item, rank] = (i, -score / 1_000_000)
            halves += next(s for s, d in sums if d == i) % 100 == 50
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in registry.queries()["retrieve_sparse"](spark, str(tmp_path)).collect()}
    assert got == want and halves > 5


@pytest.mark.parametrize("name, share", [("dup_greedy", 0.8), ("dup_greedy_words", 0.92)])
def test_keep_first_shuffles_no_tokens(spark, tmp_path, name, share):
    rng = random.Random(9)
    texts = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + str(rng.randrange(9)) for _ in range(90)] for _ in range(300)]
    texts = [list(texts[rng.randrange(i)]) if i % 5 == 4 else t for i, t in enumerate(texts)]
    for t in texts[4::5]:
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = "new"
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, ""), (901, None)], "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    kept, held = {}, []
    for i, t in enumerate(texts):
        s = set(zip(t, t[1:], t[2:], strict=False)) if name == "dup_greedy" else set(t)
        kept[i] = all(len(s & x) / len(s | x) <= share for x in held)
        if kept[i]:
            held.append(s)
    before = shuffled(spark)
    got = {r.doc_id: r.kept for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    moved = sum(n for k, n in shuffled(spark).items() if k not in before)
    assert got == kept | {900: True, 901: name != "dup_greedy"} and 0 < sum(not k for k in kept.values())
    assert moved < 10_000  # of 27,000 tokens


def test_sentences_are_not_shuffled_for_each_block_they_meet(spark):
    rng = random.Random(5)
    words = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{i:03}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(rng.sample(words, 90)) + (" increases" if i % 2 else " decreases")) for i in range(240)], "doc_id long, text string").coalesce(2)
    plans, got = [], []
    for bucket in (1000, 80):
        found = sets.contradictions(docs, sets.OPPOSED, bucket=bucket)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        got.append({r.claim: (r.n_links, r.first) for r in found.collect()})
    assert got[0] == got[1] and sum(n for n, _ in got[0].values()) > 10_000
    assert not any("CoGroup" in p for p in plans)  # blocks that meet were shuffled for a cogroup


def test_clusters_are_sought_by_numbers_with_the_rows_of_names(spark, monkeypatch):
    folder, held = "/root/testdata/sf0.001", []

    def noted(df):
        held.append(dict(df.dtypes))
        return kept_at(df)

    want = {r.node: r.cluster for r in walks.bounded_clusters(walks._supply(spark, folder)).collect()}
    monkeypatch.setattr(walks, "kept_at", noted)
    got = {r.node: r.cluster for r in registry.queries()["graph_clusters"](spark, folder).collect()}
    assert got == want and len(set(got.values())) > 5
    assert held and all(x["a"] == x["b"] == "bigint" for x in held)
