"""Whole inputs: what earlier versions of these queries cut."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from quillspark import registry
from quillspark.operators.graph import page_rank
from quillspark.operators.network import components
from quillspark.operators.retrieval import bm25

FOLDER = "/root/testdata/sf0.001"


def whole_sql(name):
    """Rows of the query's SQL."""
    con = duckdb.connect()
    for t in ("benchmark", "documents", "embeddings", "labels", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    found = con.execute(registry.oracle_sql()[name])
    return [c[0] for c in found.description], found.fetchall()


def rounded(rows):
    return Counter(tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in rows)


def test_bm25_takes_all_words_of_an_item(spark):
    docs = {1: "aa bb cc dd ee ff gg hh", 2: "zz yy xx", 3: "aa zz zz", 4: "qq"}
    items = {7: "aa bb cc dd ee ff gg hh zz yy zz", 8: "ww"}
    tokens = {d: re.findall("[a-z0-9]{2,}", t) for d, t in docs.items()}
    mean, want = sum(map(len, tokens.values())) / len(tokens), {}
    for i, text in items.items():
        for d, t in tokens.items():
            for q in text.split():
                if q in t:
                    df = sum(q in o for o in tokens.values())
                    part = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / mean))
                    want[i, d] = want.get((i, d), 0) + part
    rows = lambda x, key: spark.createDataFrame(list(x.items()), f"{key} bigint, text string")
    got = {(r.item_id, r.doc_id): r.score for r in bm25(rows(docs, "doc_id"), rows(items, "item_id"), 4).collect()}
    assert got.keys() == want.keys() and (7, 2) in got
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


@pytest.mark.parametrize("name", ["retrieve_bm25", "retrieve_hybrid", "retrieve_diagnostics"])
def test_ranks_by_all_words(spark, name):
    columns, want = whole_sql(name)
    assert rounded(registry.queries()[name](spark, FOLDER).select(*columns).collect()) == rounded(want)


def joined(pairs):
    """{node: least node of its component} by union-find."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in list(up)}


def test_components_of_chains_rings_and_stars(spark):
    rng = random.Random(5)
    pairs = [(f"s{rng.randrange(60)}", f"p{rng.randrange(90)}") for _ in range(70)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)] + [("hub", f"x{i}") for i in range(30)]
    got = components(spark.createDataFrame(pairs, "u string, v string")).collect()
    assert {r.node: r.component for r in got} == joined(pairs) and len(got) == len(joined(pairs))


def test_components_of_all_lines(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect()
    want = joined((f"s{s}", f"p{p}") for s, p in lines)
    got = {r.node: r.component for r in registry.queries()["graph_components"](spark, FOLDER).collect()}
    assert got == want
    sizes = {r.component: (r.n, r.suppliers) for r in registry.queries()["graph_component_sizes"](spark, FOLDER).collect()}
    assert sizes == {c: (sum(x == c for x in want.values()), sum(x == c and node[0] == "s" for node, x in want.items())) for c in set(want.values())}


@pytest.mark.parametrize("name", ["graph_hops", "graph_colliders"])
def test_graph_of_all_lines(spark, name):
    columns, want = whole_sql(name)
    assert rounded(registry.queries()[name](spark, FOLDER).select(*columns).collect()) == rounded(want)


def test_ranks_of_rings_chains_and_dangling_nodes(spark):
    links = {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "a"), ("d", "d")}
    real = {x for x in links if x[0] != x[1]}
    nodes = {x for link in real for x in link}
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(12):
        want = {n: 0.15 / len(nodes) + 0.85 * sum(want[a] / sum(x == a for x, _ in real) for a, b in real if b == n) for n in nodes}
    for deal in (100_000, 1):  # a source in one deal or in several
        got = {r.id: r.v for r in page_rank(spark.createDataFrame(sorted(links), "src string, dst string"), 12, deal=deal).collect()}
        assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in want)


def test_ranks_of_all_suppliers_and_parts(spark):
    links = {tuple(r) for r in spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()}
    links = {(f"s{s}", f"p{p}") for s, p in links} | {(f"p{p}", f"s{s}") for s, p in links}
    out = Counter(a for a, _ in links)
    want = dict.fromkeys(out, 1 / len(out))
    for _ in range(50):
        new = dict.fromkeys(out, 0.15 / len(out))
        for a, b in links:
            new[b] += 0.85 * want[a] / out[a]
        want = new
    got = {r.id: r["rank"] for r in registry.queries()["graph_rank"](spark, FOLDER).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)


def test_every_chunk_is_stitched(spark):
    columns, want = whole_sql("retrieve_stitched")
    assert rounded(registry.queries()["retrieve_stitched"](spark, FOLDER).select(*columns).collect()) == rounded(want)
