"""Operators over whole tables against plain definitions, on rows that the given tables lack."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import registry
from quillspark.operators import causal, neighbours, postings, regression, sets, tags, walks

FOLDER = "/root/testdata/sf0.01"


# nearest vectors


def vectors(seed, n, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(0, 12, n)] + rng.normal(scale=0.3, size=(n, dims))
    return [(int(i), [float(v) for v in np.round(row, 4)]) for i, row in enumerate(x)]


def odd_vectors():
    return [(900, None), (901, [None] + [1.0] * 7), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [float("inf")] + [1.0] * 7), (905, []), (906, [1.0, 2.0]), (907, [2.0, 1.0]), (908, [1e300] * 8), (None, [1.0] * 8)]


def plain_nearest(rows, queries, k):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(v) / np.abs(v).max() for i, v in fine}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    out = set()
    for q in queries:
        if q in unit:
            near = sorted((-round(float(unit[q] @ v), 6), i) for i, v in unit.items() if i != q and len(v) == len(unit[q]))[:k]
            out |= {(q, i, rank + 1) for rank, (_, i) in enumerate(near)}
    return out


@pytest.mark.parametrize("block", [10_000, 7])
def test_nearest_in_place_and_in_a_grid(spark, block):
    rows = vectors(1, 300) + odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = neighbours.nearest(df, df.where("vec_id % 3 = 0 or vec_id > 890"), 6, block).collect()
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == plain_nearest(rows, [i for i, _ in rows if i is not None and (i % 3 == 0 or i > 890)], 6)


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    some = spark.createDataFrame(vectors(2, 5), none.schema)
    assert neighbours.nearest(none, none, 3).collect() == [] and neighbours.nearest(some, none, 3).collect() == [] and neighbours.nearest(none, some, 3).collect() == []
    assert neighbours.Index(none).search(some, 3).collect() == []


def test_nearest_within_teams(spark):
    rows = [(i % 3 if i % 10 else None, i, v) for i, v in vectors(3, 200)]
    df = spark.createDataFrame(rows, "team int, vec_id long, embedding array<double>")
    asked = [(t, i, v) for t, i, v in rows if i % 4 == 0] + [((t + 1) % 3, i, v) for t, i, v in rows if i % 8 == 0 and t is not None]
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest_within(df, spark.createDataFrame(asked, df.schema), 4, 5).collect()}
    want, unit = set(), {i: np.array(v) / np.linalg.norm(v) for i, v in vectors(3, 200)}
    teams = defaultdict(set)
    for t, i, _ in asked:
        teams[i].add(t)
    for q, mine in teams.items():
        near = sorted((-round(float(unit[q] @ unit[i]), 6), i) for t, i, _ in rows if t in mine and t is not None and i != q)[:4]
        want |= {(q, i) for _, i in near}
    assert got == want


@pytest.mark.parametrize("tile, block", [(1 << 16, 4096), (40, 9)])
def test_index_finds_nine_of_ten(spark, tile, block):
    copies = [(5000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8 + i / 1000]) for i in range(300)]  # a third of the rows in one list
    df = spark.createDataFrame(vectors(4, 600) + copies + odd_vectors()[:5], "vec_id long, embedding array<double>").repartition(4)
    asked = df.where("vec_id % 5 = 0")
    index = neighbours.Index(df, tile=tile)
    assert index.lists.count() == 900
    true = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, asked, 10).collect()}
    got = index.search(asked, 10, block=block).collect()
    assert len({(r.query_id, r.vec_id) for r in got} & true) >= 0.9 * len(true) and len(got) == len(true)
    assert index.codebooks.where("kind = 'cell'").count() == len(index.books.cells)


def test_index_of_the_given_vectors(spark):
    true, got = ({(r.query_id, r.vec_id) for r in registry.queries()[q](spark, FOLDER).collect()} for q in ("retrieve_nearest", "retrieve_approximate"))
    assert len(got & true) >= 0.9 * len(true) and len(got) == len(true)


# sets


def some_sets(seed, n=140):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    base = [rng.sample(words, rng.randrange(1, 40)) for _ in range(12)]
    out = []
    for i in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 5, 12])):
            s[rng.randrange(len(s))] = rng.choice(words)
        out.append((i, sorted(set(s + ["hot"]))))
    return out + [(900, []), (901, None), (902, ["only"]), (903, ["only", "two"])]


@pytest.mark.parametrize("share, strict", [(0.75, False), (0.75, True), (0.5, False), (0.92, True), (1.0, False)])
@pytest.mark.parametrize("bucket", [1000, 3])
def test_set_pairs_by_all_pairs(spark, share, strict, bucket):
    rows = some_sets(round(share * 100))
    got = {(r.a, r.b): r.common for r in sets.set_pairs(spark.createDataFrame(rows, "id long, s array<string>"), share, strict, bucket).collect()}
    want = {}
    for (a, s), (b, t) in combinations(rows, 2):
        s, t = set(s or ()), set(t or ())
        if s and t:
            j = len(s & t) / len(s | t)
            if j > share if strict else j >= share:
                want[a, b] = len(s & t)
    assert got == want and (want or share == 1.0)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_is_the_pass_in_order(spark, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)} | {(i, i + 1) for i in range(100, 140)}
    keep = {}
    for node in sorted({x for p in pairs for x in p}):
        keep[node] = not any(keep[a] for a, b in pairs if b == node)
    got = {r["id"]: r["kept"] for r in sets.greedy(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert got == keep


def test_keep_first_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, None), (3, "d c b a"), (4, ""), (5, "a b c d"), (None, "a b"), (6, "q")], "doc_id long, text string")
    words = sets.C.words(F.lower("text"))
    assert {r.doc_id: r.kept for r in sets.keep_first(docs, words, 0.8).collect()} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True}
    assert {r.doc_id: r.kept for r in sets.keep_first(docs, sets.word_grams(F.col("text")), 0.8).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True}
    assert sets.keep_first(docs.where("false"), words, 0.8).collect() == []


def test_contradictions_by_all_pairs(spark):
    rng = random.Random(6)
    words = "turnout welfare growth trade violence income party state reform budget".split()
    verbs = ["increases", "decrease", "is higher", "Lower", "confirms", "contradicts", "correlates", "shows no significant relationship", "rises"]
    docs = [(d, ". ".join(f"{' '.join(rng.sample(words, 4))} {rng.choice(verbs)}" + rng.choice(["", "\n", " Always"]) for _ in range(4)) + "!") for d in range(60)]
    docs += [(99, None), (98, ""), (97, docs[0][1]), (96, "short. tiny!")]
    got = {r.claim: (r.n_docs, r.n_links) for r in sets.contradictions(spark.createDataFrame(docs, "doc_id long, text string"), sets.OPPOSED, bucket=5).collect()}
    claims = defaultdict(set)
    for d, text in docs:
        for c in re.split("[.!?]+", text or ""):
            if len(c.strip()) > 20:
                claims[c.strip()].add(d)
    flags = {c: [[bool(re.search(p[s], c.lower())) for p in sets.OPPOSED] for s in (0, 1)] for c in claims}
    claims = {c: d for c, d in claims.items() if any(flags[c][0] + flags[c][1])}
    tokens = {c: set(re.findall(r"\w{4,}", c.lower())) for c in claims}
    links = Counter()
    for a, b in combinations(claims, 2):
        against = any((x and w) or (y and v) for x, y, v, w in zip(*flags[a], *flags[b], strict=True))
        if against and len(tokens[a] & tokens[b]) >= 3 and len(claims[a] | claims[b]) > 1:
            links.update([a, b])
    md5 = lambda c: __import__("hashlib").md5(c.encode()).hexdigest()
    assert got == {md5(c): (len(d), links[c]) for c, d in claims.items()} and links


def test_signal_pairs_are_counted_without_being_listed(spark):
    rng = random.Random(2)
    docs = [(i, " and ".join(rng.sample([s for pair in sets.SIGNALS for s in pair] + ["nothing"], 3))) for i in range(40)] + [(41, None)]
    got = {r.signal: (r.n_for, r.n_against, r.n_pairs) for r in sets.signal_conflicts(spark.createDataFrame(docs, "doc_id long, text string"), sets.SIGNALS).collect()}
    for p, n in sets.SIGNALS:
        held = [(p in (t or ""), n in (t or "")) for _, t in docs]
        pairs = sum((a[0] and b[1]) or (a[1] and b[0]) for a, b in combinations(held, 2))
        assert got[f"{p} vs {n}"] == (sum(h[0] for h in held), sum(h[1] for h in held), pairs)


# the index of impacts


@pytest.mark.parametrize("documents", [5, 1000])
def test_index_gives_the_exact_best(spark, documents):
    rng = random.Random(9)
    rows = [(t, d, round(rng.random() ** 3, 3)) for d in range(300) for t in rng.sample([f"t{i}" for i in range(40)], 6)] + [("t1", 400, 0.0), (None, 401, 1.0), ("t1", None, 1.0)]
    query = [(q, t, round(rng.random(), 2) + 0.01) for q in range(12) for t in rng.sample([f"t{i}" for i in range(45)], 4)] + [(50, "absent", 1.0), (51, "t1", 0.0)]
    index = postings.ImpactIndex(spark.createDataFrame(rows, "term string, doc_id long, impact double"), documents)
    found, read = index.search(spark.createDataFrame(query, "item_id long, term string, weight double"), 5, 2)
    want = {}
    for q in range(12):
        score = Counter()
        for t, d, i in rows:
            for item, term, w in query:
                if item == q and term == t and d is not None and i > 0:
                    score[d] += i * w
        want |= {(q, d): rank + 1 for rank, (d, _) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5])}
    assert {(r.item_id, r.doc_id): r["rank"] for r in found.collect()} == want
    read = read.collect()
    assert all(r.read <= r.blocks for r in read) and (documents == 1000 or sum(r.read for r in read) < sum(r.blocks for r in read))


# causal graphs


def some_dag(seed, n=7, share=0.35):
    rng = random.Random(seed)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < share]


def below(edges, node):
    out, todo = set(), [node]
    while todo:
        for a, b in edges:
            if a == todo[-1] and b not in out:
                out.add(b)
                todo.append(b)
                break
        else:
            todo.pop()
    return out


def simple_paths(edges, path, end):
    if path[-1] == end:
        yield path
        return
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            if x == path[-1] and y not in path:
                yield from simple_paths(edges, [*path, y], end)


def plain_backdoor(edges, t, y, z):
    up = lambda n: {a for a in range(20) if n in below(edges, a)}
    blocked = True
    for path in simple_paths(edges, [t], y):
        if len(path) > 1 and (path[1], t) in edges:
            shut = False
            for a, b, c in zip(path, path[1:], path[2:], strict=False):
                collider = (a, b) in edges and (c, b) in edges
                shut |= (b not in z and not below(edges, b) & z) if collider else b in z
            blocked &= shut
    rule1 = not z & below(edges, t)
    common = up(t) & up(y)
    return ("IDENTIFIED" if rule1 and blocked else "COLLIDER_BIAS" if not rule1 else "CONFOUNDED", rule1, blocked, len(common), len(common - z))


def test_backdoor_by_all_paths(spark):
    rng, edges, cases, given, want = random.Random(3), [], [], [], {}
    for model in range(40):
        dag = some_dag(model)
        edges += [(model, a, b) for a, b in dag]
        for _ in range(4):
            t, y = rng.sample(range(7), 2)
            z = set(rng.sample([x for x in range(7) if x not in (t, y)], rng.randrange(0, 4)))
            case = len(cases)
            cases.append((case, model, t, y))
            given += [(case, x) for x in z] + [(case, t)]
            want[case] = plain_backdoor(dag, t, y, z)
    got = causal.backdoor(*[spark.createDataFrame(r, s) for r, s in ((edges, "model int, u int, v int"), (cases, "case int, model int, t int, y int"), (given, "case int, z int"))]).collect()
    assert {r["case"]: (r.status, r.rule1, r.rule2, r.confounders, r.missing) for r in got} == want and len({w[0] for w in want.values()}) == 3


def test_instruments_by_plain_sets(spark):
    rng, edges, cases, want = random.Random(4), [], [], {}
    for model in range(40):
        dag = some_dag(100 + model)
        edges += [(model, a, b) for a, b in dag]
        for _ in range(4):
            i, t, y = rng.sample(range(7), 3)
            case = len(cases)
            cases.append((case, model, i, t, y))
            around = [(a, b) for a, b in dag if t not in (a, b)]
            up = lambda n, dag=dag: {a for a in range(7) if n in below(dag, a)}
            want[case] = ((i, t) in dag, y not in below(around, i), not up(i) & up(y))
    got = causal.instruments(spark.createDataFrame(edges, "model int, u int, v int"), spark.createDataFrame(cases, "case int, model int, i int, t int, y int")).collect()
    assert {r["case"]: (r.relevance, r.exclusion, r.independence) for r in got} == want


def test_closures_of_diamonds_and_cycles(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "q"), ("s", "s"), (None, "a")]
    got = {r.node: (r.n, r.exact) for r in causal.closure_sizes(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 4, "b": 2, "c": 2, "d": 1, "e": 0, "x": 3, "y": 3, "z": 3, "q": 0} and all(v[1] for v in got.values())


def test_closures_beyond_the_sketch_are_estimates(spark):
    edges = [(i, 2 * i + c) for i in range(1, 1024) for c in (0, 1)]
    got = {r.node: r for r in causal.closure_sizes(spark.createDataFrame(edges, "u long, v long"), 64).collect()}
    assert not got[1].exact and abs(got[1].n - 2046) < 4 * 2046 / math.sqrt(62) and got[64].exact and got[64].n == 30 and len(got) == 2047


# walks and clusters


def some_graph(seed, n=40, m=70):
    rng = random.Random(seed)
    return sorted({(*rng.sample(range(n), 2), round(rng.random(), 2) + 0.01) for _ in range(m)})


def test_walks_by_plain_steps(spark):
    edges = some_graph(5)
    links = {(a, b) for u, v, w in edges if w > 0.3 for a, b in ((u, v), (v, u))}
    want = {}
    for seed in (0, 7, 19):
        want[seed, seed], now = 0, {seed}
        for depth in (1, 2, 3):
            now = {b for a, b in links if a in now and (seed, b) not in want}
            want |= {(seed, b): depth for b in now}
    got = walks.walks(spark.createDataFrame(edges, "u long, v long, w double"), spark.createDataFrame([(s, s) for s in (0, 7, 19)], "seed long, node long"), 3)
    assert {(r.seed, r.node): r.depth for r in got.collect()} == want


def test_personal_ranks_are_within_the_bound(spark):
    edges = [e for e in some_graph(6) if 39 not in e[:2]]
    weight = defaultdict(float)
    for u, v, w in edges:
        for a, b in ((u, v), (v, u)):
            weight[a, b] = max(weight[a, b], w)
    every = Counter()
    for (a, _), w in weight.items():
        every[a] += w
    seeds = [(s, s) for s in sorted({a for a, _ in weight})[:3]] + [(39, 39)]
    got, left = walks.personal_ranks(spark.createDataFrame(edges, "u long, v long, w double"), spark.createDataFrame(seeds, "seed long, node long"), error=1e-3)
    got, left = {(r.seed, r.node): r["rank"] for r in got.collect()}, {r.seed: r.left for r in left.collect()}
    assert got.pop((39, 39)) == 1 and left[39] == 0
    for seed, _ in seeds[:3]:
        r, rank = {seed: 1.0}, Counter()
        for _ in range(300):
            new = Counter()
            for a, x in r.items():
                rank[a] += 0.15 * x
                for (u, v), w in weight.items():
                    if u == a:
                        new[v] += 0.85 * x * w / every[a]
            r = new
        assert all(-1e-9 <= rank[v] - got.get((seed, v), 0) <= 1e-3 * every[v] + 1e-9 for v in every)
        assert abs(sum(x for (s, _), x in got.items() if s == seed) + left[seed] - 1) < 1e-9


def test_clusters_keep_their_bound_and_agree(spark):
    edges = some_graph(8, 120, 300) + [(500, 500 + i, 1.0) for i in range(1, 60)]
    df = spark.createDataFrame(edges, "u long, v long, w double")
    got = {r.node: r.cluster for r in walks.bounded_clusters(df, 6).collect()}
    assert got == {r.node: r.cluster for r in walks.bounded_clusters(df.repartition(7), 6).collect()}
    size = Counter(got.values())
    assert set(got) == {x for e in edges for x in e[:2]} and max(size.values()) <= 6 and all(min(k for k in got if got[k] == c) == c for c in size)
    assert all(got[u] == got[v] or size[got[u]] + size[got[v]] > 6 for u, v, _ in edges)


def test_bridges_of_shared_and_complementary_keys(spark):
    rng = random.Random(3)
    keys = sorted({(c, rng.choice("abcdefgh")) for c in range(12) for _ in range(3)})
    size, pairs = {c: rng.randrange(1, 9) for c in range(12)}, [("a", "b"), ("c", "h")]
    held = {c: {k for x, k in keys if x == c} for c in size}
    want = {}
    for a, b in combinations(size, 2):
        shared = held[a] & held[b]
        for x, y in pairs:
            for p, q in ((x, y), (y, x)):
                if p in held[a] and q in held[b]:
                    shared |= {p, q}
        if shared:
            want[a, b] = (len(shared), len(shared) * min(size[a], size[b]))
    df = lambda r, s: spark.createDataFrame(r, s)
    got = walks.bridges(df(keys, "cluster int, key string"), df(sorted(size.items()), "cluster int, size int"), df(pairs, "x string, y string"), 2).collect()
    assert {(r.a, r.b): (r.shared, r.strength) for r in got} == want


# regressions


@pytest.fixture(scope="module")
def observed():
    rng = np.random.default_rng(5)
    n = 400
    z1, z2, x2, u = rng.normal(size=(4, n))
    x1 = 100 + z1 + 0.5 * z2 + u
    return {"y": 3 + 2 * x1 - x2 + u * (1 + np.abs(x2)) + rng.normal(size=n), "x1": x1, "x2": x2, "z1": z1, "z2": z2, "g": rng.integers(0, 30, n), "b": (rng.random(n) < 1 / (1 + np.exp(-(0.5 + x2 - z1)))).astype(int)}


@pytest.fixture(scope="module")
def observed_df(spark, observed):
    rows = [tuple(float(v[i]) for v in observed.values()) for i in range(400)] + [(None, 1.0, 1.0, 1.0, 1.0, 1.0, None), (1.0, float("nan"), 1.0, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, ", ".join(f"{k} double" for k in observed))


@pytest.mark.parametrize("errors", ["classic", "hc3", "cluster"])
def test_least_squares_by_matrices(observed, observed_df, errors):
    fit = regression.ols(observed_df, F.col("y"), {"x1": F.col("x1"), "x2": F.col("x2")}, errors, F.col("g") if errors == "cluster" else None)
    x = np.column_stack([np.ones(400), observed["x1"], observed["x2"]])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ observed["y"]
    e = observed["y"] - x @ beta
    if errors == "classic":
        cov = inv * (e @ e) / 397
    elif errors == "hc3":
        h = np.einsum("ij,jk,ik->i", x, inv, x)
        cov = inv @ (x.T @ (x * ((e / (1 - h)) ** 2)[:, None])) @ inv
    else:
        s = np.stack([(x * e[:, None])[observed["g"] == g].sum(0) for g in np.unique(observed["g"])])
        cov = inv @ (s.T @ s) @ inv * len(s) / (len(s) - 1) * 399 / 397
    assert fit.n == 400 and np.allclose(fit.beta, beta) and np.allclose(fit.cov, cov, rtol=1e-6, atol=1e-10)
    assert math.isclose(fit.r2, 1 - e @ e / ((observed["y"] - observed["y"].mean()) ** 2).sum()) and fit.adjusted() < fit.r2
    assert fit.wald()[1] < 1e-6


def test_two_stages_by_matrices(observed, observed_df):
    fit = regression.two_stage(observed_df, F.col("y"), {"x1": F.col("x1"), "x2": F.col("x2")}, {"z1": F.col("z1"), "z2": F.col("z2"), "x2": F.col("x2")})
    one = np.ones(400)
    x, z = np.column_stack([one, observed["x1"], observed["x2"]]), np.column_stack([one, observed["z1"], observed["z2"], observed["x2"]])
    hat = z @ np.linalg.solve(z.T @ z, z.T @ x)
    beta = np.linalg.solve(hat.T @ x, hat.T @ observed["y"])
    e = observed["y"] - x @ beta
    assert np.allclose(fit.beta, beta) and np.allclose(fit.cov, np.linalg.inv(hat.T @ hat) * (e @ e) / 397, rtol=1e-6, atol=1e-10)


def test_logit_is_at_the_maximum(observed, observed_df):
    fit = regression.logit(observed_df, F.col("b"), {"x2": F.col("x2"), "z1": F.col("z1")})
    x = np.column_stack([np.ones(400), observed["x2"], observed["z1"]])
    p = 1 / (1 + np.exp(-x @ fit.beta))
    assert np.abs(x.T @ (observed["b"] - p)).max() < 1e-6 and np.allclose(np.linalg.inv(fit.cov), (x * (p * (1 - p))[:, None]).T @ x)


def test_variables_that_depend_on_each_other_are_refused(observed_df):
    with pytest.raises(ValueError):
        regression.ols(observed_df, F.col("y"), {"x1": F.col("x1"), "twice": F.col("x1") * 2})


@pytest.mark.parametrize("f, d1, d2, tail", [(4.0, 1, 10, 0.073388), (3.0, 5, 20, 0.035098), (1.0, 7, 7, 0.5), (250.0, 2, 30, 0.0)])
def test_tails_of_f(f, d1, d2, tail):
    assert abs(regression.f_tail(f, d1, d2) - tail) < 2e-4


# tags


@pytest.mark.parametrize("most", [1 << 25, 30])
def test_tags_by_each_keyword(spark, most):
    rng = random.Random(7)
    keywords = [("k", f"t{i % 9}", "".join(rng.choices("abé", k=rng.randrange(1, 5)))) for i in range(40)] + [("k", "t1", ""), ("k", "Up", "AB"), ("o", "t1", "ab"), ("k", None, "b")]
    docs = [(i, "".join(rng.choices("aAbBéÉ x", k=rng.randrange(0, 30)))) for i in range(60)] + [(61, None), (62, ""), (63, "ab" * 30_000)]
    got = tags.tagged(spark.createDataFrame(docs, "id long, n string"), spark.createDataFrame(keywords, "kind string, tag string, keyword string"), "id", "n", 2, most)
    want = set()
    for d, text in docs:
        found = defaultdict(set)
        for kind, tag, word in keywords:
            if word and tag is not None and word in (text or "").lower():
                found[kind, tag].add(word)
        want |= {(d, *k, len(v)) for k, v in found.items() if len(v) >= 2}
    assert {tuple(r) for r in got.collect()} == want


def test_tags_without_keywords(spark):
    docs = spark.createDataFrame([(1, "text")], "id long, t string")
    assert tags.tagged(docs, spark.createDataFrame([], "kind string, tag string, keyword string"), "id", "t").collect() == []
