"""Prefix trie, source divergence and language: against plain definitions, on rows that the given tables lack."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import divergence, language, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, id long, depth string, part int, at long, place long, prev long, next string, k1 long, size string"


def conversations(spark, rows, kind=TURNS):
    """Rows of (conv_id, turn, role, text) with columns whose names the operator uses itself."""
    extra = (5, "x", 1, 2, 3, 4, "y", 6, "z")
    return spark.createDataFrame([(*r, *extra) for r in rows], kind)


def plain_order(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}


def plain_forks(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - int(abs(c) % 5) * (1 if c >= 0 else -1), [])
        out[c] = base[:h] + turns[h:]
    return out


def plain_trie(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    below = defaultdict(lambda: [0, 0])
    kids = Counter(node[:-1] for node in members if node)
    for node, m in members.items():
        saved = (len(m) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            below[node[:d]][0] += kids[node] == 0
            below[node[:d]][1] += saved
    rows = []
    for node, m in members.items():
        joined = ",".join(map(str, sorted(ends[node])))
        rows.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids[node], *below[node], hashlib.sha256(joined.encode()).hexdigest()))
    return Counter(rows)


def some_turns(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(-6, n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c if rng.random() > 0.02 else None, rng.choice([t, t, t, None, 3]), rng.choice(["user", "user", "tool", None, ""]), rng.choice(["aé", "b", "", None, "long text"])))
    return rows + rows[:7]


@pytest.mark.parametrize("rest, block", [(60, 5), (1 << 14, 4096)])
def test_trie_of_forks_by_plain_loops(spark, monkeypatch, rest, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = some_turns(3, 30)
    got = prefix_trie.trie(prefix_trie.forked(conversations(spark, rows)), rest)
    assert Counter(map(tuple, got.collect())) == plain_trie(plain_forks(plain_order(rows)))


@pytest.mark.parametrize("rest", [200])
def test_trie_of_a_long_chain_copies_and_a_wide_root(spark, monkeypatch, rest):
    monkeypatch.setattr(prefix_trie, "BLOCK", 9)
    monkeypatch.setattr(prefix_trie, "IDS_A_ROW", 4)
    chain = [(1, t, "user", "ab"[t % 2] * (t % 5)) for t in range(260)]
    copies = [(c, t, "user", "same") for c in range(10, 45) for t in range(2)]
    wide = [(c, 0, "user", f"first {c}") for c in range(100, 200)]
    rows = chain + [(2, *r[1:]) for r in chain[:200]] + copies + wide
    assert Counter(map(tuple, prefix_trie.trie(prefix_trie.paths(conversations(spark, rows)), rest).collect())) == plain_trie(plain_order(rows))


def test_trie_of_nothing_and_of_nulls(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert prefix_trie.trie(prefix_trie.forked(conversations(spark, rows))).collect() == []
    got = prefix_trie.trie(prefix_trie.paths(conversations(spark, [(7, None, None, None)]))).collect()
    assert Counter(map(tuple, got)) == plain_trie({7: [("", "")]})


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "only") for c in range(1, 5)] + [(c, t, "user", f"{c} {t}") for c in (11, 13) for t in range(12)]  # conversations 0 and 10 are absent
    got = prefix_trie.trie(prefix_trie.forked(conversations(spark, rows)))
    want = plain_trie(plain_forks(plain_order(rows)))
    assert Counter(map(tuple, got.collect())) == want
    root = next(r for r in want if r[1] == 0)
    assert root[3] == 6 and root[-1] == hashlib.sha256(b"1,2,3,4").hexdigest()


@pytest.mark.parametrize("n, rest", [(1, 10), (2, 1), (300, 20)])
def test_ranks_of_a_list(spark, n, rest):
    ids = list(range(100, 100 + n))
    random.Random(n).shuffle(ids)
    rows = [(x, ids[i - 1] if i else -1, ids[i + 1] if i + 1 < n else -1) for i, x in enumerate(ids)]
    got = {r["id"]: r["place"] for r in prefix_trie.ranked(spark.createDataFrame(rows, "id long, prev long, next long"), rest).collect()}
    assert got == {x: i for i, x in enumerate(ids)}


DOCS = "doc_id long, text string, lang string, source string, n long, kind int, term string, slots string"


def plain_divergence(docs, least=3, top=200):
    seen, used, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        seen[lang].update(set(terms))
        used[lang, source].update(terms)
    rows = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update({t: used[g][t] for t in kept})

        def shares(n):
            every = sum(n[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (n[t] + 1) // every for t in kept}

        q, p = shares(whole), {s: shares(used[lang, s]) for x, s in groups if x == lang}
        for s in p:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in p if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if used[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                rows += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return Counter(rows)


def some_documents(seed):
    rng = random.Random(seed)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "éßxyzÄ"] + ["The", "THE", "x9y", "don't", "漢字"]
    docs = [(" ".join(rng.choices(words, range(1, len(words) + 1), k=rng.randrange(0, 60))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", None, "Zé"])) for _ in range(120)]
    return docs + docs[:9] + [(None, "en", "none"), ("", "xx", "only"), ("rare words", "yy", "p"), ("other words", "yy", "q"), ("lone " * 3000, "en", "a"), ("!?" * 50, "de", "signs")]


@pytest.mark.parametrize("given", [{}, {"keys": 3, "held": 1}, {"keys": 3, "broadcast": -1}, {"broadcast": -1}, {"top": 2, "least": 1}])
def test_divergence_by_plain_loops(spark, given):
    docs = some_documents(8)
    table = spark.createDataFrame([(i % 50, *d, 1, 2, "t", "s") for i, d in enumerate(docs)], DOCS).repartition(5)
    got = divergence.divergence(table, **given).select("lang", "source", "part", "item", "value", "rank").collect()
    assert Counter(map(tuple, got)) == plain_divergence(docs, given.get("least", 3), given.get("top", 200))


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("levels", [40, 1, 0])
def test_perfect_hash_is_minimal_and_knows_its_own(monkeypatch, levels):
    monkeypatch.setattr(divergence, "LEVELS", levels)
    terms = pa.array([f"t{i}é".encode() for i in range(3000)], pa.large_binary())
    shard = divergence.shard_of(divergence.hashes(terms)[0], 4)
    shards = []
    for s in range(4):
        own = terms.take(pa.array(np.flatnonzero(shard == s)))
        order, levels_blob = divergence.built(own)
        shards.append((len(own), b" ".join(own.take(pa.array(order)).to_pylist()), levels_blob))
    known = divergence.Shards(shards)
    slots = known.slots(terms)
    assert sorted(slots.tolist()) == list(range(3000))
    assert [known.keys[int(i)].as_py() for i in slots] == terms.to_pylist()
    assert (known.slots(pa.array([f"u{i}".encode() for i in range(3000)], pa.large_binary())) == -1).all()


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(300):
        whole = rng.randrange(1, 9 * 10**15)
        n = rng.randrange(0, whole)
        assert divergence.share(np.array([n]), whole)[0] == 1 + 10**9 * (n + 1) // whole


WORDS = {"en": "the and with that which from house water", "fr": "le des avec où être maison l'eau très", "de": "der und mit daß über straße wasser nicht", "": "zzyx qqxz xyzzy zxq"}


def spoken(n, seed=1, size=(1, 90)):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randrange(*size))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


@pytest.fixture(scope="module")
def net():
    docs = spoken(600)
    langs = sorted(WORDS)
    return language.train(langs, [t.encode()[:256] for _, t, _ in docs], np.array([langs.index(x) for *_, x in docs]), 250)


def test_language_gradients(net):
    rng = np.random.default_rng(2)
    windows, y = rng.integers(97, 123, (6, language.LENGTH)).astype(np.uint8), rng.integers(0, 4, 6)
    model = language.Net(sorted(WORDS))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    model.mask = model.mask.astype(np.float64)
    _, g = model.gradients(windows, y)
    for name, p in model.p.items():
        at = np.unravel_index(np.argsort(-np.abs(g[name]).ravel())[:5], p.shape)
        for i in zip(*at, strict=True):
            held, loss = p[i], []
            for step in (1e-5, -1e-5):
                p[i] = held + step
                loss.append(model.gradients(windows, y)[0])
            p[i] = held
            assert abs((loss[0] - loss[1]) / 2e-5 - g[name][i]) < 1e-5 + 1e-3 * abs(g[name][i])


def test_windows_hold_every_byte_and_every_run():
    texts = [bytes(random.Random(n).choices(range(1, 256), k=n)) for n in (1, 4, 5, 255, 256, 257, 508, 509, 1000, 7000)]
    windows, first, held = language.windows_of(texts)
    for i, t in enumerate(texts):
        mine = windows[first[i] : first[i + 1] if i + 1 < len(first) else None]
        runs = {t[a : a + language.WIDEST] for a in range(max(1, len(t) - language.WIDEST + 1))}
        padded = {bytes(w[a : a + len(r)]) for w in mine for r in runs for a in range(len(w) - len(r) + 1)} if len(t) < 600 else None
        assert padded is None or runs <= padded
        assert held[first[i]] == min(len(t), language.LENGTH) and mine.shape[1] == language.LENGTH
        assert b"".join(bytes(w[: language.STRIDE]) for w in mine)[: len(t)] == t or len(t) - (len(mine) - 1) * language.STRIDE <= language.LENGTH


def test_language_of_a_text_is_that_of_all_its_windows(net):
    text = ("der und mit daß " * 200 + "the and with that " * 40).encode()
    windows, first, held = language.windows_of([text])
    plain = np.zeros(4)
    for a in range(0, max(1, len(text) - language.WIDEST + 1), language.STRIDE):
        piece = text[a : a + language.LENGTH]
        window = np.frombuffer(piece.ljust(language.LENGTH, b"\0"), np.uint8)
        e = net.p["bytes"][window]
        pooled = [max(float((e[i : i + language.WIDEST].ravel() * net.p["filters"][:, f]).sum()) for i in range(language.LENGTH - language.WIDEST + 1)) for f in range(net.p["filters"].shape[1])]
        z = np.maximum(np.array(pooled) + net.p["bias"], 0) @ net.p["out"] + net.p["base"]
        plain += len(piece) * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    got = np.add.reduceat(net.probabilities(windows) * held[:, None], first)[0]
    assert np.allclose(got / held.sum(), plain / plain.sum(), atol=1e-4) and net.langs[int(got.argmax())] == "de"


def test_languages_of_held_out_rows_and_odd_texts(spark):
    rows = [(i, t, lang, "c", 1.0) for i, t, lang in spoken(500, 4)]
    odd = [(9001, None, "en", "c", 1.0), (9002, "", "en", "c", 1.0), (9003, "12 34 !?", "fr", "c", 1.0), (None, "the and with", None, "c", 1.0), (9001, "le des où être très avec", None, "c", 1.0), (9004, "der und mit " * 20_000, "de", "c", 1.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, own string, score double").repartition(3)
    got = language.identify(docs).collect()
    assert len(got) == len(rows) + len(odd) and set(got[0].asDict()) == {"doc_id", "text", "lang", "own", "lang_pred", "score"}
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.doc_id < 9000]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id, r.text): r for r in got}
    assert all(by[k, t].lang_pred == "und" and by[k, t].score == 0 for k, t in ((9001, None), (9002, ""), (9003, "12 34 !?")))
    assert by[None, "the and with"].lang_pred == "en" and by[9001, odd[4][1]].lang_pred == "fr" and by[9004, odd[5][1]].lang_pred == "de"
    again = language.identify(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in again) == Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in got)


def test_languages_with_nothing_to_learn_from(spark):
    kind = "doc_id long, text string, lang string"
    assert language.identify(spark.createDataFrame([], kind)).collect() == []
    got = language.identify(spark.createDataFrame([(1, "some text", None), (2, None, None)], kind)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2


def test_language_never_reads_labels_of_held_out_rows(spark):
    held = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "the and with that house", "wrong") for i in held[:50]] + [(9000 + i, t, lang) for i, t, lang in spoken(60) if zlib.crc32(str(9000 + i).encode()) % 4 != 2], "doc_id long, text string, lang string")
    assert "wrong" not in {r["lang_pred"] for r in language.identify(docs).collect()}
