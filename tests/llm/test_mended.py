"""What earlier forms of the corpus operators lost or stumbled over."""

import gzip
import random
import time
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import decontaminate, html_text, language, line_dedup, mixing, quality, simhash, toxicity, warc

P = [f"Paragraph {i} " + "of some words that make a sentence long enough " * 4 + "end." for i in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in P)
WHOLE = "\n".join(P)
LOST = {
    "self-closed svg": f"<article><h1>T</h1><svg class='i'/>{BODY}</article>",
    "svg without an end": f"<article><h1>T</h1><svg class='i'>{BODY}</article>",
    "svg with one": f"<article><h1>T</h1><svg><title>icon</title><path d='M0'/></svg>{BODY}</article>",
    "second body": f"<body><article><h1>T</h1>{BODY[: len(BODY) // 2]}<body>{BODY[len(BODY) // 2 :]}</article></body>",
    "text before body": f"<html><head></head><div><h1>T</h1>{BODY}</div><body></body>",
    "body in the middle": f"<html><article><h1>T</h1>{BODY}<body></article>",
}


@pytest.mark.parametrize("named", [True, False])
@pytest.mark.parametrize("case", LOST)
def test_articles_are_not_lost(case, named):
    page = LOST[case] if named else LOST[case].replace("<article>", "<div class='x1'>").replace("</article>", "</div>")
    assert html_text.main_text(page).split("\n")[-6:] == P or html_text.main_text(page).replace("\n", "") == ("T" + WHOLE).replace("\n", "")


def test_formulas_are_text():
    page = f"<article>{BODY}<p>Let <math><semantics><mrow><mi>x</mi><mo>+</mo><mn>1</mn></mrow><annotation encoding='tex'>x+1</annotation></semantics></math> be a number.</p><p>And <math/> none.</p></article>"
    assert html_text.main_text(page) == f"{WHOLE}\nLet x+1 be a number.\nAnd none."


def test_links_go_through_blocks():
    cards = "".join(f"<a href='{i}'><div>Card {i} with a teaser of a few words to read on and on</div></a>" for i in range(9))
    _, pieces = html_text.parse(f"<div>{BODY}</div><div>{cards}</div>")
    assert all(link for _, text, link in pieces if text.startswith("Card")) and not any(link for _, text, link in pieces if text.startswith("Para"))
    _, pieces = html_text.parse("<div><a href=x>open link<p>text after it</p><p>more</p><a href=y>next</a></div>")
    assert [link for _, text, link in pieces if text.strip()] == [1, 0, 0, 1]
    assert html_text.main_text(f"<div class='a1'>{BODY}</div><div class='b2'>{cards}</div>") == WHOLE


def test_pages_without_telling_names():
    rng = random.Random(3)
    for _ in range(20):
        own = [" ".join(rng.choices("words of a text that goes on for quite some while here".split(), k=rng.randrange(25, 60))) + "." for _ in range(rng.randrange(5, 9))]
        bar = "".join(f"<li><a href='{i}'>Item {i}</a></li>" for i in range(rng.randrange(4, 12)))
        page = f"<body><div class='q1'><ul>{bar}</ul></div><div class='q2'><div class='q3'>{''.join(f'<p>{x}</p>' for x in own)}</div></div><div class='q4'><ul>{bar}</ul></div></body>"
        assert html_text.main_text(page) == "\n".join(own)


def archive(n, version=1):
    return gzip.compress(warc.arc_start(version, "m.arc")) + b"".join(gzip.compress(warc.arc_record(version, f"http://h/{i}", b"x" * (i % 700), 0, "m.arc"), 1) for i in range(n))


def test_members_take_time_in_proportion():
    def seconds(data):
        began = time.process_time()
        found = sum(1 for x in warc.sound_records(data) if not x["error"])
        return time.process_time() - began, found

    seconds(archive(500))
    one, eight = seconds(archive(2000)), seconds(archive(16000))
    assert (one[1], eight[1]) == (2001, 16001) and eight[0] < 20 * one[0] + 0.5


@pytest.mark.parametrize("size", [1, 7, 5000])
def test_records_from_pieces_of_any_size(size):
    data = b"".join(warc.members(archive(40)))
    whole = list(warc.arc_records(data))
    assert list(warc.arc_records(data[a : a + size] for a in range(0, len(data), size))) == whole and len(whole) == 41
    assert b"".join(warc.members(gzip.compress(data) + b"\0\0" + gzip.compress(b"tail"))) == data + b"tail"


def test_records_before_a_broken_member_stay():
    good = archive(5)
    for bad in (good + gzip.compress(b"http://x 1.2.3.4 20000101000000 text/html 5\nabcde\n")[:-9], good + b"\x1f\x8bjunk that is no member"):
        got = list(warc.sound_records(bad))
        assert [bool(x["error"]) for x in got] == [False] * 6 + [True] and bad.endswith(got[-1]["body"]) and got[-1]["body"]


def test_half_shared_by_thousands_is_cut_in_tiles(spark):
    rng = np.random.default_rng(6)
    low = rng.choice(1 << 31, 900, replace=False).astype(np.uint64)
    fps = np.concatenate([(np.uint64(0xABCDEF12) << np.uint64(32)) | low, (np.uint64(0xABCDEF12) << np.uint64(32)) | (low[:60] ^ np.uint64(5)), rng.integers(0, 1 << 63, 50).astype(np.uint64)])
    rows = [(int(f), i) for i, f in enumerate(fps.view(np.int64))]
    groups = spark.createDataFrame(rows, "fp long, rep long")
    want = {(i, 900 + i) for i in range(60)}
    for tile in (4096, 100):
        got = {tuple(sorted((r.a, r.b))) for r in simhash.links(groups, tile=tile).collect()}
        assert want <= got and all(bin(int(fps[a] ^ fps[b])).count("1") <= 3 for a, b in got)


NAMES = "drops doc stay own n items spans row __row __text __doc __stay y most known_id hit_items_ at place team text_ digest lines h1 h2 slot kind key bucket fp rep home part _".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"{'Good words here' if i % 2 else 'b@d %% ##'} number {i}\nshared line of all these documents\nend", "en", "s", *[i] * len(NAMES)) for i in range(24)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", "source string", *[f"`{n}` int" for n in NAMES]]))


def carries(got, clashing):
    rows = {r.doc_id: r for r in got.collect()}
    assert set(clashing.columns) <= set(got.columns) and len(rows) == 24
    assert all(rows[i][n] == i for i in rows for n in NAMES)


def test_columns_of_any_name_are_carried(spark, clashing):
    labels = spark.createDataFrame([(i, i % 2, i % 2, 7, 7) for i in range(24)], "doc_id long, quality int, toxic int, y int, known_id int")
    bench = spark.createDataFrame([(1, "shared line of all these documents"), (2, "no such words at all")], "item_id long, text string")
    carries(line_dedup.dedup_lines(clashing), clashing)
    carries(decontaminate.decontaminate(clashing, bench), clashing)
    carries(decontaminate.decontaminate(clashing, bench, block_patterns=1), clashing)
    carries(quality.classify(clashing, labels), clashing)
    carries(toxicity.score(clashing, labels), clashing)
    carries(language.identify(clashing), clashing)
    assert Counter(r.doc_id for r in mixing.mix(clashing).collect()) == Counter(range(24))
    pages = clashing.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert all(got[i][n] == i for i in got for n in NAMES)


def same_shape(words, rng):
    return " ".join(rng.choices(words, k=40)) + "."


def test_quality_by_vocabulary_alone(spark):
    rng = random.Random(5)
    good, bad = "stone river garden window".split(), "crane mover pardon winter".split()  # of the same lengths
    texts = [(i, same_shape(good if i % 2 else bad, rng)) for i in range(240)]
    got = quality.classify(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got if r.doc_id >= 120) >= 115


def test_quality_by_plain_votes():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["aa", "Bb9", "c!", "dd dd"], 30)).encode() for _ in range(60)]
    x, y = quality.counts(texts), rng.integers(0, 2, 60)
    model = quality.Model(x, y)
    vectors = (x * model.idf) @ model.project
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    for i, got in enumerate(model.score(x, 9)):
        near = vectors @ vectors[i]
        top = sorted(range(60), key=lambda j: -near[j])[:9]
        vote = {c: sum(max(1e-6, near[j]) ** quality.SHARPNESS for j in top if y[j] == c) / (y == c).sum() for c in (0, 1)}
        assert abs(got - vote[1] / (vote[0] + vote[1])) < 1e-4


def test_mix_by_a_plain_loop(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)) + rng.choice(["", " #$%", "!"]), rng.choice("abc")) for i in range(150)]
    labels = spark.createDataFrame([(i, int("#" not in t)) for i, t, _ in rows[:90]], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weigh = mixing.fitted(docs, labels)
    F = mixing.F  # noqa: N806
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col("doc_id"), F.xxhash64("text")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), u.alias("u"), weigh(F.col("text"), mixing.n_words(F.col("text"))).alias("weight")).collect()
    good = [r.weight for r, (_, t, _) in zip(sorted(keyed), rows, strict=True) if "#" not in t and t.strip()]
    bad = [r.weight for r, (_, t, _) in zip(sorted(keyed), rows, strict=True) if "#" in t]
    assert np.mean(good) > np.mean(bad) + 0.3 and min(bad) >= mixing.LEAST_WEIGHT
    got = {r.doc_id: r for r in mixing.mix(docs, weigh=weigh).collect()}
    for source in "abc":
        mine = sorted((-np.log(r.u) / r.weight, r.doc_id, r["size"]) for r in keyed if r.source == source)
        whole, target = sum(m[2] for m in mine), got[mine[0][1]].target
        epochs = int(target // whole)
        room = int(target - epochs * whole + 0.5)
        for _, i, size in mine:
            take = min(room, size)
            room -= take
            assert got[i].taken == epochs * size + take and got[i].source_size == whole
