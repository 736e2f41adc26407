"""The corpus operators against plain definitions, with nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from quillspark.llm import html_text, line_dedup, mixing, quality, simhash, substrings, toxicity, vectors, warc
from quillspark.llm.common import components
from quillspark.llm.decontaminate import decontaminate
from quillspark.llm.labelled import held_out

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    shared = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(5)]
    boiler = ["  Licensed under the Some License, v2 ", "licensed under the some license, v2", "All rights reserved by us all.", "short"]
    docs = []
    for i in range(n):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))).capitalize() for _ in range(rng.randint(1, 6))]
        lines += rng.sample(boiler, rng.randint(0, 2))
        if rng.random() < 0.4:
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared))
        docs.append((i, rng.choice("\n\t ").join(lines) if rng.random() < 0.3 else "\n".join(lines)))
    for i in range(n, n + 60):
        text = docs[rng.randrange(n)][1]
        docs.append((i, text if rng.random() < 0.5 else text.replace(" ", "  ", 1) + " tail"))
    docs += [(9000, None), (9001, ""), (9002, " \n\t "), (9003, "x"), (9004, "word " * 30000), (9005, "\n\n"), (9006, "A\r\nB " * 20)]
    return docs, shared, vocabulary


@pytest.fixture(scope="module")
def made(spark):
    docs, shared, vocabulary = corpus()
    rows = [(d, t, "en", f"s{d % 5}" if d % 11 else None, len(t or ""), "clash") for d, t in docs]
    return docs, shared, vocabulary, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_lines(made):
    docs, _, _, df = made
    got = {r.doc_id: (r.n_lines, r.n_dropped, brute.sha(r.text)) for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute.lines(docs)


def test_lines_undone_by_deletion(spark, made):
    docs, _, _, df = made
    index = line_dedup.LineIndex(spark).insert(df.where("doc_id < 100"))
    index.insert(df.where("doc_id >= 100")).delete(df.where("doc_id % 3 = 0").select("doc_id"))
    left = line_dedup.LineIndex(spark).insert(df.where("doc_id % 3 <> 0"))
    as_set = lambda x: {(r.doc_id, tuple(sorted(map(tuple, r.drops)))) for r in x.drops().collect()}
    assert as_set(index) == as_set(left)
    assert {tuple(r) for r in index.counts().collect()} == {tuple(r) for r in left.counts().collect()}


def test_lines_with_filters_dealt_by_shard(spark, made):
    index = line_dedup.LineIndex(spark).insert(made[3])
    found = index.postings()
    few, dealt = (sorted(map(tuple, index.passed(found, broadcast_bytes=b).collect())) for b in (1 << 20, 0))
    assert few == dealt and 0 < len(few) < found.count()


def test_lines_deleted_from_nothing_and_put_back(spark, made):
    df = made[3]
    index = line_dedup.LineIndex(spark).delete(df.select("doc_id"))
    assert index.version == 0
    some, ids = df.where("doc_id < 80"), df.where("doc_id < 40").select("doc_id")
    index.insert(some).delete(ids).insert(df.where("doc_id < 40")).insert(df.where("doc_id = 7"))
    whole = line_dedup.LineIndex(spark).insert(some)
    assert {tuple(r) for r in index.counts().collect()} == {tuple(r) for r in whole.counts().collect()}
    touched = index._read("counts", 4).count()
    assert touched <= 6  # one document's lines
    index.version = 1
    assert {tuple(r) for r in index.counts().collect()} == {tuple(r) for r in whole.counts().collect()}


def test_lines_of_null_and_repeated_ids(spark):
    line = "a line that is long enough to count"
    rows = [(None, line), (None, line), (1, line), (1, f"{line}\nown"), (2, None)]
    got = [(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, 0), (None, 1, 0), (1, 1, 0), (1, 2, 0), (2, 1, 0)], key=str)  # two documents hold it
    got = [(r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame([*rows, (3, line)], "doc_id bigint, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, 1), (None, 1), (1, 1), (1, 1), (2, 0), (3, 0)], key=str)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    h = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    f = line_dedup.filled(h[0], h[1])
    assert f.contains(h[0], h[1]).all()
    f.delete(h[0][:2500], h[1][:2500])
    again = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert again.contains(h[0][2500:], h[1][2500:]).all()
    assert again.contains(h[0][:2500], h[1][:2500]).mean() < 0.05


def test_leaks(spark, made):
    docs, shared, vocabulary, df = made
    items = [(1, shared[0]), (2, shared[1].upper()), (3, " ".join(shared[2].split()[:12])), (4, vocabulary[0]), (5, None), (6, "!!"), (7, shared[0]), (10, "no such words at all here in any of the documents")]
    bench = spark.createDataFrame([*items, (None, shared[3])], "item_id bigint, text string")
    want = brute.leaks(docs, items)
    for most in (500_000, 3):
        out = decontaminate(df, bench, block_patterns=most)
        got = {r.doc_id: (r.n_words, r.n_hit, len(r.hit_items), brute.sha(",".join(sorted(map(str, r.hit_items)))), r.n_hit > 0) for r in out.collect()}
        assert got == want
    assert out.columns[:6] == df.columns


@pytest.mark.parametrize("tile", [50_000, 3])
def test_simhash(made, tile, monkeypatch):
    docs, _, _, df = made
    monkeypatch.setattr(simhash.links, "__defaults__", (3, tile))
    got = {r.doc_id: (format(r.fp % 2**64, "016x"), r.component_id) for r in simhash.cluster(df).collect()}
    assert got == brute.simhash(docs)


def test_anchors_meet():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    (ra, ka, ha), (rb, kb, _) = simhash.anchors(a), simhash.anchors(b)
    home = {(int(r), int(k)) for r, k, h in zip(ra, ka, ha, strict=True) if h}
    assert {r for r, _ in home & set(zip(rb.tolist(), kb.tolist(), strict=True))} == set(range(3000))
    assert len(ka) <= 34 * 3000


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 50)] + [(None, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    real = [p for p in pairs if None not in p and p[0] != p[1]]
    assert got == brute.smallest_reachable({x for p in real for x in p}, real)


def test_substrings(made):
    docs, _, _, df = made
    rows = substrings.dedup_substrings(df).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.text)) for r in rows} == brute.substrings(docs)
    words = {d: (t or "").split() for d, t in docs}
    for r in rows:
        for x in r.factors:
            assert x.ref_doc < r.doc_id
            assert words[r.doc_id][x.start : x.start + x.n_words] == words[x.ref_doc][x.ref_start : x.ref_start + x.n_words]


def test_substrings_of_words_that_powers_confuse(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = [(1, "one two three four five six seven eight nine ten eleven twelve " + word), (2, "one two three four five six seven eight nine ten eleven twelve " + other)]
    got = {r.doc_id: r.n_removed for r in substrings.dedup_substrings(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 0}


def test_substrings_of_null_and_repeated_ids(spark):
    same = " ".join(f"w{i}" for i in range(20))
    rows = [(None, same), (None, same), (3, same), (3, same + " tail"), (5, "head " + same), (6, None), (6, same)]
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_words", "n_removed").collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 20, 0), (0, 20, 0), (3, 20, 0), (3, 21, 0), (5, 21, 20), (6, 0, 0), (6, 20, 20)]


def test_mix(made):
    docs, _, _, df = made
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=str)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(x[0].source_size for x in by.values())
    assert sum(x[0].target for x in by.values()) == pytest.approx(1.5 * total)
    for own in by.values():
        assert own[0].target <= 2 * own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        epochs = int(own[0].target // own[0].source_size)
        assert all(r.taken >= epochs * r.size for r in own)


def test_targets_by_hand(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 100), (None, 50)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    # 240 words by 3 : 1 : 2; a stops at 20, the rest 220 by 1 : 2 gives the null source 146.7, which stops at 100
    assert got == pytest.approx({"a": 20, "b": 120, None: 100})


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [(i, [float(np.float32(x)) for x in base[i % 60] + rng.standard_normal(16) * rng.choice([0, 0.02, 0.05])], i % 60 % 3) for i in range(500)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, rows[0][1], None), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (907, [1.0] * 15 + [None], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    want = brute.vectors(rows)
    for tile in (20_000, 4):
        got = {r[0]: tuple(r)[1:] for r in vectors.dedup_vectors(df, tile=tile).collect()}
        links = sum(v[0] for v in want.values())
        assert sum(v[0] for v in got.values()) >= 0.9 * links
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_archives(spark, tmp_path):
    page = "<html>\r\n\r\n" + "é" * 600
    rows = [(1, "http://a/b c", page), (2, None, page), (3, "x", None), (4, "http://a", "small"), (5, "http://b", "small"), (6, "ä\n", page + "WARC/1.1\r\n"), (7, "u", page)]
    rows += [(i, f"http://h/{i}", f"{i}\n" * 700) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.row: r for r in warc.read_archives(spark, warc.convert(df, segment_bytes=5000)).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data)
        assert got[i].payload_digest == __import__("hashlib").sha1(data).hexdigest()
        revisit = i in (1, 2)
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 7) if revisit else ("response", None))
    assert len({r.record_id for r in got.values()}) == len(rows)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_by_declared_length(version):
    body = b"text\nhttp://no 0.0.0.0 20200101000000 text/html 3\nabc"
    data = warc.arc_file([(5, "http://x/ y", body), (None, "", b"")], version, "f.arc")
    got = list(warc.read_arc(data))
    assert [g["body"].partition(b"\r\n\r\n")[2] for g in got] == [body, b""]
    assert got[0]["URL"] == "http://x/%20y"
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_arc(data[:-3] if version == 1 else data[: len(data) - 3]))


def test_folder_of_arc_files(spark, tmp_path):
    import gzip

    http = lambda body: b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    same, latin = b"s" * 1500, "na\u00efve".encode("latin-1")
    one = warc.arc_start(1, "one.arc", "20010203040506")
    one += b"http://x/a b?c d 1.2.3.4 20010203040506 text/html; charset=x %d\n" % len(http(same)) + http(same) + b"\n"
    one += b"dns:x 1.2.3.4 20010203040507 text/dns 5\nabc\n1\n"
    two = warc.arc_start(2, "two.arc") + warc.arc_record(2, "http://y/", http(same), 0, "two.arc", "20020101000000") + warc.arc_record(2, "http://z/", http(latin), 0, "two.arc")
    (tmp_path / "one.arc").write_bytes(one)
    (tmp_path / "two.arc.gz").write_bytes(gzip.compress(two[:200]) + gzip.compress(two[200:]))
    (tmp_path / "cut.arc").write_bytes(one[:-3])
    (tmp_path / "junk.arc").write_bytes(b"no archive at all")
    folder, faults = warc.convert_arc(spark, str(tmp_path))
    assert {(r.file.rsplit("/", 1)[1], r.error) for r in faults.collect()} == {("cut.arc", "the file ends inside a record"), ("junk.arc", "no header line of the file's version")}
    records = []
    for part in spark.read.format("binaryFile").load(folder).collect():
        for member in warc.members(bytes(part.content)):
            records += warc.read_warc(member)
    kinds = sorted((h["WARC-Type"], h.get("WARC-Target-URI")) for h, _, _ in records)
    url = "http://x/a b?c d"
    assert kinds == sorted([("warcinfo", None)] * 3 + [("response", url), ("revisit", url), ("revisit", "http://y/"), ("response", "http://z/"), ("resource", "dns:x")])
    first = next(h for h, _, _ in records if h["WARC-Type"] == "response" and h["WARC-Target-URI"] == url)
    for h, _, payload in records:
        if h["WARC-Type"] == "revisit":
            assert payload == b"" and h["WARC-Refers-To"] == first["WARC-Record-ID"] and h["WARC-Refers-To-Target-URI"] == url and h["WARC-Refers-To-Date"] == "2001-02-03T04:05:06Z"
        if h.get("WARC-Target-URI") == "http://z/":
            assert payload == latin
    got = warc.read_archives(spark, folder).collect()
    assert sorted((r.url, r.record_type, r.payload_bytes) for r in got) == sorted([(url, "response", 1500), (url, "revisit", 1500), ("http://y/", "revisit", 1500), ("http://z/", "response", 5)])


def test_archives_of_null_and_repeated_ids(spark):
    page, other = "p" * 1200, "q" * 1200
    rows = [(None, "http://a", page, 1), (4, "http://a", page, 1), (4, "http://b", page, 2), (2, "http://c", page, 3), (None, None, other, 4), (None, None, other, 5), (1, None, None, 6)]
    got = warc.read_archives(spark, warc.convert(spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type int"))).collect()
    assert sorted(((r.row, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str) == sorted(
        [(None, "response", None, 1200)] * 3 + [(4, "response", None, 1200)] * 2 + [(2, "revisit", 4, 1200), (1, "response", None, 0)], key=str
    )


PAGES = {
    "<html><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class='ad'>Buy this now, it is very good and cheap.</div><article><h1>T &amp; U</h1><p><b>One <i>two</i>\n three.<br><p>Four</article><footer>&copy; c</footer>": "T & U\nOne two three.\nFour",
    "<div id=top><a href=a>Home</a><a href=b>News</a></div><div class=content><p>First para with enough words, to be sure.</p><p>Second para, also long enough to be text.</p></div><div class='comments'><p>I think this is great and so long a comment.</p></div>": "First para with enough words, to be sure.\nSecond para, also long enough to be text.",
    "": "",
    "<script>var x = '<p>no</p>'</script><style>p{}</style>": "",
    "plain words only": "plain words only",
    "<body>" + "<div>" * 5000 + "deep text here": "deep text here",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_html(page):
    assert html_text.main_text(page) == PAGES[page]


def paragraphs(n, name):
    return [f"{name} {i} " + "words of a long enough paragraph " * 9 + "end" for i in range(n)]


@pytest.mark.parametrize("outer", ["article", "div"])
@pytest.mark.parametrize("inner", ["div", "section"])
def test_html_of_two_sections(outer, inner):
    a, b = paragraphs(5, "first"), paragraphs(4, "second")
    one, two = ("".join(f"<p>{x}</p>" for x in part) for part in (a, b))
    menu = "<div>" + "".join(f"<a href={i}>Go {i}</a>" for i in range(9)) + "</div>"
    page = f"<body><div>{menu}<{outer}><h1>Title</h1><{inner}>{one}</{inner}><h2>More</h2><{inner}>{two}</{inner}></{outer}></div>"
    assert html_text.main_text(page).split("\n") == ["Title", *a, "More", *b]


@pytest.mark.parametrize("outer", ["article", "div"])
@pytest.mark.parametrize("n, item", [(60, "<li>{}</li>"), (60, "<tr><td>{}</td></tr>")])
def test_html_of_a_long_list_or_table(outer, n, item):
    a, items = paragraphs(5, "text"), [f"item {i} of it" for i in range(n)]
    held = "".join(item.format(x) for x in items)
    held = f"<ul>{held}</ul>" if "li" in item else f"<table>{held}</table>"
    page = f"<body><{outer}><div>{''.join(f'<p>{x}</p>' for x in a)}</div>{held}</{outer}>"
    assert html_text.main_text(page).split("\n") == a + items


TWO = ["This is the first plain paragraph of an article, long enough to be text of it.", "And the second paragraph, which says some more things about the matter."]
STARTS = [
    '<div style="overflow:hidden">', '<div data-hidden="false">', '<div title="role=form">', '<div data-id="share">', '<div class="post-content no-sidebar">', '<div class="layout with-sidebar">',
    '<div class="side-by-side">', '<div id="social-science">', "<form>", '<article><section id="related-work">', '<div class="sidebar">', "<div class='a\"b'>",
]


@pytest.mark.parametrize("start", STARTS)
def test_html_of_ordinary_names(start):
    body = "".join(f"<p>{x}</p>" for x in TWO)
    page = f"<html><body><nav><a href=x>Home</a></nav>{start}{body}{'</section></article>' if 'section' in start else '</' + start[1:5].strip('> ') + '>'}<footer>c</footer></body></html>"
    assert html_text.main_text(page).split("\n") == TWO


@pytest.mark.parametrize("part", ["<div class='comment-list'>{}</div>", "<div id=cookieConsent>{}</div>", "<div class='adSlot ad'>{}</div>", "<aside>{}</aside>", "<div role=dialog>{}</div>", "<div hidden>{}</div>", "<div class='site-footer x'>{}</div>"])
def test_html_without_other_parts(part):
    other = part.format("<p>Some words of another kind that are not the article.</p>")
    page = "<body><article>" + "".join(f"<p>{x}</p>" for x in TWO) + f"{other}</article>{other}</body>"
    assert html_text.main_text(page).split("\n") == TWO


def unnamed(seed):
    """A page without names or article: link lists and short bits around paragraphs."""
    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    text = [words(rng.randint(40, 90)) for _ in range(rng.randint(3, 9))]
    links = lambda n: "<div>" + "".join(f"<ul><li><a href=/{i}>{words(2)}</a></li></ul>" for i in range(n)) + "</div>"
    bits = lambda n: "<div>" + "".join(f"<div><span>{words(1)}</span></div>" for _ in range(n)) + "</div>"
    inner = "<div>" + "".join(f"<p>{x}</p>" for x in text) + "</div>"
    return f"<body><div>{links(rng.randint(5, 12))}<div>{inner}</div>{bits(rng.randint(3, 6))}{links(rng.randint(4, 15))}</div></body>", text


def test_html_by_density_alone(monkeypatch):
    pages = [unnamed(i) for i in range(40)]
    assert [html_text.main_text(p).split("\n") for p, _ in pages] == [t for _, t in pages]
    monkeypatch.setattr(html_text, "chosen", lambda nodes: {nodes[0]})  # all that no name drops
    assert all(html_text.main_text(p).split("\n") != t for p, t in pages)


def test_html_densities_by_definition():
    """Counts of a small tree by hand, and densities and sums by the formula."""
    import math

    body, pieces = html_text.parse("<body><div><p>abcde fghij</p><p>xy <a href=q>link</a></p></div><ul><li><a href=r>menu</a></li></ul></body>")
    nodes = html_text.measured(body, pieces)
    got = {(x.tag, x.order): (x.chars, x.tags, x.link_chars, x.links) for x in nodes}
    assert got == {("body", 0): (21, 7, 8, 2), ("div", 1): (17, 3, 4, 1), ("p", 2): (11, 0, 0, 0), ("p", 3): (6, 1, 4, 1), ("ul", 4): (4, 2, 4, 1), ("li", 5): (4, 1, 4, 1)}
    for x in nodes:
        c, t, lc, lt = x.chars, max(1, x.tags), max(1, x.link_chars), max(1, x.links)
        base = math.log(c * lc / max(1, c - lc) + 8 * c / 21 + math.e)
        assert x.density == pytest.approx(max(0.0, c / t * math.log(max(1.0, c * t / (lc * lt)) + 1) / math.log(base + 1)))
        assert x.total == pytest.approx(sum(k.density for k in x.children) or x.density / 2)


def test_html_in_linear_time():
    import time

    began = time.process_time()
    for page in ("<div>" * 16000 + "deep" + "</div>" * 16000, "<ul><li>" * 16000 + "deep", "<foo>" * 16000 + "<p>a<div>b" * 2000):
        assert html_text.main_text(page)
    assert time.process_time() - began < 8


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a b</article>", "old"), (2, None, None, None)], "page_id bigint, url string, html string, text string")
    assert sorted(map(tuple, html_text.extract(df).collect())) == [(1, "u", "a b"), (2, None, "")]


def classes(n=300, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 120))
        bad, toxic = rng.random() < 0.3, rng.random() < 0.4
        if toxic:
            for _ in range(1 + len(text) // 15):
                text[rng.randrange(len(text))] = rng.choice(["zzugh", "zzork", "zzit"])
        rows.append((i, (" ".join(w.upper() + "!!" for w in text) if bad else " ".join(text)), "en", "s", 1, "x"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(9000, None, None, None, None, None), (9001, "", "en", "s", 0, "x"), (9002, "a " * 50000, "en", "s", 0, "x")]
    return rows, labels


@pytest.mark.parametrize(("scored", "label", "mod", "rest"), [(quality.classify, "quality", 4, 2), (toxicity.score, "toxic", 3, 1)])
def test_classifiers(spark, scored, label, mod, rest):
    rows, labels = classes()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = scored(docs, marks, carry=["doc_id"]).withColumn("held", held_out(F.col("doc_id"), mod, rest)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    true = {d: (q if label == "quality" else t) for d, q, t in labels}
    held = [r for r in got if r.held and r.doc_id in true]
    assert sum(r.predicted == true[r.doc_id] for r in held) >= 0.9 * len(held)
    again = {r.doc_id: r.score for r in scored(docs.repartition(5), marks, carry=["doc_id"]).collect()}
    assert {r.doc_id: (r.score, again[r.doc_id]) for r in got if abs(again[r.doc_id] - r.score) > 1e-3} == {}


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, ids = rng.standard_normal((6, toxicity.WORD_DIMS + toxicity.CHAR_DIMS)), rng.integers(0, 6, (3, 5))
    mask, y = np.arange(5) < np.array([[5], [3], [1]]), np.array([1.0, 0, 1])

    def loss():
        s = net.forward(words, ids, mask)
        return np.log1p(np.exp(s)).sum() - (y * s).sum()

    keep: dict = {}
    s = net.forward(words, ids, mask, keep)
    g, dwords = net.backward(words, ids, keep, toxicity.sigmoid(s) - y)
    for name, arr, grad in [*((k, net.p[k], g[k]) for k in g), ("words", words, dwords)]:
        at = tuple(rng.integers(0, n) for n in arr.shape)
        old, eps = arr[at], 1e-5
        arr[at] = old + eps
        up = loss()
        arr[at] = old - eps
        down = loss()
        arr[at] = old
        assert abs((up - down) / (2 * eps) - grad[at]) < 2e-3 * max(1, abs(grad[at])), name


def test_empty_tables(spark, made):
    df = made[3].limit(0)
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    vecs = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    for out in (line_dedup.dedup_lines(df), decontaminate(df, bench), simhash.cluster(df), substrings.dedup_substrings(df), mixing.mix(df), quality.classify(df, labels), toxicity.score(df, labels), html_text.extract(pages), vectors.dedup_vectors(vecs), warc.read_archives(spark, warc.convert(pages))):
        assert out.count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for _, stage in p.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], folder).cache())
        assert kept[-1].columns == docs.columns
    text = [{r.doc_id: r.text for r in k.collect()} for k in kept]
    assert {d for d in text[2]} == {d for d in text[1]}
    want = brute.lines(list(text[1].items()))
    assert {d: brute.sha(t) for d, t in text[2].items()} == {d: w[2] for d, w in want.items()}
    roots = brute.simhash(list(text[2].items()))
    assert set(text[3]) == {d for d, (_, root) in roots.items() if d == root}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert set(text[4]) == {d for d, x in brute.leaks(list(text[3].items()), items).items() if not x[4]}
    assert {r.doc_id for r in p.run(spark, folder).collect()} == set(text[4])
