"""Cases that the given tables lack, on small rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.operators.network import nearest
from quillspark.operators.sentences import claims, notebook_blocks, read_markdown, read_mbox, write_mbox
from quillspark.operators.similarity import bit_links, simhash_links, title_links
from quillspark.sources.files import read_bibtex

POINTS = "label string, id long, x double, y double, z double"


def test_nearest_with_copies_clusters_and_far_points(spark):
    rng = random.Random(4)
    rows = [("a", i, *(rng.gauss(0, 0.01 if i % 3 else 1) for _ in range(3))) for i in range(200)]
    rows += [("a", 300 + i, 0.5, 0.5, 0.5) for i in range(40)] + [("b", 400, 0.0, 0.0, 0.0), ("c", 401, 1.0, 0.0, 0.0), ("c", 402, -40.0, 0.0, 0.0)]
    got = {r["id"]: (r["other"], r["distance"]) for r in nearest(spark.createDataFrame(rows, POINTS)).collect()}
    want = {}
    for label, i, *p in rows:
        near = sorted((math.dist(p, q), j) for other, j, *q in rows if other == label and j != i)
        if near:
            want[i] = near[0][1], near[0][0]
    assert got.keys() == want.keys()
    for i, (other, distance) in want.items():
        assert got[i][0] == other and abs(got[i][1] - distance) < 1e-12


def test_nearest_of_nothing(spark):
    assert nearest(spark.createDataFrame([], POINTS)).collect() == []


def chunks_of(spark, text, **given):
    p = spark.createDataFrame([(text,)], "text string").select(C.paragraphs(F.col("text"), r"\n\s*\n").alias("p"))
    return p.select(C.chunks_by_topic(F.col("p"), 300, 50, **given)).first()[0]


def test_chunks_of_short_empty_and_long_paragraphs(spark):
    assert chunks_of(spark, None) == [] and chunks_of(spark, " \n\n \n") == []
    assert chunks_of(spark, "one\n\n two ") == ["one\n\ntwo"]
    long = "word " * 140
    assert chunks_of(spark, long) == [long.strip()]
    assert [len(c) for c in chunks_of(spark, long, split_first=True)] == [300, 300, 199]
    mixed = chunks_of(spark, "\n\n".join(["first things here " * 8, long, "tail of it"]))
    assert [len(c) for c in mixed] == [143, 300, 300, 211]


def test_bibtex_with_braces_quotes_and_junk(spark, tmp_path):
    (tmp_path / "a.bib").write_text('@Article{k1,\n  title = {A {B} c},\n  Year = 1999,\n  note = "q, r"\n}\n@comment no entry\n@book{k2,\n author={X and Y}}\n')
    got = {r["key"]: (r["kind"], r["fields"]) for r in read_bibtex(spark, str(tmp_path)).collect()}
    assert got == {"k1": ("article", {"title": "A {B} c", "year": "1999", "note": "q, r"}), "k2": ("book", {"author": "X and Y"})}


@pytest.mark.parametrize("bucket", [1000, 3])
@pytest.mark.parametrize("distance", [0, 3, 5])
def test_bit_links_by_all_pairs(spark, bucket, distance):
    rng = random.Random(distance)
    found = {0, (1 << 64) - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        found |= {base ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(7))) for _ in range(12)}
        found |= {base ^ sum(1 << i for i in rng.sample(range(32), 5)) for _ in range(3)}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(found)]
    ids = {x: i for i, x in enumerate(signed)}
    want = {}
    for a in signed:
        near = [ids[b] for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance]
        if near:
            want[a] = (len(near), min(near))
    got = bit_links(spark.createDataFrame([(x, i) for x, i in ids.items()], "f long, id long"), distance, bucket)
    assert {r.f: (r.n_links, r.first) for r in got.collect()} == want


def test_simhash_of_null_empty_and_repeated_texts(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (1, "A b  c d"), (2, None), (5, " \n"), (4, "")], "id long, body string")
    got = {r.id: (r.fingerprint, r.class_id, r.n_links, r.kept) for r in simhash_links(docs, "id", "body").collect()}
    assert got[1][0] == got[3][0] and got[3][1:] == (1, 0, False) and got[1][1:] == (1, 0, True)
    assert got[2] == ("0" * 16, 2, 0, True) and got[4][1:] == (2, 0, False) and got[5][1:] == (2, 0, False)
    assert simhash_links(docs.limit(0), "id", "body").count() == 0


def test_title_links_of_repeats_and_empty_titles(spark):
    titles = spark.createDataFrame([(1, "The red fox"), (2, "red fox, the"), (3, "red fox the end"), (4, "fox"), (5, "fox fox fox"), (6, "?!"), (7, None)], "id long, t string")
    got = {r.id: (r.class_id, r.n_links) for r in title_links(titles, "id", "t").collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 0), 5: (5, 0)}


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.md").write_text("before\n# First\n x  y\n\n  ##\nz\n#Last\n")
    (tmp_path / "two.md").write_text("# Only")
    (tmp_path / "no.txt").write_text("# Not\nread")
    got = [(r.path.rsplit("/", 1)[1], r.block, r.heading, r.body) for r in read_markdown(spark, str(tmp_path)).orderBy("path", "block").collect()]
    assert got == [("one.md", 0, "Document", "before"), ("one.md", 1, "First", "x y"), ("one.md", 2, "Section", "z")]


def test_notebooks_of_broken_empty_and_other_cells(spark):
    books = [(1, None), (2, "{broken"), (3, '{"cells": []}'), (4, '{"cells": [{"cell_type": "raw", "source": ["r"]}, {"cell_type": "markdown", "source": ["# T\\n", "t"]}, {"cell_type": "code", "source": ["1 + 1"]}]}')]
    got = [tuple(r) for r in notebook_blocks(spark.createDataFrame(books, "id long, book string"), "book").collect()]
    assert got == [(4, 2, "# T", "# T t"), (4, 3, "Code cell 3", "1 + 1")]


def test_mail_with_lines_that_start_with_from(spark, tmp_path):
    mail = [("a", "s", "From me\n>From you\n\nbye"), ("b", "", None), ("c", "Subject: x", "x\n\nSubject: y")]
    write_mbox(spark.createDataFrame(mail, "sender string, subject string, body string").repartition(2), str(tmp_path / "mail"))
    got = sorted(tuple(r) for r in read_mbox(spark, str(tmp_path / "mail")).collect())
    assert got == [(a, s, b or "") for a, s, b in mail]


def test_claims_with_doubt_years_and_empty_causes(spark):
    texts = [(1, "Rising rent leads to fewer births (1999). This causes a lot of grief. Short causes it."), (2, "High taxes may trigger a long strike"), (3, None), (4, "")]
    got = sorted((r.id, *r.c) for r in spark.createDataFrame(texts, "id long, t string").select("id", F.explode(claims(F.col("t"))).alias("c")).collect())
    assert got == [(1, "Rising rent", "fewer births", "leads_to", 0.977), (2, "High taxes may", "a long strike", "triggers", 0.595)]
