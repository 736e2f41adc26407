"""Every registered query of the library's own operators against DuckDB, on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from quillspark import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return tuple(map(plain, x)) if isinstance(x, list) else x


#: Queries whose rows SQL cannot give, with tests of their own in test_wide.py.
WITHOUT_SQL = {"graph_clusters", "retrieve_approximate"}


def test_each_query_has_sql():
    assert set(registry.queries()) - WITHOUT_SQL == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == Counter(tuple(map(plain, r)) for r in want.fetchall())
