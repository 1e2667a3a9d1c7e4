"""Every catalogue query against its SQL on the smallest tables."""

import os
from collections import Counter

import pytest

from quern.plans import queries as core

DATA = os.environ.get("QUERN_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def compare(spark, duck, f, sql):
    df = f(spark, DATA)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_equals_sql(spark, duck, name):
    compare(spark, duck, core.QUERIES[name], core.SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs_twice_alike(spark, name):
    rows = [sorted(map(repr, core.QUERIES[name](spark, DATA).collect())) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]
