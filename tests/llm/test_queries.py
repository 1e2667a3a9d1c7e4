"""The registered queries against SQL, and the pipeline against its stages by brute force."""

import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from quern.llm import queries as q
from quern.llm.common import cut
from tests.test_catalogue import DATA, TABLES, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_equals_sql(spark, duck, name):
    compare(spark, duck, q.queries()[name], q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql()) - {"op12_packing"}))
def test_one_row_per_document(spark, name):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    rows = q.queries()[name](spark, DATA).collect()
    assert len(rows) == n == len({r["doc_id"] for r in rows})


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, DATA))
        out.append((name, before, docs))
    stages = dict((n, (a, b)) for n, a, b in out)
    for n in list(stages)[:-1]:
        assert stages[n][1].columns == stages[n][0].columns
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())

    scores = {r["doc_id"]: r["predicted"] for r in q.op3_toxicity(spark, DATA).collect()}
    a, b = stages["toxicity"]
    assert ids(b) == Counter(i for i in ids(a) if not scores[i])

    a, b = stages["exact_dedup"]
    first = {}
    for r in sorted(a.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r["text"] or ""), r["doc_id"])
    assert ids(b) == Counter(first.values())

    from tests.llm.test_ngram_join import brute

    a, b = stages["ngram_jaccard_join"]
    assert set(ids(b)) == {c for c, _ in brute({r["doc_id"]: r["text"] for r in a.collect()}).values()}

    a, b = stages["mixing"]
    assert set(ids(b)) <= set(ids(a)) and max(ids(b).values()) <= 2

    a, b = stages["bpe"]
    assert ids(a) == ids(b) and all(len(r["ids"]) == r["n_tokens"] for r in b.collect())
    got = sorted(ids(corpus_pipeline.run(spark, DATA)).items())
    assert got == sorted(ids(b).items())
