"""The stored vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval as rt
from quern.sources import vector_index as vi


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(f"c{k:04d}", (centres[k % 12] + 0.35 * rng.normal(size=16)).tolist()) for k in range(1500)]
    rows += [(f"same{k}", centres[0].tolist()) for k in range(400)] + [("zero", [0.0] * 16), ("none", None), (None, centres[1].tolist())]
    asked = [(k, (centres[k % 12] + 0.5 * rng.normal(size=16)).tolist()) for k in range(60)] + [(100, [0.0] * 16), (101, None), (102, (-centres[3]).tolist())]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(4), spark.createDataFrame(asked, "query_id long, embedding array<double>")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


def test_exact_search_misses_nothing(spark, tables, tmp_path):
    corpus, asked = tables
    vi.write_vectors(corpus, f"{tmp_path}/i", per_slice=50)
    stored = spark.read.parquet(f"{tmp_path}/i/vectors")
    assert stored.count() == 1901
    assert stored.groupBy("list", "slice").count().agg(F.max("count")).first()[0] < 120  # 400 equal vectors are in many slices
    want = rows(rt.dense_topk(asked, corpus, 10))
    assert rows(vi.search_vectors(asked, f"{tmp_path}/i", 10, exact=True)) == want
    assert rows(vi.search_vectors(asked, f"{tmp_path}/i", 10, probes=1, exact=True)) == want


def test_recall_of_a_few_lists(spark, tables, tmp_path):
    corpus, asked = tables
    vi.write_vectors(corpus, f"{tmp_path}/i")
    some = asked.where("query_id < 100")
    want, got = ({x[:1] + x[2:3] for x in rows(df)} for df in (rt.dense_topk(some, corpus, 10), vi.search_vectors(some, f"{tmp_path}/i", 10)))
    assert len(got) == len(want) and len(want & got) / len(want) >= 0.9
    one = vi.search_vectors(asked.where("query_id = 5"), f"{tmp_path}/i", 10, probes=2)
    assert one.count() == 10
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "list#" in plan and "PartitionFilters: [list#" in plan


def test_queries_are_dealt(spark, tables, tmp_path, monkeypatch):
    corpus, asked = tables
    monkeypatch.setattr(vi, "QUERIES", 7)
    vi.write_vectors(corpus, f"{tmp_path}/i", lists=3)
    assert rows(vi.search_vectors(asked, f"{tmp_path}/i", 4, probes=3)) == rows(rt.dense_topk(asked, corpus, 4))


def test_empty_and_other_dimensions(spark, tables, tmp_path):
    corpus, asked = tables
    vi.write_vectors(corpus.limit(0), f"{tmp_path}/e")
    assert vi.search_vectors(asked, f"{tmp_path}/e").collect() == []
    vi.write_vectors(corpus.where("chunk_id < 'c0002'"), f"{tmp_path}/s")
    assert vi.search_vectors(asked, f"{tmp_path}/s", 10).where("query_id = 0").count() == 2
    with pytest.raises(Exception, match="dimension|matmul"):
        vi.search_vectors(asked.withColumn("embedding", F.slice("embedding", 1, 3)), f"{tmp_path}/s").collect()


def test_a_slice_is_compared_in_bounded_parts(monkeypatch):
    import pyarrow as pa

    from quern.sources import vector_index as vi

    rng = np.random.default_rng(4)
    c, q = rng.normal(size=(7000, 6)).round(1), rng.normal(size=(300, 6)).round(1)
    ids = rng.permutation(7000)
    wide, best = [], vi._best
    monkeypatch.setattr(vi, "_best", lambda s, *a: wide.append(s.shape) or best(s, *a))
    table = lambda name, i, v: pa.table({name: pa.array(i), "v": pa.array(v.tolist(), pa.list_(pa.float64()))})
    got = vi._found(5)(table("chunk_id", ids, c), table("query_id", np.arange(300), q)).to_pylist()
    s = np.round(q @ c.T / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((c * c).sum(1))[None, :] + 1e-8), 12)
    want = {(n, int(ids[j])) for n in range(300) for j in np.lexsort((ids, -s[n]))[:5]}
    assert {(r["query_id"], r["chunk_id"]) for r in got} == want and len(got) == 1500
    assert max(a * b for a, b in wide) <= 256 * (2048 + 5)
