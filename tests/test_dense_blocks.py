"""Dense search with more queries than one block takes."""

import math
import random
from functools import partial

import pytest

from quern.operators import retrieval as rt
from quern.plans import queries as core

SIX = "dense_topk dense_filter_or_relax rrf_fusion confidence_gate rerank_stats prompt_assembly".split()


def test_blocks_match_brute_force(spark):
    rng = random.Random(4)
    vectors = {i: [rng.uniform(-1, 1) for _ in range(8)] for i in range(60)}
    vectors[7], vectors[9] = list(vectors[3]), list(vectors[3])  # exact ties
    v = spark.createDataFrame([*vectors.items(), (100, None)], "chunk_id long, embedding array<double>").repartition(3)
    q = v.where("chunk_id % 3 = 0 or chunk_id = 100").withColumnRenamed("chunk_id", "query_id")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b) + 1e-8)
    want = {(k, n): c for k in range(0, 60, 3) for n, c in enumerate(sorted(vectors, key=lambda i: (-round(cos(vectors[k], vectors[i]), 12), i))[:5], 1)}
    for size in (1, 7, 20, 100):
        rows = rt.dense_topk_blocks(q, v, 5, max_queries=size).collect()
        assert len(rows) == len(want) and {(r["query_id"], r["rank"]): r["chunk_id"] for r in rows} == want
    assert rt.dense_topk_blocks(q.where("false"), v, 5).count() == 0


@pytest.mark.parametrize("name", SIX)
def test_queries_go_past_one_block(spark, tmp_path, monkeypatch, name):
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(140)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    told = lambda: sorted(map(repr, core.QUERIES[name](spark, str(tmp_path)).collect()))
    whole = told()
    limited = "dense_topk_blocks" if hasattr(rt, "dense_topk_blocks") else "dense_topk"
    monkeypatch.setattr(rt, limited, partial(getattr(rt, limited), max_queries=3))
    assert told() == whole and whole
