import math
import random
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import resolve as rs
from quern.operators import retrieval as rt
from quern.operators.ranking import distributed_rank
from quern.plans import queries as core


def test_dense_topk_matches_brute_force_with_ties(spark):
    rng = random.Random(2)
    vectors = {i: [rng.uniform(-1, 1) for _ in range(8)] for i in range(60)}
    vectors[7], vectors[9] = list(vectors[3]), list(vectors[3])  # exact ties
    v = spark.createDataFrame([*vectors.items(), (100, None), (None, vectors[3])], "chunk_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(k, vectors[k]) for k in (3, 20)], "query_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in rt.dense_topk(q, v, 5).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b) + 1e-8)
    for k in (3, 20):
        want = sorted(vectors, key=lambda i: (-round(cos(vectors[k], vectors[i]), 12), i))[:5]
        assert [got[k, n] for n in range(1, 6)] == want
    with pytest.raises(ValueError):
        rt.dense_topk(q, v, 5, max_queries=1)
    with pytest.raises(Exception, match="dimension"):
        rt.dense_topk(q, v.unionByName(spark.createDataFrame([(101, [1.0])], v.schema)), 5).collect()
    assert rt.dense_topk(q.where("false"), v, 5).count() == 0


def test_bm25_matches_formula(spark):
    docs = {1: "a b c a", 2: "b b d", 3: "a e", 4: "f g h i j", 5: ""}
    toks = {i: t.split() for i, t in docs.items()}
    n, avgdl = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    query = "a b b"
    want = {}
    for i, t in toks.items():
        s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in query.split() if w in t)
        if any(w in t for w in query.split()):
            want[i] = round(s, 6)
    d = spark.createDataFrame(list(docs.items()), "chunk_id long, text string")
    q = spark.createDataFrame([(1, query)], "query_id long, query string")
    assert {r["chunk_id"]: r["score"] for r in rt.bm25_scores(q, d).collect()} == pytest.approx(want, abs=2e-6)


def test_bm25_reads_the_documents_twice(spark):
    """Once to count, once to score."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    texts = ["a b c a", "b b d", "a e", "b", "f g h i j", "", None, "B c"]
    plain = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(3)
    q = spark.createDataFrame([(1, "a b b"), (2, "c zz b"), (3, ""), (None, "a")], "query_id long, query string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in rt.bm25_topk(q, plain.withColumn("text", seen("text")), 8).collect()}
    assert read.value <= 2 * len(texts)
    assert got == pytest.approx({(r["query_id"], r["chunk_id"]): r["score"] for r in rt.bm25_scores(q.where("query_id is not null"), plain).where("score > 0").collect()}, abs=2e-6)


def test_bm25_query_asks_every_benchmark_row(spark, tmp_path):
    """Ids that 20 does not divide are asked, too; against brute force and the query's SQL."""
    texts = {1: "a b c a", 2: "b b d", 3: "a e", 4: "F g h i j", 5: "", 7: "d e", 8: "A e"}
    asked = {0: "a b b", 1: "g", 7: "d e", 19: "zz", 20: "c a", 41: "E", -3: "h b", 43: None, None: "a"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    toks = {i: t.lower().split() for i, t in texts.items()}
    df, avgdl = Counter(w for t in toks.values() for w in set(t)), sum(map(len, toks.values())) / len(texts)
    raw = {w: math.log(len(texts) - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    want = set()
    for q, text in asked.items():
        if q is None or text is None:
            continue
        score = {i: round(sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in text.lower().split() if w in t), 6) for i, t in toks.items()}
        best = sorted((i for i in score if score[i] > 0), key=lambda i: (-score[i], i))[:10]
        want |= {(q, i, score[i], n) for n, i in enumerate(best, 1)}
    got = sorted(map(tuple, core.bm25_topk(spark, str(tmp_path)).collect()))
    assert got == sorted(want) and {q for q, *_ in got} == {0, 1, 7, 20, 41, -3}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.execute(core.SQL["bm25_topk"]).fetchall())


def test_token_counts_leave_a_task_in_parts(monkeypatch):
    rng = random.Random(4)
    lists = [[f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 6))] for _ in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(lists[k : k + 5], pa.list_(pa.string()))], ["said"]) for k in range(0, 40, 5)]
    want = Counter(w for x in lists for w in x)
    for held in (2, 12, 1000):
        monkeypatch.setattr(rt, "_COUNTS_HELD", held)
        parts = [r for b in rt._token_counts(iter(batches)) for r in b.to_pylist()]
        got = Counter()
        for r in parts:
            got[r["token"]] += r["n"]
        assert got == want and (len(parts) == len(want)) == (held > 100)
    assert list(rt._token_counts(iter([]))) == []


def test_rrf_weights_and_missing_side(spark):
    dense = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, rank int")
    sparse = spark.createDataFrame([(1, 11, 1)], "query_id long, chunk_id long, rank int")
    got = {r["chunk_id"]: r["score"] for r in rt.reciprocal_rank_fusion(dense, sparse).collect()}
    assert got == pytest.approx({10: 0.7 / 21, 11: 0.7 / 22 + 0.3 / 21})


def test_boost_filter_gate(spark, evaluate):
    assert evaluate(rt.section_boost(F.lit("expense ratio now"), F.lit("Expense Ratio"))) == pytest.approx(1.3 + 0.1 * 2 / 3)
    assert evaluate(rt.section_boost(F.lit("x"), F.lit("y"))) == 1.0
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "query_id long, e string")
    assert sorted(map(tuple, rt.filter_or_relax(rows, F.col("e") == "a").collect())) == [(1, "a"), (2, "b")]
    ranked = spark.createDataFrame([(1, 0.9, 1), (1, 0.5, 2), (2, 0.9, 1), (3, 0.05, 1), (3, 0.0, 2), (4, -2.0, 1)], "query_id long, score double, rank int")
    got = {r["query_id"]: (r["confidence_level"], r["reason"], r["should_proceed"]) for r in rt.gate(rt.confidence(ranked)).collect()}
    assert got == {1: ("high", "confident", True), 2: ("low", "low_margin", False), 3: ("low", "low_score", False), 4: ("very_low", "low_score", False)}
    s = rt.rerank_statistics(ranked.where("query_id = 1")).first()
    assert (s["median_score"], s["n_high"], s["n_medium"], s["std_score"]) == (0.9, 1, 1, pytest.approx(0.2))
    t, m = rt.adaptive_thresholds(F.lit("numeric"))
    assert evaluate(t) == pytest.approx(0.08) and evaluate(m) == pytest.approx(0.025)


def test_rerank_keeps_best(spark):
    rows = spark.createDataFrame([(1, 5, "a b", "a b", 1), (1, 6, "a b", "c", 2), (1, 7, "a b", None, 3)], "query_id long, chunk_id long, query string, text string, rank int")
    assert [r["chunk_id"] for r in rt.rerank(rows, 2).orderBy("rank").collect()] == [5, 6]


def test_resolution(spark):
    reg = spark.createDataFrame([("Blue Growth Fund",), ("Blue Fund",)], "name string")
    al = rs.aliases(reg, extra={"growth": ["grow more"]})
    assert "blue growth" in {r["alias"] for r in al.collect()} and "grow more" in {r["alias"] for r in al.collect()}
    q = spark.createDataFrame([(1, "tell me of BLUE GROWTH fund"), (2, "nothing"), (3, None)], "query_id long, query string")
    got = {r["query_id"]: r["entity_id"] for r in rs.resolve_longest(q, al).collect()}
    assert got == {1: "blue-growth-fund", 2: None, 3: None}
    assert sorted(map(tuple, rs.resolve_longest(q, al, max_chars=0).collect()), key=str) == sorted(map(tuple, rs.resolve_longest(q, al).collect()), key=str)
    top = rs.search_entities(spark.createDataFrame([(1, "blue")], "query_id long, query string"), al).orderBy("rank").collect()
    assert top[0]["score"] == 1.0


def test_distributed_rank_is_a_numbering(spark):
    df = spark.range(500).selectExpr("concat('u', id % 450) AS url").repartition(7)
    got = sorted(r["rank"] for r in distributed_rank(df, "url", blocks=16).collect())
    assert got == list(range(1, 501))
