import datetime as dt
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.operators import evaluate as ev
from quern.operators import ops
from quern.plans import answer, ingest
from quern.plans import queries as core
from quern.plans.answer import retrieve_and_gate
from quern.sources import fetch
from quern.sources import io as sio
from quern.streaming import streams


def test_changes_and_state(spark):
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", ""), ("d", "4")], "url string, fingerprint string")
    t = dt.datetime(2024, 1, 1)
    prev = spark.createDataFrame([("a", "1", t, "new"), ("b", "x", t, "new"), ("c", "9", t, "new"), ("z", "7", t, "new")], "url string, fingerprint string, last_checked timestamp, status string")
    changes = ops.detect_changes(cur, prev)
    assert {r["url"]: r["status"] for r in changes.collect()} == {"a": "unchanged", "b": "changed", "c": "failed", "d": "new"}
    state = {r["url"]: r["fingerprint"] for r in ops.merge_state(prev, changes, F.lit(t)).collect()}
    assert state == {"a": "1", "b": "2", "c": "9", "d": "4", "z": "7"}  # a failed fetch keeps what was known
    assert tuple(ops.change_summary(changes).first()) == (4, 2, 1, 1)


def test_changes_of_pages_with_one_url(spark, tmp_path):
    pages = [(1, "u", "a"), (2, "u", "b"), (3, "u", "c"), (5, "u", "d"), (7, "v", "e"), (10, "v", "f"), (11, None, "g")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("change_detection", "change_summary"):
        assert Counter(map(tuple, core.QUERIES[name](spark, str(tmp_path)).collect())) == Counter(con.execute(core.SQL[name]).fetchall()), name


def test_changes_of_pages_without_html(spark, tmp_path):
    pages = [(k, f"u{k % 4}", None if k % 2 else f"h{k}") for k in range(1, 31)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("change_detection", "change_summary"):
        assert Counter(map(tuple, core.QUERIES[name](spark, str(tmp_path)).collect())) == Counter(con.execute(core.SQL[name]).fetchall()), name


def test_a_known_url_does_not_multiply_rows(spark):
    cur = spark.createDataFrame([("a", "1"), ("a", "2")], "url string, fingerprint string")
    t = dt.datetime(2024, 1, 1)
    prev = spark.createDataFrame([("a", "9", t), ("a", "1", t + dt.timedelta(days=1))], "url string, fingerprint string, last_checked timestamp")
    assert sorted((r["fingerprint"], r["status"]) for r in ops.detect_changes(cur, prev).collect()) == [("1", "unchanged"), ("2", "changed")]


def test_gates(spark):
    texts = spark.createDataFrame([("x" * 200,), ("y" * 200,)], "text string")
    assert ops.text_gate(texts, "chunks", 100, 0.05, 2000, 0.1, duplicates=True).first()["status"] == "passed"
    assert ops.text_gate(texts.union(texts), "chunks", 100, 0.05, duplicates=True).first()["status"] == "failed"
    assert ops.text_gate(texts.union(spark.createDataFrame([("s",)], "text string")), "c", 100, 0.05).first()["status"] == "warning"
    gates = spark.createDataFrame([("a", "passed"), ("b", "warning"), ("c", "failed")], "gate string, status string")
    r = ops.roll_up(gates).first()
    assert (r["overall"], r["failed"], r["warned"], r["checks"]) == ("failed", ["c"], ["b"], 3)
    e = spark.createDataFrame([([0.0] * 128,), ([1.0] * 128,), (None,)], "embedding array<double>")
    h = ops.embedding_health(e, 3).first()
    assert (h["zero_vectors"], h["coverage"], h["issues"], h["status"]) == (1, round(2 / 3, 6), 2, "degraded")
    assert ops.embedding_gate(e, 128).first()["status"] == "failed"
    assert ops.fetch_gate(spark.createDataFrame([], "fetch_status string, content_length long")).first()["status"] == "failed"


def test_retry_and_freshness(spark):
    rows = spark.createDataFrame([("o", i, i) for i in range(8)], "op string, ts long, id long")
    got = ops.retry_schedule(rows, "op", "ts", "id").orderBy("ts").collect()
    assert [r["delay_s"] for r in got][:2] == [120.0, 240.0] and got[-1]["delay_s"] == 3600.0
    assert [r["may_retry"] for r in got[:3]] == [True, True, False]
    a = spark.createDataFrame([("x", dt.datetime(2024, 1, 1))], "name string, updated_at timestamp")
    f = ops.freshness(a, F.lit("2024-01-04 00:00:00").cast("timestamp")).first()
    assert f["age_hours"] == 72.0 and f["is_stale"]


def test_evaluation(spark):
    exp = spark.createDataFrame([(1, "e", ["nav"], "easy"), (2, None, [], "hard"), (3, "f", ["x"], "hard")], "query_id long, expected_entity string, expected_keywords array<string>, difficulty string")
    res = spark.createDataFrame([(1, "e", True, 2, "the NAV is"), (2, "g", False, 1, "")], "query_id long, entity_id string, should_proceed boolean, n_results int, top_text string")
    judged = ev.judge(res, exp)
    m = ev.metrics(judged).first()
    assert m["success_rate"] == pytest.approx(33.333333) and not m["passed"]
    assert {r["difficulty"]: r["n"] for r in ev.by_difficulty(judged).collect()} == {"easy": 1, "hard": 2}


def test_fetching_classes_of_failure(spark):
    def get(url):
        if url.endswith("404"):
            raise fetch.HttpFailure(404)
        if url.endswith("down"):
            raise OSError("down")
        return 200, "text/html", url.encode()

    urls = spark.createDataFrame([("u/ok",), ("u/404",), ("u/down",), (None,)], "url string")
    got = {r["url"]: (r["fetch_status"], r["http_status_code"]) for r in fetch.fetch(urls, get, retries=1).collect()}
    assert got == {"u/ok": ("success", 200), "u/404": ("failed", 404), "u/down": ("failed", 0)}


def test_json_sources_and_index(spark, tmp_path):
    assert sio.read_json_or_empty(spark, str(tmp_path / "none.json"), sio.REGISTRY).count() == 0
    with pytest.raises(Exception):
        sio.read_json(spark, str(tmp_path / "none.json"), sio.REGISTRY).count()
    (tmp_path / "r.json").write_text('{"sources": [{"url": "u1", "scheme_name": "A b"}, {"url": "u2", "scheme_name": "C"}]}')
    reg = sio.registry(spark, str(tmp_path / "r.json"))
    assert {r["key"] for r in sio.entity_urls(reg).collect()} == {"a b", "c"}
    fall = spark.createDataFrame([("f",)], "url string")
    assert sio.registry(spark, str(tmp_path / "none.json"), fall).first()["url"] == "f"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.html").write_bytes(b"ok\xff!")
    assert sio.snapshots(spark, str(tmp_path / "raw")).first()["html"] == "ok!"
    rows = spark.createDataFrame([("c1", "t", "s", {"k": 1}, None)], "chunk_id string, text string, scheme string, extra map<string,int>, doc_type string")
    flat = sio.scalar_metadata(rows).first()
    assert flat["extra"] == '{"k":1}' and flat["doc_type"] == ""
    index = sio.write_index(rows.select("chunk_id", "text", "scheme"), str(tmp_path / "index"))
    assert sio.find(index, "scheme", "s").count() == 1
    p1, p2 = sio.publish(rows.select("text"), str(tmp_path / "v")), sio.publish(rows.select("text"), str(tmp_path / "v"))
    assert p1 != p2 and spark.read.parquet(p1).count() == 1


def test_pages_to_answers(spark):
    block = "The fund has an expense ratio and an exit load and a nav, with risk and a benchmark for the portfolio. "
    html = f"<h1>Costs</h1><p>{block * 12}</p><h2>Login</h2><p>sign in</p>"
    pages = spark.createDataFrame([("https://x.org/a/blue-fund", html), ("https://x.org/a/red-fund", f"<div>{block}</div>"), ("https://x.org/none", None)], "url string, html string")
    chunks = ingest.ingest(pages).cache()
    ids = [r["chunk_id"] for r in chunks.collect()]
    assert len(ids) == len(set(ids)) >= 3
    assert {r["scheme"] for r in chunks.select("scheme").distinct().collect()} == {"Blue Fund", "Red Fund"}
    embedded = ingest.embed(chunks, dim=32)
    assert answer.retrieve(spark.createDataFrame([(1, "expense ratio"), (2, None)], "query_id long, query string"), embedded, dim=32).count() >= 3
    q = spark.createDataFrame([(1, "expense ratio of it", "blue-fund"), (2, "exit load", None)], "query_id long, query string, entity_id string")
    best, told = retrieve_and_gate(q, embedded, k=2, dim=32)
    assert {r["query_id"] for r in best.collect()} == {1, 2} and told.count() == 2
    assert all("blue-fund" in r["source_url"] for r in best.where("query_id = 1").collect())


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i % 5, i % 60), i % 3, "ab"[i % 2], float(i)) for i in range(200)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    df = spark.createDataFrame(rows, schema)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), schema)
    q = streams.tumbling(stream).writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    batch = streams.tumbling(df.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, batch.collect()))


def test_change_sink_is_idempotent(spark, tmp_path):
    run = streams.change_sink(spark, str(tmp_path / "state"))
    t = dt.datetime(2024, 1, 1)
    one = spark.createDataFrame([("a", "1", t), ("b", "2", t)], "url string, fingerprint string, ts timestamp")
    two = spark.createDataFrame([("a", "", t), ("b", "3", t)], "url string, fingerprint string, ts timestamp")
    run(one, 0), run(two, 1), run(two, 1)
    got = {r["url"]: (r["fingerprint"], r["status"]) for r in spark.read.parquet(str(tmp_path / "state" / "v1")).collect()}
    assert got == {"a": ("1", "failed"), "b": ("3", "changed")}


def test_retry_state_stream(spark, tmp_path):
    rows = [("x", False, dt.datetime(2024, 1, 1, 0, i)) for i in range(3)] + [("y", True, dt.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "op string, ok boolean, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("op string, ok boolean, ts timestamp").parquet(str(tmp_path / "in"))
    q = streams.retry_state(s).writeStream.format("memory").queryName("retries").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert {r["op"]: (r["attempts"], r["exhausted"]) for r in spark.table("retries").collect()} == {"x": (3, True), "y": (0, False)}
