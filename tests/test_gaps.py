"""Redirects, logs, versions, health, freshness, hybrid retrieval on text ids."""

import datetime as dt
import http.server
import threading

import pytest
from pyspark.sql import functions as F

from quern.functions.query import normalize_query
from quern.operators import answers, evaluate, ops
from quern.operators import resolve as rs
from quern.operators import retrieval as rt
from quern.plans import answer
from quern.sources import fetch
from quern.sources import io as sio


@pytest.fixture(scope="module")
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(302 if self.path.startswith("/go") else 200)
            if self.path.startswith("/go"):
                self.send_header("Location", "/" + self.path.split("=")[1])
            self.send_header("Content-Length", "2")
            self.end_headers()
            self.wfile.write(b"ok")

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_redirects_only_to_listed_urls(spark, server):
    urls = spark.createDataFrame([(f"{server}/a",), (f"{server}/go=a",), (f"{server}/go=b",)], "url string")
    got = {r["url"].removeprefix(server): (r["fetch_status"], r["http_status_code"]) for r in fetch.fetch(urls).collect()}
    assert got == {"/a": ("success", 200), "/go=a": ("failed", 302), "/go=b": ("failed", 302)}
    get = fetch.listed_get(urls.where("url like '%/a'"))
    got = {r["url"].removeprefix(server): r["fetch_status"] for r in fetch.fetch(urls, get).collect()}
    assert got == {"/a": "success", "/go=a": "success", "/go=b": "failed"}
    with pytest.raises(ValueError):
        fetch.listed_get(urls, 2)


def test_logs_are_redacted_and_expire(spark, tmp_path):
    rows = spark.createDataFrame([("mail me at a.b@example.org", "2024-01-01"), ("plain", "2024-01-05")], "query string, at string")
    sio.append_log(rows, str(tmp_path / "log"), F.col("at"))
    read = lambda: {r["query"] for r in spark.read.json(str(tmp_path / "log")).collect()}
    assert "plain" in read() and not any("example.org" in q for q in read())
    assert sio.expire_log(spark, str(tmp_path / "log"), "2024-01-03") == ["2024-01-01"] and read() == {"plain"}


def test_pointer_names_the_current_version(spark, tmp_path):
    root = str(tmp_path / "index")
    first = sio.publish(spark.range(1), root)
    assert sio.current(spark, root) is None
    sio.switch(spark, root, first)
    second = sio.publish(spark.range(2), root)
    assert sio.current(spark, root) == first
    sio.switch(spark, root, second)
    assert spark.read.parquet(sio.current(spark, root)).count() == 2


def test_health(spark):
    report = spark.sql("SELECT 3L total_input_chunks, 2L total_indexed_chunks, map('scheme', true, 'doc_type', false) filter_checks")
    r = ops.index_health(report).first()
    assert (r["count_match"], r["failed_filters"], r["issues"], r["status"]) == (False, ["doc_type"], 2, "degraded")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    at = lambda h: dt.datetime(2024, 1, 10) - dt.timedelta(hours=h)
    fresh = lambda rows: ops.data_freshness(spark.createDataFrame(rows, "name string, updated_at timestamp_ntz"), now).first()
    assert fresh([("index", at(1)), ("embeddings", at(2))])["status"] == "healthy"
    assert fresh([("index", at(3)), ("embeddings", at(2))])["status"] == "degraded"
    assert (fresh([("index", at(60)), ("embeddings", at(2))])["issues"], fresh([("index", at(1))])["issues"]) == (2, 1)
    checks = spark.createDataFrame([("a", "healthy"), ("b", "degraded")], "check string, status string")
    assert ops.health_rollup(checks).first()["overall"] == "degraded"


def test_boosts_and_alignment(spark, evaluate):
    day = lambda s: F.lit(s).cast("date")
    assert evaluate(rt.freshness_boost(F.lit(1.0), day("2024-01-01"), day("2024-01-01"))) == 1.0
    assert evaluate(rt.freshness_boost(F.lit(1.0), day("2023-10-03"), day("2024-01-01"), 90)) == pytest.approx(0.5)
    assert evaluate(rt.freshness_boost(F.lit(1.0), day(None), day("2024-01-01"))) == 0.5
    assert evaluate(rt.generic_penalty(F.lit(1.0), F.lit("Document"))) == 0.8 and evaluate(rt.generic_penalty(F.lit(1.0), F.lit("Costs"))) == 1.0
    assert evaluate(answers.evidence_alignment(F.lit("The load is one. Cats fly high."), F.lit("the exit load is one percent"))) == 0.5
    assert evaluate(answers.evidence_alignment(F.lit(""), F.lit("x"))) == 1.0


def test_gaps_and_confusion(spark):
    chunks = spark.createDataFrame([("a", "The NAV is 5"), ("a", "exit load none"), ("b", None)], "entity_id string, text string")
    facts = spark.createDataFrame([("nav",), ("Exit load",)], "fact string")
    gaps = evaluate.coverage_gaps(chunks, facts, chunks)
    assert sorted(map(tuple, gaps.collect())) == [("b", "exit load"), ("b", "nav")] and "NestedLoop" not in gaps._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        evaluate.coverage_gaps(chunks, facts, chunks, max_facts=1)
    assert evaluate.coverage_gaps(chunks, facts.limit(0), chunks).collect() == []
    judged = spark.createDataFrame([(True, True), (True, False), (False, False)], "success boolean, entity_correct boolean")
    assert tuple(evaluate.confusion_rate(judged).first()) == (2, 50.0)


def test_running_rate_over_many_blocks(spark):
    rows = [(k * 7, k % 3 == 0) for k in range(200)]
    judged = spark.createDataFrame(rows, "query_id long, success boolean").repartition(3)
    got = {r["seen"]: r["running_rate"] for r in evaluate.running_rate(judged, block=4).collect()}
    assert got == {n: pytest.approx(100 * sum(ok for _, ok in rows[:n]) / n, abs=1e-6) for n in range(5, 201, 5)}


def test_post_processing_trims_the_body_only(spark, evaluate):
    long = "One is here. Two is there. Three comes. Four goes.\n\nSource: https://x.org/a.b\n\nLast updated from sources: 2024-01-01"
    c = answers.post_process_columns(F.lit(long), F.lit("factual"), F.lit("https://x.org/a.b"), F.lit("2024-01-01"), F.lit(False))
    assert evaluate(c["violations"]) == ["too_many_sentences"]
    assert evaluate(c["final_answer"]) == "One is here. Two is there. Three comes.\n\nSource: https://x.org/a.b\n\nLast updated from sources: 2024-01-01"
    banned = lambda **k: evaluate(answers.post_process_columns(F.lit("We recommend nothing."), F.lit("refusal"), F.lit(None).cast("string"), F.lit("x"), F.lit(False), **k)["violations"])
    assert banned() == ["banned_tokens"] and banned(own=F.lit(True)) == []


# ------------------------------------------------------------------ hybrid retrieval
WORDS = "load nav risk ratio fee tax cap term".split()


def counted(text):
    words = F.split(F.lower(text), " ")
    return F.array(*[(F.size(words) - F.size(F.array_remove(words, w))).cast("double") for w in WORDS])


@pytest.fixture(scope="module")
def chunks(spark):
    rows = []
    for e, name in enumerate(("blue fund", "red fund", "odd fund")):
        for n in range(14):
            rows.append((f"c-{e:02d}-{n:03d}", f"{name} says {WORDS[(n + e) % 8]} and {WORDS[(n * 3) % 8]} number{n}", name.replace(" ", "-"), "Exit Load" if n % 2 else "Other", f"https://x.org/{e}", "2024-01-01"))
    df = spark.createDataFrame(rows, "chunk_id string, text string, entity_id string, section_heading string, source_url string, source_date string")
    return df.withColumn("embedding", F.when(F.col("entity_id") != "odd-fund", counted(F.col("text"))))


@pytest.fixture(scope="module")
def aliases(spark):
    return rs.aliases(spark.createDataFrame([("Blue Fund",), ("Red Fund",), ("Odd Fund",)], "name string"))


def entities(rows):
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], set()).add(int(r["chunk_id"].split("-")[1]))
    return out


@pytest.mark.parametrize("filter_first", [True, False])
def test_entity_decides_what_is_searched(spark, chunks, aliases, filter_first):
    # Sure of blue; red by alias, unsure; odd has no vector: given, so nothing; by alias and unsure, so all; no entity: all.
    asked = [("a", "nav", "blue-fund"), ("b", "nav of red fund in all the long words of this question", None), ("c", "nav", "odd-fund"), ("d", "nav of odd fund in all the long words of this question", None), ("e", "nav load", None)]
    q = spark.createDataFrame(asked, "query_id string, query string, entity_id string")
    got = entities(answer.retrieve(q, chunks, encoder=counted, aliases=aliases, filter_first=filter_first, per_channel=10 if filter_first else 42).collect())
    assert got["a"] == {0} and got["b"] == {1} and "c" not in got and got["d"] == got["e"] == {0, 1}


def test_filter_before_the_cut_finds_what_filtering_after_it_loses(spark, chunks):
    q = spark.createDataFrame([(1, "blue load", "red-fund")], "query_id long, query string, entity_id string")
    first = answer.retrieve(q, chunks, encoder=counted, per_channel=3).collect()
    assert entities(first) == {1: {1}} and len(first) >= 3


def test_answers_from_chunks(spark, chunks, aliases):
    q = spark.createDataFrame([(1, "what is the nav of blue fund"), (2, ""), (3, "should i buy red fund")], "query_id long, query string")
    got = {r["query_id"]: r for r in answer.answer_queries(q, chunks, encoder=counted, aliases=aliases, banned=[]).collect()}
    assert {k: r["method"] for k, r in got.items()} == {1: "extractive", 2: "error", 3: "refusal"}
    assert got[1]["source_url"] == "https://x.org/0" and got[1]["last_updated"] == "2024-01-01" and "blue fund says" in got[1]["answer"]
    unsure = answer.route(q, least_sure=0.95).collect()
    assert {r["query_id"]: r["route"] for r in unsure}[1] == "refusal"


@pytest.mark.parametrize("blocks", [3, 500_000])
def test_bm25_in_blocks_equals_pairs(spark, chunks, blocks):
    q = spark.createDataFrame([("q1", "blue load load"), ("q2", "number3 fee red"), ("q3", "nothing here"), ("q4", None), (None, "blue")], "query_id string, query string")
    want = rt.ranked(rt.bm25_scores(q.where("query_id is not null"), chunks), 4).where("score > 0")
    got = rt.bm25_topk(q, chunks, 4, max_weights=blocks)
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == 8


def test_normalised_text_is_searched(evaluate):
    assert evaluate(normalize_query(F.lit("Exit-Load  5YRS"), compose=False)) == "exit load 5 year"
