"""Nulls, repeated rows and ids, ids of other types, long turns: operators and pipeline stages."""

import hashlib
from collections import Counter

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import chat_format as cf
from quern.llm import common, components, exact_dedup, ngram_join, toxicity
from quern.llm import queries as q


def test_many_null_ids_of_one_text(spark):
    rows = [(None, "a  b")] * 10_000 + [(7, "a b")] * 5_000 + [(3, "c"), (None, "only null"), (None, "only null")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = exact_dedup.exact_dedup(df)
    assert got.count() == len(rows)
    kept = got.where("kept").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in kept) == {(7, 7, 15_000, sha("a b")): 1, (3, 3, 1, sha("c")): 1, (None, None, 2, sha("only null")): 1}
    assert sorted(map(tuple, exact_dedup.drop_exact_duplicates(df).collect()), key=str) == sorted([(7, "a b"), (3, "c"), (None, "only null")], key=str)


def test_two_texts_under_one_digest_stop_the_job(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest", lambda norm: F.unhex(F.md5(F.substring(norm, 1, 1))))
    df = spark.createDataFrame([(1, "alpha", "x"), (2, "beta", "x"), (3, "beta", "y")], "doc_id long, text string, lang string")
    assert exact_dedup.drop_exact_duplicates(df).count() == 2
    for f in (exact_dedup.drop_exact_duplicates, exact_dedup.exact_dedup):
        got = f(df.unionByName(spark.createDataFrame([(4, "another", "x")], df.schema)))
        assert "raise_error" in got._jdf.queryExecution().optimizedPlan().toString()
        with pytest.raises(Exception, match="two texts share a digest"):
            got.collect()


def test_of_equal_ids_and_texts_reruns_keep_the_same_row(spark):
    rows = [(1, "same", f"source {k}") for k in range(40)]
    kept = {exact_dedup.drop_exact_duplicates(spark.createDataFrame(sorted(rows, key=lambda r: hash((n, r))), "doc_id long, text string, source string").repartition(n)).first()["source"] for n in (1, 3, 7)}
    assert len(kept) == 1


def test_ids_written_out_in_steps(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "STEP", 3)
    df = spark.createDataFrame([(1, "x")] * 10 + [(2, "x")] * 4, "doc_id long, text string").repartition(2)
    assert Counter((r["doc_id"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect()) == {(1, True): 1, (1, False): 9, (2, False): 4}


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,0)"])
def test_joins_take_ids_of_any_type(spark, kind):
    rows = [(str(k), "one two three four five six " + "seven eight nine ten " * (k < 15) + ("x" if k == 14 else "")) for k in range(10, 18)]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    got = {str(r["doc_id"]): (str(r["class_id"]), r["n_links"]) for r in ngram_join.ngram_join(df, block=2).collect()}
    assert {k: c for k, (c, _) in got.items()} == {str(k): "10" if k < 15 else "15" for k in range(10, 18)}
    assert ngram_join.ngram_join(df).schema["class_id"].dataType == df.schema["doc_id"].dataType
    assert {str(r["doc_id"]) for r in ngram_join.drop_near_duplicates(df).collect()} == {"10", "15"}


def test_text_ids_that_are_no_numbers(spark):
    df = spark.createDataFrame([("c-01", "a b c d e f"), ("c-02", "a b c d e f"), ("z", None)], "doc_id string, text string")
    assert {r["doc_id"]: r["class_id"] for r in ngram_join.ngram_join(df).collect()} == {"c-01": "c-01", "c-02": "c-01", "z": "z"}


def test_past_rounds_leave_no_files(spark, tmp_path):
    import os

    edges = spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long")
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(folder))
    assert components.connected_components(edges).count() == 31
    assert len(set(os.listdir(folder)) - before) == 1


def test_checkpoint_folder_is_asked_for_on_a_cluster():
    assert common.is_local("local") and common.is_local("local[4]") and not common.is_local("local-cluster[3,2,1024]") and not common.is_local("spark://x:1")


def test_samples_are_small_before_they_are_ordered(spark):
    ids = spark.range(50_000).withColumnRenamed("id", "doc_id")
    low = ids.where(common.hash_unit("s", "doc_id") < common.sample_limit(100, 50_000)).count()
    assert 100 <= low < 400
    got = [r["doc_id"] for r in common.sampled(ids, "doc_id", 100, "s").collect()]
    want = sorted(range(50_000), key=lambda k: (int(hashlib.md5(f"s:{k}".encode()).hexdigest()[:8], 16), k))[:100]
    assert sorted(got) == sorted(want)
    assert common.sampled(ids.where("false"), "doc_id", 100, "s").count() == 0 and common.sampled(ids.where("doc_id < 30"), "doc_id", 100, "s").count() == 30


# ------------------------------------------------------------------ chat formatting
@pytest.mark.parametrize("long_at", [0, 77, 199])
@pytest.mark.parametrize("system", [False, True])
def test_one_long_turn_leaves_the_stride_alone(spark, long_at, system):
    turns = [(1, k + 1, ("user", "assistant")[k % 2], "t" * (9_000 if k == long_at else 100)) for k in range(200)]
    turns += [(1, 0, "system", "be good " * 20)] * system
    windows = cf.format_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    tokens = lambda t: -(-len(f"{cf.START}{t[2]}\n{t[3]}{cf.END}\n") // 4)
    sys = tokens(turns[-1]) if system else 0
    own = sum(map(tokens, turns)) - sys
    assert len(windows) <= own / (2048 - sys - 512) + 3
    assert sum(w["n_tokens"] for w in windows) <= (1 + 512 / (2048 - sys - 512)) * own + sys * len(windows)
    alone = [w for w in windows if w["over_budget"]]
    assert len(alone) == 1 and alone[0]["text"].count(cf.START) == 1 + system
    assert sum(len(w["loss_spans"]) for w in windows) == 100


@pytest.mark.parametrize("answer", [1_900, 2_100, 3_900, 6_000, 8_000])
def test_long_answers_keep_their_questions(spark, answer):
    """Three questions of 100 characters and three long answers; then a question without an answer."""
    turns = [(1, k, ("user", "assistant")[k % 2], f"{k}" * (answer if k % 2 else 100)) for k in range(7)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = sorted(cf.format_windows(df).collect(), key=lambda w: w["window"])
    assert not any(w["over_budget"] for w in windows)
    # Beside an answer of 8,000 and its question the last one does not fit.
    assert [bool(w["loss_spans"]) for w in windows] == [True] * (len(windows) - (answer == 8_000)) + [False] * (answer == 8_000)
    for w in windows:
        said = [p.split("\n", 1)[1] for p in w["text"].split(cf.END + "\n")[:-1]]
        for s in w["loss_spans"]:
            k = int(w["text"][s["start"]])
            assert str(k - 1) * 100 in said
    one = cf.format_windows(df.where("turn < 2").withColumn("text", F.when(F.col("turn") == 0, F.repeat(F.lit("q"), 7_000)).otherwise(F.repeat(F.lit("a"), 4_000)))).collect()
    assert sorted(len(w["loss_spans"]) for w in one) == [0, 1]  # a question that does not fit beside its answer


def test_windows_without_a_target(spark):
    """Only where the turns fit beside none: exchanges are not cut at the stride."""
    import random

    rnd = random.Random(4)
    rows = []
    for c in range(60):
        for k in range(rnd.randint(1, 40)):
            rows.append((c, k, rnd.choice(["user", "user", "assistant"]), "x" * rnd.choice([5, 200, 900, 2_500, 5_000])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    answered = {r[0] for r in rows if r[2] == "assistant"}
    tokens = lambda t: -(-len(f"{cf.START}{t[2]}\n{t[3]}{cf.END}\n") // 4)
    exchanges = {}
    for r in rows:
        done = sum(x[0] == r[0] and x[1] < r[1] and x[2] == "assistant" for x in rows)
        exchanges[r[0], done] = exchanges.get((r[0], done), 0) + tokens(r)
    small = {c for c in answered if all(n <= 1_000 for (own, _), n in exchanges.items() if own == c)}
    windows = cf.format_windows(df).collect()
    assert small and all(w["loss_spans"] for w in windows if w["conv_id"] in small)
    assert sum(w["n_tokens"] for w in windows) <= 3 * sum(map(tokens, rows))


def test_odd_urls(spark):
    from quern.llm import url_filter

    long = "http://a.example.net/" + "x-" * 500_000 + "casino"
    rows = [(1, long), (1, long), (None, "http://B.example.org/es/1"), (2, None), (3, ""), (4, "no scheme casino")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(c) for c in ("id", "host", "path", "terms")})
    got = Counter((r["page_id"], r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect())
    assert got == {(1, "a.example.net", 1_000_007, None, "block"): 2, (None, "b.example.org", 5, "example.org/es/", "block"): 1, (2, "", 0, None, "allow"): 1, (3, "", 0, None, "allow"): 1, (4, "", 0, None, "block"): 1}
    assert url_filter.judge_urls(df.limit(0)).collect() == []


# ------------------------------------------------------------------ pipeline stages
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, `row` string, salt int, `odd name` array<string>"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Tables whose labels teach that "nasty" is toxic."""
    d = str(tmp_path_factory.mktemp("sf"))
    texts = [(k, f"plain words number {k} are here" + " nasty insult" * (k % 2)) for k in range(400)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i, _ in texts], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def odd_rows():
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, "a b c d e f g"), (2, "a  b c d e f g"), (2, "a  b c d e f g"), (None, "a b c d e f g"), (None, None), (None, None), (3, None), (4, ""), (5, long), (6, long + " end"), (7, "a nasty insult of words"), (None, "nasty insult"), (8, "p q r s t u v w x y z"), (8, "other words of the same id")]
    return [(i, t, None if k % 3 else "en", None if k % 4 else "s", None, "x", "r", 1, None) for k, (i, t) in enumerate(rows)]


def test_stages_take_odd_tables(spark, sf_dir):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    columns = docs.columns
    model = q.toxicity_model(spark, sf_dir)
    assert len(model.places)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.cut(stage(spark, docs, sf_dir))
        rows = docs.collect()
        ids = Counter(r["doc_id"] for r in rows)
        if name != "bpe":
            assert docs.columns == columns
        if name == "toxicity":
            assert 7 not in ids and ids == {1: 1, 2: 2, None: 3, 3: 1, 4: 1, 5: 1, 6: 1, 8: 2}
        if name == "exact_dedup":
            assert ids == {1: 1, 3: 1, 5: 1, 6: 1, 8: 2}
        if name == "ngram_jaccard_join":
            assert ids == {1: 1, 3: 1, 5: 1, 8: 2}
        if name == "mixing":
            assert set(ids) <= {1, 3, 5, 8} and max(ids.values()) <= 4
    assert Counter(r["doc_id"] for r in before.collect()) == ids


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, sf_dir))
        assert docs.count() == 0


def test_nothing_is_dropped_without_labels(spark):
    docs = spark.createDataFrame([(1, "a nasty insult"), (2, None)], "doc_id long, text string")
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.drop_toxic(docs, none).count() == 2
