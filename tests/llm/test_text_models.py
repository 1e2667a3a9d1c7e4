"""Toxicity, quality rules, quality classifier, language ID and URL filter."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import langid, quality_pu, quality_rules, toxicity, url_filter
from quern.llm.common import fold
from quern.llm.features import WordHasher

DATA = os.environ.get("QUERN_TEST_DATA_S", "/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
ODD = [(1, None), (2, ""), (3, "   \n "), (4, "x " * 80_000), (5, "same"), (5, "same"), (None, "no id"), (6, "12 34 !! ||")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", 1) for i, t in ODD], "doc_id long, text string, lang string, source string, id int")


def test_fold_is_crc32(spark):
    got = {r["i"]: r["f"] for r in spark.range(50).select(F.col("id").alias("i"), fold("id", 5).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)}


# ------------------------------------------------------------------ toxicity
def test_totals_are_sums_over_places():
    w = np.zeros(1 << 12, np.float32)
    w[::3] = 1.5
    a, b = WordHasher(12), WordHasher(12, weights=w)
    for t in ("", "one", "one two", "The quick brown fox; the QUICK brown fox réeuxment " * 5):
        assert b.total(t) == pytest.approx(float(w[a.places(t)].sum()), rel=1e-6)


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(1)
    f, h = toxicity.Ftrl(16), WordHasher(16)
    for k in range(600):
        words = [f"w{rng.integers(200)}" for _ in range(20)] + (["nasty"] if k % 3 == 0 else [])
        f.learn(h.places(" ".join(words)), int(k % 3 == 0))
    m = f.model()
    assert 0 < len(m.places) < 3000
    w = m.dense()
    assert m.bias + w[h.places("w1 w2 nasty w3")].sum() > 0 > m.bias + w[h.places("w1 w2 w4 w3")].sum()


@needs_data
def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0))
    got = toxicity.score(docs, model).join(labels, "doc_id").where(fold("doc_id", 5) == 0).select((F.col("score") >= 0.5).cast("int").alias("p"), "toxic").collect()
    assert np.mean([r["p"] == r["toxic"] for r in got]) > 0.93
    assert not any(r["p"] and not r["toxic"] for r in got)


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(5, 1, "t"), (5, 0, "t"), (None, 1, "t"), (7, 1, "t"), (4, None, "t")], "doc_id long, toxic int, _text string")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.fit(odd, labels.where("false"))
    assert {r["score"] for r in toxicity.score(odd, none).collect()} == {0.5}
    assert toxicity.score(odd.where("false"), model).count() == 0
    kept = toxicity.drop_toxic(odd, toxicity.SparseModel(20, -1.0, np.empty(0, np.int32), np.empty(0, np.float32)))
    assert kept.columns == odd.columns and kept.count() == len(ODD)


# ------------------------------------------------------------------ quality rules
def brute_measure(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [ln for ln in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", ln)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    rep = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(ln in lines[:k] for k, ln in enumerate(lines)), len(rep)


def test_measures_match_brute_force():
    rng = np.random.default_rng(2)
    texts = [None, "", " \n\t", "a\x1cb\x85c\u00a0d", "x " * 50, "a b c d e f g h " * 2, "a b\n\na b\na  b\n", "é#|<> ü**\r\nñ"]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, k, 90)) for k in (2, 3, 5, 40)] + ["\n".join(["l 1", "l 2"] * 3)]
    p = [f"p{i}" for i in range(12)]
    texts.append(" ".join(p + ["z"] * 3 + p + ["y"] + p[:7]))
    for t in texts:
        assert quality_rules.measure(t)[:5] == brute_measure(t), t


def test_frequent_lines_go(spark):
    body = lambda i: " ".join(f"d{i}w{k}" for k in range(30))
    rows = [(i, f"Shared  LINE here\n{body(i)}", "h") for i in range(15)]
    rows += [(100 + i, "shared line here", "h") for i in range(2)]  # too short for the base rules
    rows += [(200 + i, "shared line here " * 0 + "\n".join(["shared line here"] * 9) + f"\nown {i}", "h") for i in range(3)]
    rows += [(300, f"shared line here\n{body(300)}", None), (301, None, "h"), (302, body(302), "h"), (302, body(302), "h")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, lines string")
    got = quality_rules.quality_rules(df, max_repeat_percent=100).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["removed_words"] == 3 and by[i]["kept"] and by[i]["removed_lines"] == [0] for i in range(15))
    assert all(by[200 + i]["removed_words"] == 27 and not by[200 + i]["kept"] and not by[200 + i]["base_failed"] for i in range(3))
    assert by[300]["removed_words"] == 0 and by[300]["kept"] and by[302]["kept"]
    assert by[301]["base_failed"] and not by[301]["kept"] and by[100]["base_failed"]
    clean = quality_rules.clean_documents(df.where("doc_id <> 302"), max_repeat_percent=100)
    assert clean.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[3] == body(3) and texts[300].startswith("shared") and 200 not in texts
    assert quality_rules.quality_rules(df.where("false")).count() == 0


def test_copies_are_one_document(spark):
    rows = [(i, "a line of five words\n" + " ".join(f"w{k}" for k in range(30)), "h") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(r["kept"] and r["removed_words"] == 0 for r in quality_rules.quality_rules(df).collect())


# ------------------------------------------------------------------ positive-unlabelled
def test_prior_and_risk():
    rng = np.random.default_rng(3)
    good = lambda n: np.column_stack([rng.uniform(50, 300, n), *[rng.uniform(0, 0.001, n)] * 3, np.full((n, 8), 0.03)])
    bad = lambda n: np.column_stack([rng.uniform(50, 300, n), *[rng.uniform(0.1, 0.3, n)] * 3, np.full((n, 8), 0.03)])
    m = quality_pu.fit_arrays(good(800), np.vstack([good(700), bad(300)]))
    assert 0.6 < m.prior < 0.85
    assert (m.scores(good(50)) >= 0.7).all() and (m.scores(bad(50)) < 0.5).all()


@needs_data
def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    model = quality_pu.fit(docs, labels.where(fold("doc_id", 4) != 2))
    got = quality_pu.score(docs, model).join(labels, "doc_id").where(fold("doc_id", 4) == 2).select((F.col("score") >= 0.7).cast("int").alias("p"), "quality").collect()
    assert np.mean([r["p"] == r["quality"] for r in got]) > 0.93


def test_quality_edges(spark, odd):
    labels = spark.createDataFrame([(5, 1), (None, 1), (2, 0), (77, 1)], "doc_id long, quality int")
    model = quality_pu.fit(odd, labels)
    got = quality_pu.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    none = quality_pu.fit(odd, labels.where("false"))
    assert {r["score"] for r in quality_pu.score(odd, none).collect()} == {0.5}
    assert quality_pu.score(odd.where("false"), model).count() == 0


# ------------------------------------------------------------------ languages
@needs_data
def test_languages_of_held_out_rows(tables):
    docs, _ = tables
    d = langid.fit(docs.where(fold("doc_id", 3) != 1))
    assert set(d) == {"de", "en", "es", "fr"} and all(len(c) <= 65_536 for c in d.values())
    got = langid.predict(docs, d).join(docs.select("doc_id", "lang"), "doc_id").where(fold("doc_id", 3) == 1).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97


def test_language_edges(spark, odd):
    d = {"aa": b"kala mala sala tala " * 30, "bb": b"brum drum grum strum " * 30}
    rows = spark.createDataFrame([(1, "Kala, MALA tala!"), (2, "grum brum"), (3, None), (4, "123 !!"), (5, ""), (6, "kala " * 60_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(rows, d).collect()}
    assert {k: r["lang_pred"] for k, r in got.items()} == {1: "aa", 2: "bb", 3: "und", 4: "und", 5: "und", 6: "aa"}
    assert got[3]["score"] == 0 and 0 < got[1]["score"] <= 1
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(odd)).collect()} == {"und"}  # nothing to learn from
    assert langid.predict(rows.where("false"), d).count() == 0
    only = langid.predict(rows, {"aa": d["aa"]}).collect()
    assert all(r["lang_pred"] in ("aa", "und") for r in only)


# ------------------------------------------------------------------ URLs
URLS = [
    ("http://x.org/a?b#c", "x.org", "/a", "org/", "allow"),
    ("http://EXAMPLE.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("http://a.example.org/en/12", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://x.org", "x.org", "", None, "allow"),
    ("http://casino.com/fr/", "casino.com", "/fr/", "com/fr/", "allow"),
    ("http://ok.com/de/x", "ok.com", "/de/x", "com/de/", "block"),
    ("http://www.casino-win.net/", "www.casino-win.net", "/", None, "block"),
    ("http://casinos.net/", "casinos.net", "/", None, "allow"),
    ("http://ads.net/x", "ads.net", "/x", None, "allow"),
    ("http://ads.net/ads/ADS", "ads.net", "/ads/ADS", None, "allow"),
    ("http://ads.net/x?free=1", "ads.net", "/x", None, "block"),
    ("no scheme casino", "", "", None, "block"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://h#f", "h", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
]


def test_urls(spark):
    df = spark.createDataFrame([(k, u, "r", "h") for k, (u, *_) in enumerate(URLS)] + [(None, "http://x.org/", "r", "h")], "page_id long, url string, rule string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()}
    for k, (_, *want) in enumerate(URLS):
        assert got[k] == tuple(want), URLS[k]
    assert got[None][3] == "allow"
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_url_tables_are_parameters():
    j = url_filter.UrlJudge([("b.c", "/x", "allow"), ("c", "/xyz", "block")], {"one": 0.4, "two": 0.4, "three": 0.4})
    assert j.rule("a.b.c", "/xyzw") == ("b.c/x", "allow")  # both are five long; the longer host decides
    assert j.judge("http://n/one/two")[3] == "allow" and j.judge("http://n/one/two/three")[3] == "block"
    assert url_filter.UrlJudge([], {}).judge("http://casino")[3] == "allow"


def test_non_negative_risk_by_loops():
    """The fit of the quality classifier against one that goes document by document."""
    import math

    from quern.llm import quality_pu as pu

    rng = np.random.default_rng(12)
    sizes = [len(e) for e in pu.EDGES.values()]
    draw = lambda n, top: np.column_stack([rng.integers(0, max(1, int(s * top)) + 1, n) for s in sizes]).astype(np.uint8)
    positive, unlabelled = draw(9, 1.0), np.concatenate([draw(14, 0.5), draw(6, 1.0)])
    features = lambda row: [1.0] + [float(c > j) for c, n in zip(row.tolist(), sizes) for j in range(n)]
    p, u = [features(r) for r in positive], [features(r) for r in unlabelled]
    dot = lambda w, x: sum(a * b for a, b in zip(w, x))
    sig = lambda z: 1 / (1 + math.exp(-z))
    for prior in (None, 0.3, 1.5):  # the last is no share, but its risk is soon negative
        w = [0.0] * len(p[0])
        m, v = list(w), list(w)
        flipped = 0
        for t in range(1, 41):
            grad = lambda rows, f: [sum(f(dot(w, x)) * x[k] for x in rows) / len(rows) for k in range(len(w))]  # noqa: B023, E731
            up, uu, both = grad(p, lambda z: sig(z) - 1), grad(u, sig), grad(p, sig)
            if prior is None:
                g = [(a + b) / 2 for a, b in zip(up, uu)]
            else:
                risk = sum(math.log1p(math.exp(dot(w, x))) for x in u) / len(u) - prior * sum(math.log1p(math.exp(dot(w, x))) for x in p) / len(p)
                flipped += risk < 0
                g = [prior * a + b - prior * c for a, b, c in zip(up, uu, both)] if risk >= 0 else [prior * c - b for b, c in zip(uu, both)]
            g = [a + 1e-4 * b for a, b in zip(g, w)]
            m, v = [0.9 * a + 0.1 * b for a, b in zip(m, g)], [0.999 * a + 0.001 * b * b for a, b in zip(v, g)]
            w = [a - 0.1 / math.sqrt(t) * (b / (1 - 0.9**t)) / (math.sqrt(c / (1 - 0.999**t)) + 1e-8) for a, b, c in zip(w, m, v)]
        assert np.allclose(pu._descend(pu.Binned(positive), pu.Binned(unlabelled), prior, 40), w, atol=1e-6), prior
        assert flipped or prior != 1.5


def test_prior_by_loops():
    import math

    from quern.llm import quality_pu as pu

    rng = np.random.default_rng(5)
    positive, unlabelled = rng.normal(2, 1, 400), np.concatenate([rng.normal(2, 1, 300), rng.normal(-2, 1, 700)])
    counts = rng.integers(1, 4, 1000).astype(float)
    got = pu.estimate_prior(positive, unlabelled, counts=counts)
    slack = math.sqrt(math.log(40) / 2) * (1 / math.sqrt(400) + 1 / math.sqrt(counts.sum()))
    bounds = []
    for c in sorted([*positive, *unlabelled]):
        qp, qu = sum(x >= c for x in positive) / 400, sum(n for x, n in zip(unlabelled, counts) if x >= c) / counts.sum()
        if qp > 0.05:
            bounds.append(((qu + slack) / qp, qu / qp))
    assert abs(got - min(bounds)[1]) < 0.02 and abs(got - counts[:300].sum() / counts.sum()) < 0.08


def test_counts_are_bounded_on_the_driver(spark):
    from quern.llm import quality_pu as pu

    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(["a", "Bb", "c1", "d.", "e!"], rng.integers(1, 40)))) for k in range(600)], "doc_id long, text string")
    fine = pu.counted(docs)
    few = pu.bounded(fine, 40).collect()
    assert fine.count() > 40 >= len(few) and sum(r["n"] for r in few) == 600
    labels = spark.createDataFrame([(k, 1) for k in range(0, 600, 9)], "doc_id long, quality int")
    assert pu.fit(docs, labels, max_bins=40).weights.shape == pu.fit(docs, labels).weights.shape


def test_fit_takes_one_way_at_any_size(spark, monkeypatch):
    from quern.llm import quality_pu as pu

    def coarser(*_):
        raise AssertionError("bins must not depend on the number of rows")

    monkeypatch.setattr(pu, "bounded", coarser)
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(["a", "Bb", "c1", "d.", "e!"], rng.integers(1, 40)))) for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 300, 9)], "doc_id long, quality int")
    a, b = pu.fit(docs, labels), pu.fit(docs.repartition(5), labels)
    assert a.prior == b.prior and (a.weights == b.weights).all() and np.abs(a.weights).max() > 0.1

    counts = pu.counted(docs)
    rows = counts.collect()
    codes, n = np.array([list(r["bins"]) for r in rows], np.uint8), np.array([r["n"] for r in rows])
    u, w = pu.Binned(codes, n), rng.normal(0, 1, len(a.weights))
    total, loss, g, h = pu._moments(counts, w)
    s = 1 / (1 + np.exp(-u.dot(w)))
    assert total == 300 and np.isclose(loss, u.mean(np.log1p(np.exp(u.dot(w))))) and np.allclose(g, u.mean_features(s))
    e = np.zeros(len(w))
    e[5] = 1e-6
    assert np.allclose((pu._moments(counts, w + e)[2] - pu._moments(counts, w - e)[2]) / 2e-6, h[5], atol=1e-6)
