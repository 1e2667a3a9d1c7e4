"""What the operators do with all of their rows: hot hosts."""

import numpy as np
import pytest

from quern.llm import langid, quality_pu, quality_rules


@pytest.fixture(scope="module")
def hot_host(spark):
    rows = []
    for i in range(2_200):
        body = " ".join(f"d{i}w{k}" for k in range(30))
        planted = [f"passage found in {n} documents" for n in (20, 200, 2_000) if i < n]
        rows.append((i, "\n".join([*planted, body]), "hot"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_absolute_limit_in_a_hot_host(hot_host):
    got = {r["doc_id"]: r["removed_lines"] for r in quality_rules.quality_rules(hot_host).collect()}
    assert all(got[i] == list(range((i < 20) + (i < 200) + (i < 2_000))) for i in range(2_200))


def test_share_of_a_hot_host(hot_host):
    """2,200 texts: the limit is 22, so the passage of 20 documents stays."""
    got = {r["doc_id"]: r["removed_lines"] for r in quality_rules.quality_rules(hot_host, share=0.01).collect()}
    assert got[0] == [1, 2] and got[20] == [0, 1] and got[200] == [0] and got[2_100] == []


def test_unlabelled_side_is_all_documents(spark):
    good = "A plain sentence of some common words, and one more of them."
    rows = [(i, good + " word" * (i % 40)) for i in range(12_000)] + [(20_000, "### $$$ *** " * 20)] * 3 + [(None, "@@@ " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = quality_pu.counted(docs).collect()
    assert sum(r["n"] for r in got) == len(rows)
    odd = quality_pu.bins(np.array([quality_pu.statistics("### $$$ *** " * 20)]))[0].tobytes()
    assert [r["n"] for r in got if bytes(r["bins"]) == odd] == [3]


def test_counts_weigh_as_rows():
    rng = np.random.default_rng(6)
    codes = np.column_stack([rng.integers(0, len(e) + 1, 40) for e in quality_pu.EDGES.values()]).astype(np.uint8)
    n = rng.integers(1, 9, 40)
    p = codes[rng.integers(0, 40, 30)]
    halves = [(codes[:20], n[:20]), (codes[20:], n[20:])]
    rows = [(np.repeat(c, k, 0), np.ones(k.sum())) for c, k in halves]
    a, b = quality_pu.fit_bins(p, halves, 50), quality_pu.fit_bins(p, rows, 50)
    assert a.prior == pytest.approx(b.prior) and a.weights == pytest.approx(b.weights)


def test_dictionaries_learn_from_whole_texts(spark):
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    head = " ".join(f"licence{letters(k)}" for k in range(200))  # longer than the share of a document
    rows = [(i, head + " " + " ".join(f"korpo{letters(i * 100 + k)}" for k in range(900)), "xx") for i in range(200)]
    words = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["xx"].split()
    assert sum(w.startswith(b"korpo") for w in words) > 0.7 * len(words)


def test_clean_documents_keeps_null_and_repeated_ids(spark):
    body = lambda i: " ".join(f"d{i}w{k}" for k in range(30))
    rows = [(i, f"shared line here\n{body(i)}", "h", ["t"]) for i in range(15)]
    rows += [(None, f"{body(50)}\nshared line here", "h", None), (3, f"shared line here\n{body(51)}", None, ["u", None]), (3, body(52), "h", []), (4, body(4), "h", ["v"]), (4, body(4), "h", ["v"]), (60, "short", "h", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `odd name` array<string>")
    clean = quality_rules.clean_documents(df)
    assert clean.schema.names == df.schema.names
    want = [(i, t.replace("shared line here\n", "").replace("\nshared line here", "") if s == "h" else t, s, o) for i, t, s, o in rows[:-1]]
    assert sorted(map(repr, map(tuple, clean.collect()))) == sorted(map(repr, want))
