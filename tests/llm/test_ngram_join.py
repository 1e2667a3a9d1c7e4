import random
from collections import defaultdict

import pytest

from quern.llm import ngram_join as nj
from quern.llm.components import connected_components


def test_bands_reach_the_recall():
    for t, r in ((0.8, 0.999), (0.8, 0.9995), (0.5, 0.9), (0.95, 0.99), (1.0, 0.9)):
        bands, rows = nj.choose_bands(t, r)
        assert 1 - (1 - t**rows) ** bands >= r and bands * rows <= 128
    with pytest.raises(ValueError):
        nj.choose_bands(0.1, 0.999999, 4)


def test_digests_do_not_depend_on_bands():
    a, b = nj.Signer(20, 5), nj.Signer(1, 1)
    for t in ("", "one", "a b c d", "a b c d e f g h"):
        assert (a.ngrams(t) == b.ngrams(t)).all()
    assert len(nj.Signer(2, 2).band_hashes(a.ngrams("a b c"))) == 2


def sets(texts):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().split()
        if w:
            out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    return out


def test_exact_sets_and_overlaps():
    texts = ["a b c d e f", "a b c d e f", "b c d e f g h", "a", "a b", "", "a b c d", "a b c d e", "x " * 30, "a a a a a a b"]
    got, want = nj.exact_sets(texts), sets(dict(enumerate(texts)))
    assert [len(g) for g in got] == [len(want.get(i, ())) for i in range(len(texts))]
    both = nj._overlaps(got, got, width=3)
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert both[i, j] == len(want.get(i, set()) & want.get(j, set())), (texts[i], texts[j])


def brute(texts):
    s, parent, links = sets(texts), {i: i for i in texts}, defaultdict(int)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(s[a] & s[b])
            if n >= 0.8 * (len(s[a]) + len(s[b]) - n) - 1e-9:
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: (root(i), links[i]) for i in texts}


def corpus(seed=1, groups=12, copies=30):
    rng = random.Random(seed)
    texts, i = {}, 0
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(rng.randrange(1, copies)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            texts[i] = rng.choice([" ", "  ", "\n"]).join(t)
            i += 1
    return texts


@pytest.mark.parametrize("block", [4, 16, 512])
def test_matches_brute_force(spark, block):
    texts = corpus() | {1000: None, 1001: "", 1002: " \n", 1003: "long " * 40_000, 1004: "long " * 40_001}
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in texts.items()], "doc_id long, text string, key string, node string").repartition(3)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in nj.ngram_join(df, block=block).collect()}
    assert got == brute(texts)


def test_one_of_each_class_stays(spark):
    texts = corpus(2, 6, 12)
    df = spark.createDataFrame([(k, t, 1, "c") for k, t in texts.items()], "doc_id long, text string, _gone int, class_id string")
    stays = nj.drop_near_duplicates(df)
    assert stays.columns == df.columns
    assert {r["doc_id"] for r in stays.collect()} == {c for c, _ in brute(texts).values()}


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b  c d e f"), (3, "q r s t u"), (3, "v w x y z"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"]) for r in nj.ngram_join(df).collect()), key=str)
    assert got == sorted([(None, None), (1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (None, None)], key=str)
    assert nj.drop_near_duplicates(df).count() == 6
    assert nj.ngram_join(df.where("false")).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
