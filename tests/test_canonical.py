"""Names with typos against a comparison of all pairs."""

import random
from collections import Counter

import pytest

from quern.operators import canonical as cn


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def names():
    rnd = random.Random(6)
    base = ["red bolt", "red bold", "steel ring", "é", "a", "", "small gear wheel", "ring"]
    out = []
    for _ in range(500):
        n = rnd.choice(base)
        for _ in range(rnd.choice([0, 0, 0, 1, 1, 2, 3])):
            k = rnd.randint(0, len(n))
            n = rnd.choice([n[:k] + n[k + 1 :], n[:k] + rnd.choice("abé ") + n[k:], n[:k] + rnd.choice("xy") + n[k + 1 :]])
        out.append(n)
    return out


@pytest.mark.parametrize("edits", [1, 2])
def test_equals_all_pairs(spark, names, edits):
    df = spark.createDataFrame([(n,) for n in [*names, None, "RED  bolt "]], "name string").repartition(3)
    clean = Counter(" ".join(n.lower().split()) for n in [*names, "RED  bolt "])
    clean.pop("", None)
    pairs = cn.near_names(spark.createDataFrame([(n,) for n in clean], "name string"), edits)
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, pairs.collect())) == sorted((a, b) for a in clean for b in clean if a != b and distance(a, b) <= edits)
    rank = lambda n: (-clean[n], n)
    follows = {a: min([a, *(b for b in clean if b != a and distance(a, b) <= edits)], key=rank) for a in clean}
    want = {}
    for a in clean:
        end = a
        while follows[end] != end:
            end = follows[end]
        want[a] = (clean[a], end)
    assert {r["name"]: (r["n"], r["canonical"]) for r in cn.canonical_names(df, edits=edits).collect()} == want


def test_no_names(spark):
    assert cn.canonical_names(spark.createDataFrame([(None,), ("  ",)], "name string")).collect() == []
