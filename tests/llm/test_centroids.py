"""Clustering against plain loops with Python's integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import centroids as ct


def plain(rows, k=8, rounds=10, dim=64, scale=1024, seed="3"):
    """rows of (id, vector) -> {(id, nth)}: the contract, spelt out."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cs = [v for _, v in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(cs)), key=lambda c: (apart(v, cs[c]), c))
    for _ in range(rounds):
        at = [near(v) for _, v in kept]
        for c in range(len(cs)):
            own = [v for (_, v), a in zip(kept, at) if a == c]
            if own:
                cs[c] = [sum(col) // len(own) for col in zip(*own)]
    at = [near(v) for _, v in kept]
    d = [apart(v, cs[a]) for (_, v), a in zip(kept, at)]
    per = {c: sum(x for x, a in zip(d, at) if a == c) for c in range(len(cs))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, a, x, per[a], sum(d), digest[a]) for (i, _), a, x in zip(kept, at, d)), key=str)


def run(spark, rows, **options):
    clashing = {c: F.lit(c) for c in ("id", "v", "cluster", "distance", "h")}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(clashing)
    return sorted(map(tuple, ct.cluster(df.repartition(3), **options).collect()), key=str)


def test_equals_plain_loops(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)]) for i in range(300)]
    assert run(spark, rows, dim=6) == plain(rows, dim=6)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (2, None), (3, []), (4, [1.0]), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [0.75, 0.75]), (8, [-0.0001, 0.0])]
    assert run(spark, rows, dim=2, k=3) == plain(rows, dim=2, k=3)
    assert run(spark, rows, dim=2) == plain(rows, dim=2)
    assert run(spark, [(2, None)], dim=2) == []


def test_ties_go_to_the_lowest_number(spark):
    """Two starts at the same place and points halfway between centroids."""
    rows = [(i, [float(i % 3) / 8, 0.0]) for i in range(60)]
    assert run(spark, rows, dim=2, k=4, rounds=3) == plain(rows, dim=2, k=4, rounds=3)


def test_the_screen_leaves_what_float32_cannot_tell():
    """Distances that differ by 1 in 2^40 are decided by integers."""
    big = 1 << 20
    cs = np.array([[big, -big + 1], [big, -big], [-big, big]], np.int64)
    x = np.array([[-big, big], [-big + 1, big], [big, -big], [0, 0], [1, 1]], np.int64)
    at, exact = ct.nearest(x, cs)
    want = [min(range(3), key=lambda c: (sum((int(p) - int(q)) ** 2 for p, q in zip(r, cs[c])), c)) for r in x]
    assert at.tolist() == want and exact >= 1
    rng = np.random.default_rng(1)
    x, cs = rng.integers(-600, 600, (4000, 64)), rng.integers(-50, 50, (8, 64))
    at, exact = ct.nearest(x, cs)
    every = ((x[:, None, :] - cs[None]) ** 2).sum(2)
    assert (at == every.argmin(1)).all() and exact < 400


def test_components_beyond_the_bound_are_an_error(spark):
    with pytest.raises(Exception, match="outside"):
        run(spark, [(1, [1e9, 0.0])], dim=2)
