"""Containment joins against loops, and the alias rules."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import resolve as rs


def nested_loop_free(df):
    return "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(7)
    letters = ["a", "b", "é", "🎈", " "]
    make = lambda lo, hi: "".join(rnd.choice(letters) for _ in range(rnd.randint(lo, hi)))
    return sorted({make(1, 14) for _ in range(300)} - {""}), sorted({make(0, 60) for _ in range(300)})


def test_contained_in_equals_a_loop(spark, words):
    needles, texts = words
    got = rs.contained_in(spark.createDataFrame([(n,) for n in [*needles, ""]], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert nested_loop_free(got)
    assert sorted(map(tuple, got.collect())) == sorted((n, t) for n in needles for t in texts if n in t)
    none = spark.createDataFrame([], "needle string")
    assert rs.contained_in(none, spark.createDataFrame([("a",)], "text string")).collect() == []


def test_both_ways_of_resolving_equal_a_loop(spark, words):
    names, texts = words
    table = spark.createDataFrame([(f"e{k % 40:02d}", n.upper(), n) for k, n in enumerate(names)], "entity_id string, name string, alias string")
    asked = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, texts[0])], "query_id long, query string").repartition(3)
    owner = {}
    for k, n in enumerate(names):
        owner[n] = min(owner.get(n, f"e{k % 40:02d}"), f"e{k % 40:02d}")
    want = {}
    for i, t in [*enumerate(texts), (1000, None), (1001, texts[0])]:
        hits = sorted((-len(n), owner[n], n) for n in names if t and n in t)
        want[i] = hits[0][1:] if hits else (None, None)
    for options in ({}, {"max_chars": 0}):
        got = rs.resolve_longest(asked, table, **options)
        assert nested_loop_free(got)
        assert {r["query_id"]: (r["entity_id"], r["alias"]) for r in got.collect()} == want


def test_large_registry(spark):
    """Over 200,000 aliases; they do not fit the bound and are joined."""
    names = spark.range(210_000).select(F.concat(F.lit("entity number "), "id").alias("name"))
    table = rs.aliases(names, replacements=[], extra={})
    asked = spark.createDataFrame([(1, "about Entity Number 77 today"), (2, "entity number"), (3, "entity number 209999")], "query_id long, query string")
    got = {r["query_id"]: r["entity_id"] for r in rs.resolve_longest(asked, table).collect()}
    assert got == {1: "entity-number-77", 2: None, 3: "entity-number-209999"}
    found = rs.search_entities(asked.where("query_id = 3"), table).collect()
    assert [(r["entity_id"], r["score"], r["rank"]) for r in found] == [("entity-number-209999", 1.0, 1)]


def test_alias_rules(spark):
    names = spark.createDataFrame([("HDFC Mid Cap Fund Direct Growth",), ("My HDFC ELSS Fund",), ("  ",)], "name string")
    got = {}
    for r in rs.aliases(names).collect():
        got.setdefault(r["entity_id"], []).append(r["alias"])
    assert got["hdfc-mid-cap-fund-direct-growth"] == ["HDFC Mid Cap Fund Direct Growth", "hdfc mid cap fund direct growth", "hdfc mid cap fund", "hdfc mid cap fund growth", "hdfc mid cap fund direct", "hdfc mid cap direct growth", "mid cap fund direct growth", "mid cap", "midcap", "mid-cap"]
    assert got["my-hdfc-elss-fund"] == ["My HDFC ELSS Fund", "my hdfc elss fund", "my hdfc elss", "my elss fund", "elss", "tax saver"]
    assert set(got) == {"hdfc-mid-cap-fund-direct-growth", "my-hdfc-elss-fund"}


def test_confidences(evaluate):
    lit = F.lit
    share = lambda q, n, a: evaluate(rs.share_confidence(lit(q), lit(n), lit(a)))
    assert share("blue fund", "Blue Fund", "blue fund") == 1.0 and share("blue fund", "Blue Fund", "blue") == 0.9
    assert share("a long question of blue", "Blue", "blue") == pytest.approx(4 / 23, abs=1e-6)
    assert evaluate(rs.as_written_confidence(lit("x"), lit("X"), lit("x"))) == 1.0
