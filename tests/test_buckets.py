"""Changes by bucket: what they rewrite, what a failed or late writer leaves."""

import pytest
from pyspark.sql import functions as F

from quern.sources import buckets as bk

SCHEMA = "url string, n long, text string"


def rows(spark, root, version=None):
    return sorted((r["url"], r["n"], r["text"]) for r in bk.read_buckets(spark, root, SCHEMA, version).collect())


def table(spark, keys, text="old"):
    return spark.createDataFrame([(f"u{k}", n, f"{text} {k}") for k in keys for n in (0, 1)], SCHEMA)


def test_a_change_of_one_percent_rewrites_about_one_percent(spark, tmp_path):
    root = f"file:{tmp_path}/i"
    first = bk.upsert(root, table(spark, range(600)), "url", 1024)
    occupied = first["written"]
    changed = [k for k in range(600) if k % 100 == 7]
    got = bk.upsert(root, table(spark, changed, "new"), "url", 1024)
    assert got["written"] <= len(changed) and got["written"] + got["kept"] == occupied and got["written"] < 0.03 * occupied
    want = sorted((f"u{k}", n, f"{'new' if k in changed else 'old'} {k}") for k in range(600) for n in (0, 1))
    assert rows(spark, root) == want
    assert rows(spark, root, first["version"]) == sorted((f"u{k}", n, f"old {k}") for k in range(600) for n in (0, 1))
    files = bk.read_buckets(spark, root, SCHEMA).inputFiles()
    assert sum(first["version"] in f for f in files) >= got["kept"]


def test_additions_removals_and_empty_buckets(spark, tmp_path):
    root = f"file:{tmp_path}/i"
    assert rows(spark, root) == []
    bk.upsert(root, table(spark, range(30)), "url", 8)
    gone = spark.createDataFrame([(f"u{k}",) for k in [*range(0, 30, 2), 999]] + [(None,)], "url string")
    bk.upsert(root, table(spark, [40, 41]).unionByName(spark.createDataFrame([(None, 5, "x")], SCHEMA)), "url", 8, gone)
    assert {u for u, *_ in rows(spark, root)} == {f"u{k}" for k in [*range(1, 30, 2), 40, 41]}
    everything = spark.createDataFrame([(f"u{k}",) for k in range(50)], "url string")
    got = bk.upsert(root, table(spark, []), "url", 8, everything)
    assert rows(spark, root) == [] and got["written"] == 0
    bk.upsert(root, table(spark, [3]), "url", 8)
    assert [u for u, *_ in rows(spark, root)] == ["u3", "u3"]
    assert bk.vacuum(spark, root) and [u for u, *_ in rows(spark, root)] == ["u3", "u3"] and bk.vacuum(spark, root) == []


def test_a_failed_writer_changes_nothing(spark, tmp_path):
    root = f"file:{tmp_path}/i"
    bk.upsert(root, table(spark, range(50)), "url", 16)
    before = rows(spark, root)
    broken = table(spark, [1, 2], "new").withColumn("text", F.when(F.col("url") == "u2", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        bk.upsert(root, broken, "url", 16)
    assert rows(spark, root) == before
    bk.upsert(root, table(spark, [1, 2], "new"), "url", 16)
    assert dict((u, t) for u, _, t in rows(spark, root))["u2"] == "new 2"
    assert len(bk.vacuum(spark, root)) <= 1  # what the failed one had begun, if its committer left any


def test_of_two_writers_from_one_version_one_is_lost(spark, tmp_path, monkeypatch):
    root = f"file:{tmp_path}/i"
    bk.upsert(root, table(spark, range(10)), "url", 4)
    seen = bk._current(spark, root)
    bk.upsert(root, table(spark, [1], "first"), "url", 4)
    monkeypatch.setattr(bk, "_current", lambda *_: seen)
    with pytest.raises(bk.Lost):
        bk.upsert(root, table(spark, [2], "second"), "url", 4)
    monkeypatch.undo()
    texts = {t for *_, t in rows(spark, root)}
    assert "first 1" in texts and "second 2" not in texts
