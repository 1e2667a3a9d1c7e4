"""Sketches against exact figures, merged, re-made and merged again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import telemetry as tm


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rnd.choice(["a", "b"]), rnd.choice([rnd.expovariate(1 / 50), rnd.gauss(200, 5)]), rnd.randint(0, 900), t0 + dt.timedelta(minutes=rnd.randint(0, 4 * 24 * 60))) for _ in range(20_000)]
    rows += [("c", None, None, t0), ("c", 1.5, 7, t0)]
    return spark.createDataFrame(rows, "event_type string, value double, user_id long, ts timestamp")


def test_quantiles_are_within_the_stated_error(events):
    hours = tm.hourly_sketches(events)
    qs = {"q01": 0.01, "q50": 0.5, "q95": 0.95, "q99": 0.99}
    for by, own in (("kind", events.withColumn("kind", F.col("event_type"))), ("day", events.withColumn("day", F.to_date("ts")))):
        got = {r[by]: r for r in tm.latency_report(hours.withColumn("day", F.to_date("hour")), by, quantiles=qs).collect()}
        for k, rows in own.where("value is not null").groupBy(by).agg(F.array_sort(F.collect_list("value"))).collect():
            users = own.where(F.col(by) == F.lit(k)).select("user_id").where("user_id is not null").distinct().count()
            assert abs(got[k]["n_keys"] - users) <= max(1, 0.05 * users)
            assert got[k]["worst"] == rows[-1]
            for name, q in qs.items():
                below = sum(v < got[k][name] for v in rows) / len(rows), sum(v <= got[k][name] for v in rows) / len(rows)
                assert below[0] - tm.RANK_ERROR - 1 / len(rows) <= q <= below[1] + tm.RANK_ERROR + 1 / len(rows), (k, name)


def test_an_hour_made_again_replaces_itself_only(spark, events, tmp_path):
    day = events.where("ts < '2024-01-02'")
    tm.hourly_sketches(day.where("minute(ts) < 30")).write.parquet(f"{tmp_path}/kept")  # some of each hour only
    kept = spark.read.parquet(f"{tmp_path}/kept")
    again = tm.hourly_sketches(day.where("hour(ts) = 5"))
    got = tm.merged(tm.replace_hours(kept, again), "hour").select("hour", "n").collect()
    want = {r["h"]: r["n"] for r in day.where("minute(ts) < 30 or hour(ts) = 5").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r["hour"]: r["n"] for r in got} == want and len(want) == 24


def test_sketches_are_held_against_counts_without_exact_quantiles(spark, tmp_path):
    from quern.plans import queries as core

    rows = [(k, dt.datetime(2024, 1, 1, k % 24), k % 7 if k % 5 else None, "ab"[k % 2], None if k % 11 == 0 else float(k * 37 % 1000)) for k in range(2000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = core.latency_sketches(spark, str(tmp_path))
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()  # its cost grows with its accuracy
    assert sorted(map(tuple, got.select("event_type", "n", "p50_holds", "p95_holds", "keys_hold").collect())) == [("a", 1000, True, True, True), ("b", 1000, True, True, True)]
