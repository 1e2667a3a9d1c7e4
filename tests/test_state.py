"""Streams with timers: rows of several batches out of order, against the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import ops
from quern.streaming import state as st

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def run(spark, tmp_path):
    """Feeds batches of rows as files, one a trigger, then a row far in the future, and returns what came out."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    st.use_rocksdb(spark)

    def feed(make, batches, schema):
        import os
        import time

        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{n:03d}")
        files = sorted(f"{d}/{f}" for d, _, fs in os.walk(f"{tmp_path}/in") for f in fs if f.endswith(".parquet"))
        for n, f in enumerate(files):
            os.utime(f, (time.time() - 1000 + n, time.time() - 1000 + n))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")

    yield feed
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_attempts_equal_the_batch_schedule(spark, run):
    rnd = random.Random(1)
    rows = [(f"op{k % 5}", k, False, T0 + dt.timedelta(seconds=rnd.randint(0, 5000))) for k in range(60)]
    shuffled = rnd.sample(rows, len(rows))
    got = run(lambda s: st.retry_timers(s, "2 hours", most=10), [shuffled[:20], shuffled[20:45], shuffled[45:], [("end", 0, False, T0 + dt.timedelta(days=300))]], "op string, id long, ok boolean, ts timestamp")
    want = ops.retry_schedule(spark.createDataFrame(rows, "op string, id long, ok boolean, ts timestamp").withColumn("id", F.col("id").cast("string")), "op", "ts", "id", most=10)
    key = ["op", "id", "ts", "attempt", "delay_s", "may_retry"]
    assert sorted(map(tuple, got.where("kind = 'attempt'").select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_due_timers_and_success(run):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    rows = [
        [("a", 1, False, s(0)), ("b", 1, False, s(0))],
        [("a", 3, False, s(200)), ("b", 2, True, s(50))],  # a is due at 120, before its next failure; b succeeds before it is due
        [("a", 2, False, s(130)), ("b", 3, False, s(60))],  # late, within the watermark: counted before the row at 200
        [("c", 1, True, s(20_000))],
        [("end", 1, True, s(40_000))],
    ]
    got = run(lambda x: st.retry_timers(x, "10 minutes", most=3), rows, "op string, id long, ok boolean, ts timestamp").collect()
    told = sorted((r["op"], (r["ts"] - T0).total_seconds(), r["kind"], r["attempt"], r["may_retry"]) for r in got if r["op"] in "ab")
    assert told == [
        ("a", 0, "attempt", 1, True), ("a", 120, "due", 1, True), ("a", 130, "attempt", 2, True), ("a", 200, "attempt", 3, False),
        ("b", 0, "attempt", 1, True), ("b", 50, "success", 0, False), ("b", 60, "attempt", 1, True), ("b", 180, "due", 1, True),
    ]


def test_changes_in_order_of_time(run):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    rows = [[("u", 1, "x", s(0)), ("u", 4, "y", s(300))], [("u", 2, "x", s(100)), ("u", 3, None, s(200)), ("v", 1, None, s(10))], [("u", 5, "y", s(5_000))], [("u", 6, "y", s(400 * 86_400)), ("v", 2, "z", s(400 * 86_400))], [("end", 1, "e", s(900 * 86_400))]]
    got = run(lambda x: st.change_states(x, "1 hour"), rows, "url string, id long, fingerprint string, ts timestamp").collect()
    told = {(r["url"], int(r["id"])): (r["status"], r["fingerprint"]) for r in got if r["url"] != "end"}
    assert told == {("u", 1): ("new", "x"), ("u", 2): ("unchanged", "x"), ("u", 3): ("failed", "x"), ("u", 4): ("changed", "y"), ("u", 5): ("unchanged", "y"), ("u", 6): ("new", "y"), ("v", 1): ("failed", ""), ("v", 2): ("new", "z")}


def test_a_key_has_one_timer_for_its_waiting_rows():
    from types import SimpleNamespace

    import pandas as pd

    from quern.streaming import state

    class Value:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        put = update

        def clear(self):
            self.value = None

        def appendList(self, rows):  # noqa: N802
            self.value = [*(self.value or []), *rows]

    timers = []
    handle = SimpleNamespace(getValueState=lambda *_: Value(), getListState=lambda *_: Value(), registerTimer=timers.append)
    p = state._Retries(10**9, 60, 3600, 3)
    p.init(handle)
    ms = [(k * 7919) % 1000 * 1000 for k in range(1000)]
    list(p.handleInputRows(("k",), iter([pd.DataFrame({"ms": ms, "id": [str(k) for k in range(1000)], "value": [False] * 1000})]), None))
    assert timers == [0]
    got = []
    for now in (400_500, 2_000_000):
        assert min(timers) <= now
        timers.clear()
        for part in p.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now), None):
            got += part[part["kind"] == "attempt"][["ms", "attempt"]].values.tolist()
        assert len(timers) <= 3
    assert got == [[k * 1000, k + 1] for k in range(1000)]
