"""Streams: telemetry windows, sessions, change detection and retry state.

Every function takes a streaming (or static) DataFrame and returns one; the
caller starts the query with its own checkpoint location.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.ops import detect_changes, merge_state


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 10) -> DataFrame:
    """Files of a folder as a stream, with ts as an instant."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 hour", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums per window and kind; state of windows older than the watermark is dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), kind, "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "1 hour", kind: str = "event_type") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step), kind).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("window_start"), kind, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def first_seen(events: DataFrame, late: str = "1 hour", key: str = "event_id") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def change_sink(spark: SparkSession, state_root: str):
    """A foreachBatch function that keeps (url, fingerprint, last_checked, status) in versioned folders under state_root.

    A batch writes version batch_id from version batch_id - 1, so a repeated batch
    writes the same state again.
    """
    schema = "url string, fingerprint string, last_checked timestamp, status string"

    def read(n: int) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{state_root}/v{n}") if n >= 0 else spark.createDataFrame([], schema)

    def run(batch: DataFrame, n: int) -> None:
        last = batch.groupBy("url").agg(F.max_by("fingerprint", "ts").alias("fingerprint"), F.max("ts").alias("ts"))
        before = read(n - 1)
        changes = detect_changes(last, before).join(last.select("url", "ts"), "url")
        merge_state(before, changes, F.col("ts")).write.mode("overwrite").parquet(f"{state_root}/v{n}")

    return run


def retry_state(attempts: DataFrame, most: int = 3) -> DataFrame:
    """op, attempts, exhausted after each micro-batch, from (op, ok, ts): a success clears the count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        # All rows of the micro-batch in order; a row that comes in a later one counts there.
        for ok in pd.concat(list(batches)).sort_values("ts")["ok"]:
            n = 0 if ok else n + 1
        state.update((n,))
        yield pd.DataFrame({"op": [key[0]], "attempts": [n], "exhausted": [n >= most]})

    return attempts.groupBy("op").applyInPandasWithState(step, "op string, attempts long, exhausted boolean", "n long", "update", GroupStateTimeout.NoTimeout)
