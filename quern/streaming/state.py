"""Keyed state with event-time timers: retries and changes, counted in order of time.

Rows may come in any order within the watermark's delay, in one micro-batch or several. A key's rows wait in
its state until the watermark has passed them, a timer takes them out in order, and only what follows from
them stays: a count and a due time, or a fingerprint. State is kept by RocksDB, so a batch writes
the keys it touches only; a key that has been idle for long, or whose retries succeeded, is forgotten.

Streams must run with the RocksDB state store (``use_rocksdb``). Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def use_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class _InOrder(StatefulProcessor):
    """Hands the rows (ms, id, value) of a key to step() in order of time and id, once the watermark has passed them.

    ``state`` is one row of the subclass's SCHEMA or None; ``idle_ms`` after its last row a key is forgotten.
    """

    SCHEMA: str
    VALUE: str
    OUTPUT: list[str]

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.SCHEMA + ", seen long")
        self.waiting = handle.getListState("waiting", f"ms long, id string, value {self.VALUE}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = [(int(ms), str(i), v) for part in rows for ms, i, v in zip(part["ms"], part["id"], part["value"])]
        self.waiting.appendList(came)
        # One timer for the earliest row: when it expires, all rows that are ready are taken, and the next waiting one gets a timer.
        self.handle.registerTimer(min(r[0] for r in came))
        return iter(())

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        # Plain objects, whatever pandas takes strings for; the schema has their types.
        return pd.DataFrame(rows, columns=self.OUTPUT, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        *state, seen = self.kept.get() if self.kept.exists() else (None, 0)
        state = tuple(state) if state != [None] else None
        out: list[tuple] = []
        for ms, i, value in ready:
            if state is not None and ms >= seen + self.idle_ms:
                out += self.idle(key[0], state, ms)[1]
                state = None
            state, told = self.step(key[0], state, ms, i, value)
            out += told
            seen = ms
        state, told = self.idle(key[0], state, now)
        out += told
        if ready:
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(later[0][0])
            else:
                self.waiting.clear()
        if state is None or (not later and now >= seen + self.idle_ms):
            self.kept.clear()
        else:
            self.kept.update((*state, seen))
            if ready:
                self.handle.registerTimer(seen + self.idle_ms)
                if wake := self.wake(state):
                    self.handle.registerTimer(wake)
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass

    def idle(self, key, state, now: int) -> tuple[tuple | None, list[tuple]]:
        return state, []

    def wake(self, state) -> int:
        """When idle() is to be asked again if no row comes before; 0 for never."""
        return 0


class _Retries(_InOrder):
    SCHEMA, VALUE = "n long, due long", "boolean"
    OUTPUT = ["op", "id", "ms", "kind", "attempt", "delay_s", "may_retry"]

    def __init__(self, idle_ms: int, base: int, cap: int, most: int):
        super().__init__(idle_ms)
        self.base, self.cap, self.most = base, cap, most

    def _due(self, op, state, now: int) -> tuple[tuple | None, list[tuple]]:
        if state is None or not state[1] or state[1] > now:
            return state, []
        n, due = state
        return (n, 0), [(op, None, due, "due", n, 0.0, True)]

    def step(self, op, state, ms: int, i: str, ok: bool):
        state, told = self._due(op, state, ms)
        if ok:
            return None, [*told, (op, i, ms, "success", 0, 0.0, False)]
        n = (state[0] if state else 0) + 1
        delay = float(min(self.base * 2 ** min(n, 40), self.cap))
        due = ms + int(delay * 1000) if n < self.most else 0
        return (n, due), [*told, (op, i, ms, "attempt", n, delay, n < self.most)]

    idle = _due

    def wake(self, state) -> int:
        return state[1]


def retry_timers(attempts: DataFrame, late: str = "10 minutes", base: int = 60, cap: int = 3600, most: int = 3, idle: int = 30 * 86_400) -> DataFrame:
    """op, id, ts, kind, attempt, delay_s, may_retry of a stream (op, id, ok, ts).

    A failure is an ``attempt``, numbered since the last success, with the delay until the next may follow; a ``due`` row
    comes when that delay is over and nothing has come in between; a ``success`` clears the count. All in order of (ts, id).
    """
    rows = attempts.withWatermark("ts", late).select("op", F.col("id").cast("string").alias("id"), F.col("ok").alias("value"), "ts", F.unix_millis("ts").alias("ms"))
    kind = attempts.schema["op"].dataType.simpleString()
    schema = f"op {kind}, id string, ms long, kind string, attempt long, delay_s double, may_retry boolean"
    got = rows.groupBy("op").transformWithStateInPandas(_Retries(idle * 1000, base, cap, most), schema, "Append", "EventTime")
    return got.select("op", "id", F.timestamp_millis("ms").alias("ts"), "kind", "attempt", "delay_s", "may_retry")


class _Changes(_InOrder):
    SCHEMA, VALUE = "fingerprint string, since long", "string"
    OUTPUT = ["url", "id", "ms", "status", "fingerprint"]

    def step(self, url, state, ms: int, i: str, fingerprint: str):
        if not fingerprint:  # a failed fetch keeps what is known
            return state, [(url, i, ms, "failed", state[0] if state else "")]
        status = "new" if state is None else "unchanged" if state[0] == fingerprint else "changed"
        return (fingerprint, state[1] if status == "unchanged" else ms), [(url, i, ms, status, fingerprint)]


def change_states(fetches: DataFrame, late: str = "10 minutes", idle: int = 365 * 86_400) -> DataFrame:
    """url, id, ts, status (new, changed, unchanged, failed), fingerprint of a stream (url, id, fingerprint, ts), in order of (ts, id).

    A URL that has not been fetched for ``idle`` seconds is new again.
    """
    rows = fetches.withWatermark("ts", late).select("url", F.col("id").cast("string").alias("id"), F.coalesce("fingerprint", F.lit("")).alias("value"), "ts", F.unix_millis("ts").alias("ms"))
    got = rows.groupBy("url").transformWithStateInPandas(_Changes(idle * 1000), "url string, id string, ms long, status string, fingerprint string", "Append", "EventTime")
    return got.select("url", "id", F.timestamp_millis("ms").alias("ts"), "status", "fingerprint")
