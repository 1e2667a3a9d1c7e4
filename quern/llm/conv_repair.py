"""Repair of a conversation's structure by error-correcting Earley parsing.

The grammar derives ``(system? (user assistant)+)?``. Its rules are left recursive
over what has been said so far, so that chart items begin at the start of the
conversation; each role symbol has error productions beside the row that it
stands for: another row (rerole), nothing (insert), and ``gone`` is a row that is
left out (delete). An item keeps the least (cost, audit): costs add up, the
letters of the edits are joined, and among equal costs the ASCII-least letters
stay. (Of two audits of one item and cost none begins with the other, since the
letters tell the cost; so the least whole is made of least parts.) The completed
chart's audit, applied to the rows, is the repair.

Rows of a conversation are streamed in order through a task after one exchange by
conversation, in which they are sorted by disk where they don't fit. A column of the
chart has a few dozen items, and only two columns are kept. What the audits of all
live items begin with is decided: those rows are written, and forgotten. An item
dearer than the cheapest by more than ``SLACK`` is dropped, exactly: whatever
follows it, the cheapest item can follow, too, after inserting a user and an
assistant (10) and deleting a kept system row (2). Conversations of a few rows with the
same faults and roles share one parse. A conversation is read by one task, however
long it is, as its digest needs; memory does not grow with it.

Defined results: null role and text count as one space; rows are ordered by
(turn, role, text), nulls first; a null conversation id is a conversation; equal
rows and ids are rows; texts of any length are kept whole; a conversation of
absent rows only has zeros, no audit and the digest of nothing; an empty table
gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import pieces

#: White space of the contract, for trim().
_BLANKS = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
SLACK = 12

#: What a nonterminal may be.
GRAMMAR: dict[str, tuple[tuple[str, ...], ...]] = {
    "talk": (("start",), ("answered",)),
    "start": ((), ("start", "gone")),
    "opened": (("start", "system"), ("opened", "gone")),
    "asked": (("start", "user"), ("opened", "user"), ("answered", "user"), ("asked", "gone")),
    "answered": (("asked", "assistant"), ("answered", "gone")),
}
#: What a symbol may be: (initial of the row's role or * for any row or nothing, cost, letter).
SYMBOLS: dict[str, tuple[tuple[str, int, str], ...]] = {
    "gone": (("*", DELETE, "D"),),
    "system": (("s", KEEP, "K"),),
    "user": (("u", KEEP, "K"), ("*", REROLE, "R"), ("", INSERT, "I")),
    "assistant": (("a", KEEP, "K"), ("*", REROLE, "R"), ("", INSERT, "I")),
}

Value = tuple[int, str]


def _plus(a: Value, b: Value) -> Value:
    return a[0] + b[0], a[1] + b[1]


class Chart:
    """Earley's chart over the rows scanned so far.

    An item is (nonterminal, rule, dot, origin); one whose dot is at the end stands
    as (nonterminal, None, 0, origin). ``open`` has the items of a column by the symbol
    after their dot.
    """

    def __init__(self):
        self.now, self.open = 0, {}
        self._column([(("talk", rule, 0, 0), (0, "")) for rule in GRAMMAR["talk"]])

    def scan(self, row: str) -> None:
        """A row: s, u, a or o (the role), a capital if it is cut off, x if it must go."""
        found = []
        for symbol in self.open[self.now]:
            for initial, cost, letter in SYMBOLS.get(symbol, ()):
                if letter == "D":
                    found.append(((symbol, None, 0, self.now), (cost, letter)))
                elif row != "x" and initial in ("*", row.lower()):
                    found.append(((symbol, None, 0, self.now), (cost + CUT_OFF * row.isupper(), letter)))
        self.now += 1
        self._column(found)
        for column in [c for c in self.open if 0 < c < self.now]:
            del self.open[column]

    def _column(self, seeds: list[tuple[tuple, Value]]) -> None:
        best: dict[tuple, Value] = {}
        heap: list = []
        self.open[self.now] = here = {}
        cheapest = None

        def add(item: tuple, value: Value) -> None:
            if item not in best or value < best[item]:
                best[item] = value
                heapq.heappush(heap, (value, item[0], item[1] or (), item[2], item[3], item))

        for item, value in seeds:
            add(item, value)
        while heap:
            value, *_, item = heapq.heappop(heap)
            if best[item] != value:
                continue
            name, rule, dot, origin = item
            if not origin:
                cheapest = value[0] if cheapest is None else cheapest
                if value[0] > cheapest + SLACK:
                    continue
            if rule is None:  # complete
                for parent, before in list(self.open[origin].get(name, {}).items()):
                    add(self._next(parent), _plus(before, value))
                continue
            if dot == len(rule):
                add((name, None, 0, origin), value)
                continue
            symbol = rule[dot]
            if symbol not in here:  # predict
                here[symbol] = {}
                for body in GRAMMAR.get(symbol, ()):
                    add((symbol, body, 0, self.now), (0, ""))
                for initial, cost, letter in SYMBOLS.get(symbol, ()):
                    if not initial:
                        add((symbol, None, 0, self.now), (cost, letter))
            here[symbol][item] = value
            if (done := (symbol, None, 0, self.now)) in best:
                add(self._next(item), _plus(value, best[done]))
        self.best = best

    @staticmethod
    def _next(item: tuple) -> tuple:
        name, rule, dot, origin = item
        return (name, rule, dot + 1, origin) if dot + 1 < len(rule) else (name, None, 0, origin)

    def settle(self) -> str:
        """Takes what all audits that may still win begin with out of the chart."""
        live = [(items, item) for items in self.open[self.now].values() for item in items if self.now]
        if not live:
            return ""
        sure = commonprefix([items[item][1] for items, item in live])
        for items, item in [*live, (self.best, ("talk", None, 0, 0))]:
            items[item] = items[item][0], items[item][1][len(sure) :]
        return sure

    def finish(self) -> Value:
        return self.best["talk", None, 0, 0]


@lru_cache(maxsize=1 << 15)
def least_repair(rows: str) -> Value:
    """Cost and audit for a row of symbols as Chart.scan() takes them."""
    chart = Chart()
    for row in rows:
        chart.scan(row)
    return chart.finish()


#: Rows whose parse is shared, and after how many rows of a longer conversation the chart is settled.
SHORT, STEP = 48, 64


class Repair:
    """One conversation, row by row; ``write`` gets the repaired rows in order: role, text, letter."""

    def __init__(self, write: Callable[[str, str, str], None]):
        self.write, self.rows, self.symbols, self.chart = write, [], [], None
        self.audit, self.user_next = [], True
        self.faults, self.illegal, self.role = [0, 0, 0, 0], 0, None
        self.turns, self.first, self.last = 0, None, None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.role is not None and self.role + initial not in ("su", "ua", "au")
        self.role = initial
        if turn is not None and turn != self.last:
            self.turns, self.first, self.last = self.turns + 1, turn if self.first is None else self.first, turn
        symbol = "x" if fault in (1, 2) else initial if initial in ("s", "u", "a") else "o"
        self.symbols.append(symbol.upper() if fault == 3 else symbol)
        self.rows.append((role, text))
        if len(self.symbols) == STEP:
            self._scan()
            self._apply(self.chart.settle())

    def _scan(self) -> None:
        self.chart = self.chart or Chart()
        for symbol in self.symbols:
            self.chart.scan(symbol)
        self.symbols = []

    def _apply(self, letters: str) -> None:
        taken = 0
        for letter in letters:
            role, text = self.rows[taken] if letter != "I" else ("", "")
            taken += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "user" if self.user_next else "assistant"
            self.write(role, text, letter)
            self.user_next = role[:1] != "u"
        del self.rows[:taken]
        self.audit.append(letters)

    def finish(self) -> tuple[int, int, int, int, int, int, str]:
        """gaps, blank, duplicate, truncated, illegal, cost, audit."""
        if self.chart is None and len(self.symbols) <= SHORT:
            cost, letters = least_repair("".join(self.symbols))
        else:
            self._scan()
            cost, letters = self.chart.finish()
        self._apply(letters)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, *self.faults[1:], self.illegal, cost, "".join(self.audit)


def _sorted_rows(turns: DataFrame, absent: Column | None) -> DataFrame:
    """conv_id, ck, turn, role, text, fault, absent, each conversation's rows together and in order."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        "conv_id",
        F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")).alias("ck"),
        F.col("turn").cast("long").alias("turn"),
        said("role").alias("role"),
        said("text").alias("text"),
        (F.lit(False) if absent is None else absent).alias("absent"),
    )
    rows = rows.withColumn("text", F.when(~F.col("absent"), F.col("text")))
    end = F.rtrim("text", F.lit(_BLANKS))
    # The exchange by conversation serves this window, too.
    nth = F.row_number().over(Window.partitionBy("ck", "absent", "role", "text").orderBy("turn"))
    fault = F.when(end == "", 1).when(F.col("nth") > 1, 2).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    numbered = rows.repartition("ck").withColumn("nth", nth)
    return numbered.select("conv_id", "ck", "turn", "role", "text", fault.cast("int").alias("fault"), "absent", "nth").sortWithinPartitions("ck", "turn", "role", "text", "nth").drop("nth")


def _conversations(batches: Iterator[pa.RecordBatch], begin: Callable[[object], Repair]) -> Iterator[tuple[object, Repair]]:
    """(conv_id, Repair) as each conversation ends; begin() makes the next one's Repair."""
    ck, conv_id, now = None, None, None
    for batch in pieces(batches):
        for i, k, turn, role, text, fault, absent in zip(*(c.to_pylist() for c in batch.columns)):
            if k != ck:
                if now is not None:
                    yield conv_id, now
                ck, conv_id, now = k, i, begin(i)
            if not absent:
                now.add(turn, role, text, fault)
    if now is not None:
        yield conv_id, now


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_report(turns: DataFrame, absent: Column | None = None) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): its faults, the cost and audit of its least repair, and the digest of the repaired ``role:text`` lines.

    Rows that are ``absent`` only name their conversation.
    """
    rows = _sorted_rows(turns, absent)
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *(f.split()[0] for f in REPORT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, out, id_type = None, [], None

        def begin(_) -> Repair:
            nonlocal digest
            digest, lead = hashlib.sha256(), ""

            def write(role: str, text: str, letter: str) -> None:
                nonlocal lead
                digest.update(f"{lead}{role}:{text}".encode())
                lead = "\n"

            return Repair(write)

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in source:
                id_type = batch.column(0).type
                yield batch

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for conv_id, now in _conversations(typed(batches), begin):
            out.append((conv_id, *now.finish(), digest.hexdigest()))
            if len(out) == 1024:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, f"conv_id {kind}, {REPORT}")


def repaired_turns(turns: DataFrame, absent: Column | None = None) -> DataFrame:
    """conv_id, turn (0, 1, ...), role, text, edit (K, R or I) of the repaired conversations."""
    rows = _sorted_rows(turns, absent)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            id_type = batch.column(0).type
            break
        else:
            return

        def chained() -> Iterator[pa.RecordBatch]:
            yield batch
            yield from batches

        def begin(conv_id) -> Repair:
            turn = 0

            def write(role: str, text: str, letter: str) -> None:
                nonlocal turn
                out.append((conv_id, turn, role, text, letter))
                turn += 1

            return Repair(write)

        def written() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (id_type, pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "turn", "role", "text", "edit"])
            out.clear()
            return got

        for _, now in _conversations(chained(), begin):
            now.finish()
            if len(out) >= 256:
                yield written()
        if out:
            yield written()

    return rows.mapInArrow(run, f"conv_id {kind}, turn long, role string, text string, edit string")


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """The stated damage by crc32(conv_id:turn) % 20, and which rows are dropped by it.

    0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4
    makes its role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), k.alias("k"))
    hit = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        "k",
        F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy"),
    )
    return hit, F.col("k") == 0
