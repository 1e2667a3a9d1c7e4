"""Best-fit packing of documents into token sequences, in bulk-synchronous steps.

Documents are encoded, ended by one token and, where they pass the capacity, cut
into whole pieces of it (the first may be shorter). Pieces and the gaps of open
sequences are kept sorted by size, as runs: pieces of one size are
interchangeable, and so are gaps of one room. Steps go down the sizes; in each

1. all pieces of a size, wherever they are, look for their successor: the run of
   gaps with the least room that holds one. A gap takes as many as it has room for,
   since what is left of it is the best fit for the next;
2. pieces that want the same gap are told apart by rank: the r-th piece of its
   size goes to the gap at the place that r has in the run;
3. the gaps are updated; pieces without a gap go on to the next larger room, and
   after the last open new sequences.

This is best-fit decreasing, exactly. Ranks are counted by executors, block by block,
and each piece finds its sequence and offset from size and rank alone. Only the
sweep over the runs is on the driver: it gets one count per size, so at most
``capacity`` numbers whatever the corpus, and makes a table of moves that travels
to the tasks. A sequence holds at most sqrt(2 capacity) different sizes and there are at most
3 runs a size, so that table has under 6 capacity sqrt(2 capacity) rows: 12 MB for
1,024 tokens, if every bound were met at once.

Pieces cross the network once, as a few numbers, after a checkpoint that
spares the encoding from being run again. Blocks are cut by counts, so a size that a third of
all pieces have is ranked in many tasks.

Defined results: null text counts as empty, which is the end token alone; repeated
rows and ids, null ids among them, are packed row by row; texts of any length are
encoded whole; an empty table gives no rows; other columns, whatever their names,
play no part. Reruns may deal out equal pieces in another order.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.bpe import loaded
from quern.llm.common import cut, pieces_by_size

#: Most rows of a block that is ranked by one task.
BLOCK = 250_000
#: Rows that leave the encoder at once.
ROWS = 4096


def cut_points(n: int, capacity: int) -> list[int]:
    """Where the pieces of n tokens begin: as few as can be, only the first shorter than the capacity."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def encoded_pieces(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32, task and nth (which place a row), and on request ids (array<int>)."""
    fields = [("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("task", "int"), ("nth", "long")] + [("ids", "array<int>")] * with_ids
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, nth = loaded(path), TaskContext.get().partitionId(), 0
        last = np.array([end], "<u4").tobytes()

        def written(rows: list[tuple], names: pa.Array) -> pa.RecordBatch:
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows))[1:], types)]
            return pa.RecordBatch.from_arrays([names.take(at), *columns], ["id", *(n for n, _ in fields)])

        for part in pieces_by_size(batches, "text"):  # many new words at once are encoded faster
            rows: list[tuple] = []
            for k, ids in enumerate(bpe.encode_batch([t or "" for t in part.column("text").to_pylist()])):
                ids += last
                starts = cut_points(len(ids) // 4, capacity)
                for p, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(ids) // 4])):
                    own = ids[lo * 4 : hi * 4]
                    rows.append((k, p, lo, hi - lo, crc32(own), task, nth) + ((np.frombuffer(own, "<i4"),) if with_ids else ()))
                    nth += 1
                    if len(rows) == ROWS:
                        yield written(rows, part.column("id"))
                        rows = []
            if rows:
                yield written(rows, part.column("id"))

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in fields))


#: Moves: pieces of a size from a rank on go to sequences from a number on, so many to each, at an offset.
MOVE = np.dtype([("size", "i8"), ("rank", "i8"), ("sequence", "i8"), ("each", "i8"), ("offset", "i8")])


def sweep(counts: dict[int, int], capacity: int) -> np.ndarray:
    """The moves for so many pieces of each size, sorted by size and rank."""
    moves: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # in use, sorted
    runs: dict[int, deque[tuple[int, int]]] = {}  # by room: (first sequence, how many)
    opened = 0

    def leave(room: int, first: int, n: int, in_front: bool = False) -> None:
        if n and room:
            if not runs.get(room):
                runs[room] = deque()
                insort(rooms, room)
            (runs[room].appendleft if in_front else runs[room].append)((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].popleft()
                if not runs[room]:
                    del rooms[at]
            else:
                room, first, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            each = room // size
            full = min(n, left // each)
            if full:
                moves.append((size, rank, first, each, capacity - room))
                leave(room - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            rest = n - full
            if rest and left:  # fewer than a gap holds
                moves.append((size, rank, first + full, left, capacity - room))
                leave(room - left * size, first + full, 1)
                rank, left, full, rest = rank + left, 0, full + 1, rest - 1
            leave(room, first + full, rest, True)
    return np.array(sorted(moves), MOVE)


def places(moves: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by size and rank."""
    shift = np.int64(1 << 44)
    at = np.searchsorted(moves["size"] * shift + moves["rank"], size * shift + rank, "right") - 1
    m = moves[at]
    place, within = np.divmod(rank - m["rank"], m["each"])
    return m["sequence"] + place, m["offset"] + within * size


def ranked(rows: DataFrame, counts: dict[int, int], block: int = BLOCK) -> DataFrame:
    """Adds rank (from 0 within a size), numbered in blocks of at most about ``block`` rows."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, min(block, sum(counts.values()) // (4 * tasks)))
    blocks = -(-max(counts.values(), default=1) // most)
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("task", "nth"), F.lit(blocks)))
    sizes = keyed.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "block").orderBy("task", "nth")
    return keyed.join(first, ["length", "block"]).withColumn("rank", F.col("first") + F.row_number().over(inside) - 1).drop("block", "first")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: its document's id, piece, start, length, ids_crc32, sequence_id, offset, and on request its ids."""
    rows = cut(encoded_pieces(docs, path, capacity, end, id_col, text_col, with_ids))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    moves = sweep(counts, capacity)
    kept = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    numbered = ranked(rows, counts).select(*kept, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places(moves, batch.column(3).to_numpy(), batch.column(len(kept)).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "rank")
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long").withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, and lengths of the pieces in order, of pack(with_ids=True); a group has at most ``capacity`` tokens."""
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return whole.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths"))
