"""Packing against the tokenizer library, the stated rules and a loop of best-fit decreasing."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from quern.llm import common
from quern.llm import packing as pk

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(sizes, capacity):
    """Rooms left, one piece at a time."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(rooms, s)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - s)
    return Counter(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_sweep_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([5, 16, 64, 1024])
    sizes = [min(capacity, max(1, int(rnd.choice([rnd.expovariate(4 / capacity), rnd.randint(1, capacity), capacity // 3, 1])))) for _ in range(rnd.choice([0, 1, 7, 500, 3000]))]
    counts = Counter(sizes)
    moves = pk.sweep(counts, capacity)
    size = np.array(sorted(sizes), np.int64)
    rank = np.array([k for s in sorted(counts) for k in range(counts[s])], np.int64)
    if not sizes:
        assert not len(moves)
        return
    sequence, offset = pk.places(moves, size, rank)
    packed = defaultdict(list)
    for row in zip(sequence.tolist(), offset.tolist(), size.tolist()):
        packed[row[0]].append(row[1:])
    rooms = Counter()
    for own in packed.values():
        at = 0
        for o, s in sorted(own):
            assert o == at
            at += s
        assert at <= capacity
        rooms[capacity - at] += 1
    assert rooms == best_fit(sizes, capacity)
    assert len(moves) < 6 * capacity * (2 * capacity) ** 0.5


def test_moves_do_not_grow_with_the_corpus():
    rnd = random.Random(3)
    counts = {s: rnd.randint(10**8, 10**9) for s in range(1, 1025)}
    moves = pk.sweep(counts, 1024)
    assert len(moves) < 30_000
    total = sum(s * n for s, n in counts.items())
    assert pk.places(moves, np.array([1], np.int64), np.array([counts[1] - 1], np.int64))[0][0] < total / 1024 * 1.001


def test_pieces_and_sequences(spark):
    word = "the quick brown fox "
    rows = [(1, word * 40), (2, None), (3, ""), (4, word * 900), (4, word * 900), (None, "x <|endoftext|> y"), (None, word * 256), (5, "é" * 5000)] + [(k, "same text here") for k in range(10, 150)]
    clashing = {c: F.lit(c) for c in ("id", "rank", "length", "block", "task", "nth")}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clashing).repartition(3)
    packed = pk.pack(df, PATH, with_ids=True)
    got = packed.collect()
    lib = tokenizers.Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        for p, lo in enumerate([0, *range(first, len(ids), 1024)]):
            own = ids[lo : first if not p else lo + 1024]
            want[doc, p, lo, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(by) == best_fit([r["length"] for r in got], 1024).total()
    texts = {r["sequence_id"]: r for r in pk.sequences(packed).collect()}
    for s, r in texts.items():
        assert r["ids"] == [i for p in sorted(by[s], key=lambda r: r["offset"]) for i in p["ids"]] and sum(r["lengths"]) == len(r["ids"])
    assert pk.pack(df.limit(0), PATH).collect() == []


def test_ranks_of_a_hot_size(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 1).cast("long").alias("length"), F.spark_partition_id().alias("task"), F.col("id").alias("nth"))
    counts = {r["length"]: r["count"] for r in df.groupBy("length").count().collect()}
    got = pk.ranked(df, counts, block=100).collect()
    ranks = defaultdict(list)
    for r in got:
        ranks[r["length"]].append(r["rank"])
    assert {s: len(r) for s, r in ranks.items()} == counts and all(sorted(r) == list(range(len(r))) for r in ranks.values())


def test_slices_by_size():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n >= 0 else None for n in (3, 4, -1, 50, 0, 0, 9, 2)])], ["t"])
    got = [p.column(0).to_pylist() for p in common.pieces_by_size([batch, batch.slice(0, 0)], "t", 10)]
    assert [[len(x or "") for x in p] for p in got] == [[3, 4, 0], [50], [0, 0, 9], [2]] and sum(got, []) == batch.column(0).to_pylist()
