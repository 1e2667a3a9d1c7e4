"""A stored vector index: coarse lists as partitions, pruned by angle, scored exactly.

``vectors/list=N`` holds every row with its list: the nearest of some directions that
spherical k-means found on a bounded sample. Rows of a long list are dealt to slices by their
count, so that no group holds more than about ``SLICE`` of them, however many rows are alike.
``lists`` has for each list its direction, its slices and its radius, the widest angle of a row to it.

``fit`` has how many lists a search should read. It reads the nearest of its queries. With ``exact`` it then reads every other list whose
radius leaves room for a better row than the k-th found, so that nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.retrieval import _NOWHERE, _best, _matrix, dense_topk, ranked

#: Rows of a slice, and queries that meet it at once; rows of either that are compared at once.
SLICE, QUERIES, ROWS = 16_384, 10_000, 2048
#: Most lists: their directions travel to the tasks (at 384 dimensions 12 MB).
MAX_LISTS = 4096


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows: what is made of a row is as long as there are lists."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def directions(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit vectors that spherical k-means finds on the sample."""
    x = np.unique(_unit(sample), axis=0)
    x = x[(x != 0).any(1)]
    if not len(x):
        return np.zeros((1, sample.shape[1]))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        at = np.concatenate([(x[lo : lo + 512] @ c.T).argmax(1) for lo in range(0, len(x), 512)])
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        used = (sums != 0).any(1)
        c[used] = _unit(sums[used])
    return c


def _probes_for(recall: float, queries: np.ndarray, lists: np.ndarray, c: np.ndarray) -> int:
    """The fewest nearest lists that hold such a share of the neighbours, which are in ``lists``."""
    cosine = _unit(queries) @ c.T
    before = (cosine > cosine[np.arange(len(lists)), lists][:, None]).sum(1)
    return int(np.sort(before)[min(len(before) - 1, int(np.ceil(recall * len(before))) - 1)]) + 1


def write_vectors(corpus: DataFrame, path: str, chunk_id: str = "chunk_id", vector: str = "embedding", lists: int | None = None, sample: int = 20_000, per_slice: int = SLICE, recall: float = 0.95, k: int = 10, asked: int = 256) -> None:
    """Writes the index of (chunk_id, vector) to a new path; rows without an id or a vector are left out.

    The lists (about the root of the rows, if not given) are fitted on at most about ``sample`` rows, which a
    hash of the id draws; every row is indexed. How many lists a search reads is measured: at most ``asked``
    drawn rows are searched for exactly, and as many lists are read as hold ``recall`` of their k neighbours.
    """
    rows = corpus.select(F.col(chunk_id).alias("chunk_id"), F.col(vector).cast("array<double>").alias("v")).where("chunk_id is not null and v is not null")
    n = rows.count()
    lists = min(lists or max(1, round(n**0.5)), MAX_LISTS)
    share = min(1.0, sample / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").limit(2 * sample).toArrow()
    c = directions(_matrix(drawn.column("v").combine_chunks()), lists) if drawn.num_rows else np.zeros((1, 1))
    kind = rows.schema["chunk_id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            if batch.num_rows:
                cosine = _unit(_matrix(batch.column(1))) @ c.T
                at = cosine.argmax(1)
                # A vector without a direction is at any angle.
                angle = np.where((_matrix(batch.column(1)) != 0).any(1), np.arccos(np.clip(cosine[np.arange(len(at)), at], -1, 1)), np.pi)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(angle)], ["chunk_id", "v", "list", "angle"])

    placed = rows.mapInArrow(assign, f"chunk_id {kind}, v array<double>, list int, angle double")
    counts = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()  # a row a list
    spark = corpus.sparkSession
    table = [(r["list"], c[r["list"]].tolist(), int(-(-r["n"] // per_slice)), float(r["radius"]), r["n"]) for r in counts]
    spark.createDataFrame(table, "list int, direction array<double>, slices int, radius double, n long").coalesce(1).write.parquet(f"{path}/lists")
    slices = F.element_at(F.create_map(*[F.lit(x) for r in table for x in (r[0], r[2])]), F.col("list")) if table else F.lit(1)
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("chunk_id"), slices).cast("int"))
    few = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < int(min(1.0, asked / max(1, n)) * (1 << 20)) + 1).limit(asked).select(F.col("chunk_id").alias("query_id"), "v")
    near = dense_topk(few, rows, k + 1, vector="v").where("query_id <> chunk_id").select("query_id", "chunk_id")
    kept = placed.join(F.broadcast(near.select("chunk_id").distinct()), "chunk_id", "left_semi").select("chunk_id", "list")
    pairs = near.join(kept, "chunk_id").join(few, "query_id").select("v", "list").toArrow()  # at most asked x k
    probes = _probes_for(recall, _matrix(pairs.column("v").combine_chunks()), pairs.column("list").to_numpy(), c) if pairs.num_rows else 1
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.parquet(f"{path}/fit")
    placed.repartition("list", "slice").sortWithinPartitions("list", "slice").select("chunk_id", "v", "slice", "list").write.partitionBy("list").parquet(f"{path}/vectors")


def _found(k: int):
    """For the rows of a slice and the queries that read it: the best k of each query."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        names = rows.column("chunk_id").combine_chunks().dictionary_encode() if rows.num_rows else None
        if names is not None and queries.num_rows:
            order = np.empty(len(names.dictionary), np.int64)
            order[np.argsort(names.dictionary.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(order))
            place = order[names.indices.to_numpy()]
            named = names.dictionary.take(pa.array(np.argsort(order)))
            c, q = _matrix(rows.column("v").combine_chunks()), _matrix(queries.column("v").combine_chunks())
            if c.shape[1] != q.shape[1]:
                raise ValueError(f"queries have {q.shape[1]} dimensions, rows {c.shape[1]}")
            c_norm, q_norm = np.sqrt((c * c).sum(1)), np.sqrt((q * q).sum(1))
            ids = queries.column("query_id").combine_chunks()
            for lo in range(0, len(q), 256):
                part = slice(lo, lo + 256)
                n = len(q[part])
                best, at = np.full((n, k), -np.inf), np.full((n, k), _NOWHERE)
                for row in range(0, len(c), ROWS):
                    some = slice(row, row + ROWS)
                    s = np.round(q[part] @ c[some].T / (q_norm[part, None] * c_norm[None, some] + 1e-8), 12)
                    best, at = _best(np.hstack([best, s]), np.hstack([at, np.broadcast_to(place[some], s.shape)]), k)
                row, col = np.nonzero(best > -np.inf)
                out.append(pa.table([ids.take(pa.array(row + lo)), named.take(pa.array(at[row, col])), pa.array(best[row, col])], ["query_id", "chunk_id", "score"]))
        if out:
            return pa.concat_tables(out)
        return pa.table([pa.array([], queries.schema.field("query_id").type), pa.array([], rows.schema.field("chunk_id").type), pa.array([], pa.float64())], ["query_id", "chunk_id", "score"])

    return run


def search_vectors(queries: DataFrame, path: str, k: int = 10, query_id: str = "query_id", vector: str = "embedding", probes: int | None = None, exact: bool = False) -> DataFrame:
    """query_id, chunk_id, score (cosine), rank from the stored index, scored as dense_topk scores.

    Each query reads its ``probes`` nearest lists (as many as the index was measured to need); with ``exact`` also any other that may hold one of its best k.
    Queries are dealt to groups with the slices of their lists, about ``QUERIES`` a group, so neither side is
    bounded by a task or the driver. Queries without a vector find nothing.
    """
    spark = queries.sparkSession
    known = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
    asked = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    kind = asked.schema["query_id"].dataType.simpleString()
    if not known:
        return ranked(spark.createDataFrame([], f"query_id {kind}, chunk_id string, score double"), k)
    number = np.array([r["list"] for r in known], np.int32)
    c, radius = np.array([r["direction"] for r in known]), np.array([r["radius"] for r in known])
    near = min(probes or spark.read.parquet(f"{path}/fit").first()["probes"], len(known))

    def lists_of(least: bool):
        """The nearest lists, or with the k-th score as third column all further ones that may have a better row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, 512):
                if not batch.num_rows:
                    continue
                q = _matrix(batch.column(1))
                cosine = np.clip(_unit(q) @ c.T, -1, 1)
                order = np.argsort(-cosine, axis=1, kind="stable")
                nearest = np.zeros(cosine.shape, bool)
                np.put_along_axis(nearest, order[:, :near], True, 1)
                if least:
                    bound = np.cos(np.maximum(0, np.arccos(cosine) - radius[None, :]))
                    bound[(q == 0).all(1)] = 0
                    floor = batch.column(2).fill_null(-2.0).to_numpy()
                    nearest = ~nearest & (bound >= floor[:, None] - 1e-9)
                row, col = np.nonzero(nearest)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(number[col])], ["query_id", "v", "list"])

        return run

    vectors = spark.read.parquet(f"{path}/vectors")
    name = vectors.schema["chunk_id"].dataType.simpleString()
    slices = spark.createDataFrame([(r["list"], r["slices"]) for r in known], "list int, slices int")

    def read(wanted: DataFrame) -> DataFrame:
        size = wanted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a list
        deals = max(1, -(-max((r["n"] for r in size), default=0) // QUERIES))
        spread = wanted.join(F.broadcast(slices), "list").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("deal", F.pmod(F.xxhash64("query_id"), F.lit(deals)))
        rows = vectors.where(F.col("list").isin([r["list"] for r in size])).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
        return rows.groupBy("list", "slice", "deal").cogroup(spread.groupBy("list", "slice", "deal")).applyInArrow(_found(k), f"query_id {kind}, chunk_id {name}, score double")

    first = ranked(read(asked.mapInArrow(lists_of(False), f"query_id {kind}, v array<double>, list int")), k)
    if not exact:
        return first
    kth = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = asked.join(kth, "query_id", "left").select("query_id", "v", "kth").mapInArrow(lists_of(True), f"query_id {kind}, v array<double>, list int")
    return ranked(first.drop("rank").unionByName(read(rest)), k)
