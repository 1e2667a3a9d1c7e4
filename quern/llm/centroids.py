"""Centroid clustering of integer vectors, exact, with a float32 screen.

Components are integers: floor(scale * x). A round assigns every vector to its
nearest centroid and moves each centroid to the exact floored mean of its vectors.

1. screen: per Arrow batch one float32 matrix product gives |c|^2 - 2 x.c for
   all centroids, with an interval that holds the exact value: the rounding of a
   dot product of n terms is at most n u / (1 - n u) |x| |c| with u = 2^-24, to
   which the rounding of the inputs and of the few operations after it is added;
2. verify: where the lowest interval overlaps no other, its centroid is the
   nearest. Elsewhere the centroids whose intervals overlap it are compared again
   by exact 64-bit integer distances; the lowest number wins a tie.

A task sums its own vectors by centroid, so a round moves one row per task and
centroid, however many vectors are alike; sums and counts of at most ``k``
centroids reach the driver. Rounds end early once no centroid moves, which
changes nothing in the result. The integers are cut once; lost tasks are run
again from there.

Defined results: vectors of another length, or with a null or a component that is
not finite, take no part and have no row; vectors with a null id do, but begin no
centroid unless too few others are left; equal ids and equal vectors are rows of
their own, ordered by their components where they compete for a start; with fewer
vectors than ``k`` each begins a centroid; an empty table gives no rows. A
component outside +-``LARGEST`` is an error, since distances would leave 64 bits.
Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import cut, pieces

#: |component|; 2^20 components as far apart as that still have a distance under 2^63.
LARGEST = 1 << 20
_U = 2.0**-24


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = 1024) -> DataFrame:
    """id, v (array<int>): the vectors that take part."""
    x = F.col(f"`{vector}`").cast("array<double>")
    good = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c * scale))
    small = F.forall(F.transform(x, lambda c: F.abs(c * scale)), lambda c: c <= LARGEST)
    checked = F.when(small, whole.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is outside +-{LARGEST}")).cast("array<int>"))
    return rows.where(F.coalesce(good, F.lit(False))).select(F.col(f"`{id_col}`").alias("id"), checked.alias("v"))


def first_centroids(vectors: DataFrame, k: int = 8, seed: str = "3") -> np.ndarray:
    """The vectors of the k smallest SHA-256 of ``seed:id``, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    got = vectors.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in got], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """For rows of int64 components the nearest centroid, lowest number first; and how many rows were compared exactly."""
    n, dim = x.shape
    if not n:
        return np.zeros(0, np.int64), 0
    c2 = (centroids * centroids).sum(1)
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    c_norms = np.sqrt(c2.astype(np.float64)) * (1 + 1e-9)
    dots = x.astype(np.float32) @ centroids.astype(np.float32).T
    # Terms of the product, and two more roundings for inputs that float32 has no place for.
    gamma = (dim + 2) * _U / (1 - (dim + 2) * _U)
    # From here on float64, whose own rounding is far below the slack of one part in 10^6 and one unit.
    near = c2[None, :] - 2.0 * dots.astype(np.float64)
    wide = 2.0 * gamma * norms[:, None] * c_norms[None, :] * (1 + 1e-6) + 1.0
    best = near.argmin(1)
    rows = np.arange(n)
    limit = near[rows, best] + wide[rows, best]
    open_ = (near - wide) <= limit[:, None]
    again = np.flatnonzero(open_.sum(1) > 1)
    if len(again):
        row, c = np.nonzero(open_[again])
        apart = x[again[row]] - centroids[c]
        exact = np.full((len(again), len(centroids)), np.iinfo(np.int64).max)
        exact[row, c] = (apart * apart).sum(1)
        best[again] = exact.argmin(1)
    return best, len(again)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _partial_sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: cluster, n, sums of the components, and inertia."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in pieces(batches, 8192):
            x = _matrix(batch.column(0), dim)
            at, _ = nearest(x, centroids)
            n += np.bincount(at, minlength=k)
            for c in np.unique(at):
                own = x[at == c]
                sums[c] += own.sum(0)
                inertia[c] += ((own - centroids[c]) ** 2).sum()
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64())), pa.array(inertia[used])], ["cluster", "n", "sums", "inertia"])

    return run


def _gathered(vectors: DataFrame, centroids: np.ndarray) -> tuple[dict[int, tuple[int, list[int]]], dict[int, int]]:
    """count and sums, and inertia, of each cluster in use."""
    parts = vectors.select("v").mapInArrow(_partial_sums(centroids), "cluster int, n long, sums array<long>, inertia long")
    dim = centroids.shape[1]
    wide = T.DecimalType(38, 0)  # sums of all tasks may leave 64 bits
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("inertia").cast(wide)).alias("inertia"), *[F.sum(F.col("sums")[d].cast(wide)).alias(f"s{d}") for d in range(dim)])
    rows = total.collect()  # one row a centroid
    return {r["cluster"]: (int(r["n"]), [int(r[f"s{d}"]) for d in range(dim)]) for r in rows}, {r["cluster"]: int(r["inertia"]) for r in rows}


def fit(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3") -> np.ndarray:
    """The centroids after ``rounds`` rounds over (id, v)."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for c, (n, sums) in _gathered(vectors, centroids)[0].items():
            moved[c] = [s // n for s in sums]
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance (squared) of (id, v)."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8192):
            x = _matrix(batch.column(1), dim)
            at, _ = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(((x - centroids[at]) ** 2).sum(1))], ["id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long")


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """One row per vector that takes part: its id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    vectors = cut(integer_vectors(rows, id_col, vector, dim, scale))
    centroids = fit(vectors, k, rounds, seed)
    if not len(centroids):
        out = vectors.select("id", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
        return out.withColumnRenamed("id", id_col)
    inertia = _gathered(vectors, centroids)[1]
    told: Callable[[dict], Column] = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("cluster")]
    return assign(vectors, centroids).select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        told(inertia).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        told({c: centroid_digest(centroids[c]) for c in inertia}).alias("centroid_sha256"),
    )
