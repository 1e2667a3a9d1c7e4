"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, release

SALTS = 32


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns a, b (of one type with an order) of undirected edges -> node, comp (its component's smallest node).

    Neither step gathers the neighbours of a node: the smallest is a plain
    aggregate, and a hub's edges meet it again by (hub, salt), for the salts in use.
    Only the edge count and a checksum reach the driver. Nodes without an edge
    to another node are not returned.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        both = both.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        smallest = both.groupBy("u", "s").agg(F.min("v").alias("m")).groupBy("u").agg(F.least(F.first("u"), F.min("m")).alias("m"), F.bit_or(F.expr("shiftleft(1L, s)")).alias("mask"))
        used = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s)) != 0)
        large = both.join(smallest.select("u", "m", F.explode(used).alias("s")), ["u", "s"]).where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        before, e = e, cut(moved.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct())
        release(before)
        if (now := _state(e)) == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("comp"))).distinct()
