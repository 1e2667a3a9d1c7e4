"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies, target over
source size. Within a source, documents are put in a fixed order; a document
gets as many copies as there are integers between the prefix sums of expected
copies before and after it, both moved by one random offset per source. The
order runs by size class first, so the words taken stay close to the target.

The prefix sums are two-level, so a source that holds a third of all rows is
not one task: rows are counted per (source, size class, block of the id's hash),
at most 280 x ``blocks`` rows per source; a running sum over those counts gives each block
its first rank, and row_number() numbers the rows of one block.

Targets: ``share`` of all sizes is dealt out by weight; no source's target
passes ``max_copies`` times its size, and the excess goes to the others by
weight until none is above. That is min(cap, level x weight) with one common
level, found by one pass over the sources in order of cap / weight. The tables
of sources and blocks hold no row per document.

Defined results: null text has size 0; a null source is a source of its own,
last in order; null ids are ordered first in their block; rows that are equal
in (source, size, id) are interchangeable. A source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD_PATTERN, cut

WEIGHTS = (3, 1, 2)


def size_class(size: str) -> Column:
    """Length in bits and the two bits after the first: classes a quarter apart."""
    return F.expr(f"length(bin({size})) * 4 + (shiftright({size}, greatest(length(bin({size})) - 3, 0)) & 3)").cast("int")


#: Rows that a block, which one task numbers, has at most if all of them are in one source and size class.
BLOCK_ROWS = 100_000


def unit(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, bits: int) -> DataFrame:
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.when(F.col(f"`{source_col}`").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(f"`{source_col}`").cast("string"))).alias("src"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))).alias("h"),
    ).select("*", size_class("size").alias("cls"), F.shiftrightunsigned(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), 32 - bits).alias("block"))


def targets(sizes: DataFrame, share: float = 1.5, max_copies: int = 2, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """src, source_size -> src, source_size, target. One row per source in and out."""
    everything = Window.partitionBy()
    nth = F.row_number().over(Window.orderBy("src")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("nth", nth).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    before = Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level).withColumn("free", F.col("cap") / F.col("w") > F.col("level"))
    # Levels rise as long as sources are capped; the first free source has the common level.
    common = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "src", "level"))).over(everything)["level"]
    return levels.withColumn("common", common).select("src", "source_size", F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("common") * F.col("w"))).alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", share: float = 1.5, max_copies: int = 2, weights: tuple[float, ...] = WEIGHTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """row (struct of all columns), id, size, source_size, target, copies.

    The order within a source is (size class, hash, id). Blocks are cut from it by the
    hash's leading bits, as many as the number of rows asks for, so their number
    changes no result, and no block has more than about ``block_rows``.
    """
    bits = min(32, max(8, (docs.count() // block_rows).bit_length()))
    rows = _prepared(docs, id_col, text_col, source_col, seed, bits)
    # Used twice below; cut, so that texts are read for it once.
    counts = cut(rows.groupBy("src", "cls", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    sizes = counts.groupBy("src").agg(F.sum("words").alias("source_size"))
    order = Window.partitionBy("src").orderBy("cls", "block").rowsBetween(Window.unboundedPreceding, -1)
    plan = counts.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0))).select("src", "cls", "block", "first").join(targets(sizes, share, max_copies, weights), "src")
    plan = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).withColumn("offset", unit(F.concat(F.lit(f"{seed}:"), F.col("src"))))
    keys = ["src", "cls", "block"]
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "id")))
    rank = F.col("first") + F.col("nth")
    copies = F.floor(F.col("offset") + F.col("rate") * rank) - F.floor(F.col("offset") + F.col("rate") * (rank - 1))
    return numbered.join(plan, keys).select("row", "id", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken."""
    out = mixed(docs, id_col, **options)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with all its columns."""
    return mixed(docs, id_col, **options).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
