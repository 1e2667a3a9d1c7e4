"""Exact dedup by skew-safe combining, in DataFrame operations only.

Three stages, each comparing whole normalised texts (they are grouping keys):

1. every map task folds its own copies (the partial aggregate);
2. the partial groups of a digest are merged in up to 64 salted groups, so that
   a text held by a third of all rows is spread over that many tasks;
3. the salt winners - at most 64 rows for a text - are combined into one.

Rows find their group again by (digest, salt), never by a digest alone, so this
join is spread like stage 2. Texts cross the network in stages 2 and 3 only. The
salt is a function of the id, so rows that share one (or have none) share it:
those are folded by the map tasks, too - into counts per (digest, id, part of
the input) for the report, into one row per (digest, salt) where rows are kept.

Defined results: null text counts as empty; a null id sorts last and its group
keeps it only if all ids are null; of rows that repeat the winning id and text
exactly one is kept, the same one in reruns; an empty table gives no rows; texts of any length are
compared whole; columns of any other name are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import SPACE

MAX_SALTS = 64
#: Parts of the input that count an id's rows apart, and rows that one step of writing them out makes.
PARTS, STEP = 64, 4096


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    # A single space stays as it is, so only other spaces and longer runs are replaced.
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{SPACE}]{{2,}}|[\x09-\x0D]", " ")


def digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        normalised(F.col(f"`{text_col}`")).alias("norm"),
        F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(salts)).cast("int").alias("salt"),
    ).withColumn("digest", digest(F.col("norm")))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = MAX_SALTS) -> DataFrame:
    """One row per (digest, salt in use): digest, salt, keep_id, group_size."""
    if not 1 <= salts <= MAX_SALTS:
        raise ValueError(f"salts must be 1 to {MAX_SALTS}")
    salted = _keyed(docs, id_col, text_col, salts).groupBy("digest", "salt", "norm").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    # One exchange by digest serves both the global combine and the collision check.
    winners = salted.repartition("digest").groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask"))
    checked = winners.select("digest", "keep_id", "group_size", "mask", F.count(F.lit(1)).over(Window.partitionBy("digest")).alias("texts"))
    # Different texts under one digest would need the text as a join key below; stop rather than merge them. Who stays depends on
    # this check, so no plan can leave it out.
    sure = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a digest")).cast(checked.schema["keep_id"].dataType)).otherwise(F.col("keep_id"))
    return checked.select(
        "digest",
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s)) != 0)).alias("salt"),
        sure.alias("keep_id"),
        "group_size",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = MAX_SALTS) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256."""
    parts = F.pmod(F.spark_partition_id(), F.lit(PARTS))
    rows = _keyed(docs, id_col, text_col, salts).select("digest", "salt", "id", parts.alias("part")).groupBy("digest", "salt", "id", "part").agg(F.count(F.lit(1)).alias("times"))
    joined = rows.join(duplicate_groups(docs, id_col, text_col, salts), ["digest", "salt"])
    # At most PARTS rows of an id and digest. This window needs no exchange after the join.
    first = F.min("part").over(Window.partitionBy("digest", "salt", "id"))
    told = joined.withColumn("wins", F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("part") == first)).repartition("digest", "salt", "part")
    # Each row as often as it is there; in two steps, so that no array is longer than STEP or the number of steps.
    steps = told.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / STEP))))
    every = steps.withColumn("nth", F.explode(F.sequence(F.col("step") * STEP + 1, F.least("times", (F.col("step") + 1) * STEP))))
    return every.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("wins") & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = MAX_SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that share the winning id and text the one whose other columns have the
    smallest hash stays. Rows are folded by digest; that one text stands behind each
    is checked, on all texts, where the winners come from.
    """
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.name != text_col]
    order = F.struct(F.col("id").isNull(), "id", F.xxhash64(*plain) if plain else F.lit(0))
    best = _keyed(docs, id_col, text_col, salts).groupBy("digest", "salt").agg(F.min_by("row", order).alias("row"), F.min("id").alias("id"))
    # No id is below its group's keep_id, so this is equality; as such it would become a key of the join, and rows would be exchanged again.
    wins = (F.col("id") <= F.col("keep_id")) | F.col("keep_id").isNull()
    return best.join(duplicate_groups(docs, id_col, text_col, salts), ["digest", "salt"]).where(wins).select("row.*")
