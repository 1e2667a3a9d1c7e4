"""One spelling for names that are written in several ways.

Names within some edits of each other have a common text that each becomes by leaving out at most as many
characters. So the names meet by those texts in an equi-join, which misses no pair and makes none of names that share none; what
meets is verified by the edit distance. A name follows the best name near it (most rows, then the
smaller one) if that is better than itself, and so on; where that ends is its canonical name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import collapse
from quern.sources.shared import shared_folder


def shortened(name: Column, edits: int) -> Column:
    """The name and what it becomes by leaving out up to ``edits`` characters."""
    one = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(t))), lambda at: F.concat(F.substr(t, F.lit(1), at - 1), F.substr(t, at + 1)))
    out = F.array(name)
    for _ in range(edits):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, one))))
    return out


def near_names(names: DataFrame, edits: int = 1, name: str = "name") -> DataFrame:
    """a, b: all pairs of different names, each once in both orders, with at most ``edits`` edits between them."""
    short = names.select(F.col(name).alias("a")).where("a is not null").distinct().select("a", F.explode(shortened(F.col("a"), edits)).alias("short"))
    met = short.join(short.withColumnRenamed("a", "b"), "short").where("a <> b").select("a", "b").distinct()
    return met.where(F.levenshtein("a", "b", edits) >= 0)


def canonical_names(rows: DataFrame, name: str = "name", edits: int = 1, max_rounds: int = 40) -> DataFrame:
    """name (lower case, spaces collapsed), n (its rows), canonical, of every different name; nulls and blanks go."""
    counts = rows.select(collapse(F.lower(F.col(name))).alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    spark = rows.sparkSession
    root = shared_folder(spark, "names")

    def kept(df: DataFrame, k: int) -> DataFrame:
        """Written, so that later rounds do not run earlier ones again."""
        df.write.parquet(f"{root}/{k}")
        return spark.read.schema(df.schema).parquet(f"{root}/{k}")

    counts = kept(counts, 0)
    of_b = counts.select(F.col("name").alias("b"), F.col("n").alias("n_b"))
    best = near_names(counts, edits).join(of_b, "b").groupBy("a").agg(F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("name"))).alias("best"))
    better = F.col("best") < F.struct((-F.col("n")).alias("n"), F.col("name").alias("name"))
    follows = kept(counts.join(best, F.col("a") == F.col("name"), "left").select("name", "n", F.when(better, F.col("best.name")).otherwise(F.col("name")).alias("canonical")), 1)
    for k in range(2, max_rounds):
        # Each round doubles how far a name has followed.
        further = follows.select(F.col("name").alias("canonical"), F.col("canonical").alias("next"))
        moved = kept(follows.join(further, "canonical").select("name", "n", F.col("next").alias("canonical"), (F.col("next") != F.col("canonical")).alias("moved")), k)
        follows = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return follows
    raise RuntimeError(f"names did not settle in {max_rounds} rounds")
