"""Evaluation of retrieval and classification results against expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import found_terms


def judge(results: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per expectation (query_id, expected_entity, expected_keywords, difficulty).

    results: query_id, entity_id, should_proceed, n_results, top_text. A query without
    a result fails. keyword_share is the part of the keywords found in the top text.
    """
    low = F.lower(F.coalesce("top_text", F.lit("")))
    hits = F.size(F.filter("expected_keywords", lambda k: F.contains(low, F.lower(k))))
    joined = expected.join(results, "query_id", "left")
    ok = F.coalesce(F.col("should_proceed") & (F.col("n_results") > 0), F.lit(False))
    return joined.select(
        "query_id",
        "difficulty",
        ok.alias("success"),
        (F.col("expected_entity").isNull() | F.coalesce(F.col("expected_entity") == F.col("entity_id"), F.lit(False))).alias("entity_correct"),
        F.when(F.size("expected_keywords") > 0, hits / F.size("expected_keywords")).otherwise(F.lit(1.0)).alias("keyword_share"),
        F.coalesce("should_proceed", F.lit(False)).alias("confident"),
    )


def rate(flag: Column) -> Column:
    return F.round(100 * F.avg(flag.cast("int")), 6)


def metrics(judged: DataFrame, least: float = 85.0) -> DataFrame:
    m = judged.agg(F.count(F.lit(1)).alias("n"), rate(F.col("success")).alias("success_rate"), rate(F.col("entity_correct")).alias("entity_rate"), rate(F.col("keyword_share") >= 0.5).alias("keyword_rate"), rate(F.col("confident")).alias("confidence_rate"))
    return m.withColumn("passed", F.col("success_rate") >= least)


def by_difficulty(judged: DataFrame) -> DataFrame:
    return judged.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"), rate(F.col("success")).alias("success_rate"))


def running_rate(judged: DataFrame, every: int = 5, block: int = 4096) -> DataFrame:
    """Success rate so far, in order of query_id (an integer), at every fifth question.

    Three levels instead of one global window: sums per block of ids, and of blocks
    of those blocks, are summed up first, then the rows of each block continue from
    its block's sums. The one window without a key has a row per block**2 ids.
    """
    rows = judged.select("query_id", F.col("success").cast("int").alias("ok"), F.floor(F.col("query_id") / block).alias("b"))
    sums = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("s")).withColumn("bb", F.floor(F.col("b") / block))
    so_far = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = sums.groupBy("bb").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select("bb", *[so_far(Window.orderBy("bb"), c).alias(f"{c}_above") for c in ("n", "s")])
    within = Window.partitionBy("bb").orderBy("b")
    sums = sums.select("b", "bb", *[so_far(within, c).alias(c) for c in ("n", "s")]).join(above, "bb").select("b", *[(F.col(c) + F.col(f"{c}_above")).alias(c) for c in ("n", "s")])
    w = Window.partitionBy("b").orderBy("query_id").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("query_id"))).withColumn("t", F.sum("ok").over(w))
    seen = own.join(sums, "b").select((F.col("n") + F.col("k")).alias("seen"), (F.col("s") + F.col("t")).alias("good"))
    return seen.where(F.col("seen") % every == 0).select("seen", F.round(100 * F.col("good") / F.col("seen"), 6).alias("running_rate"))


def failures(judged: DataFrame, reason: str = "reason") -> DataFrame:
    """Failures counted by difficulty, by reason, and in all."""
    bad = judged.where("not success").select("difficulty", F.col(reason).alias("reason"))
    return bad.groupingSets([["difficulty"], ["reason"], []], "difficulty", "reason").agg(F.count(F.lit(1)).alias("n"))


def confusion(predicted: DataFrame, truth: Column, said: Column) -> DataFrame:
    """True and false positives and negatives, precision and recall of two flags."""
    m = predicted.agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn"))
    part = lambda a, b: F.round(F.when(a + b > 0, a / (a + b)), 6)
    return m.withColumn("precision", part(F.col("tp"), F.col("fp"))).withColumn("recall", part(F.col("tp"), F.col("fn")))


def confusion_rate(judged: DataFrame) -> DataFrame:
    """n and the share, in percent, of answered questions whose entity is another one."""
    answered = F.col("success")
    return judged.agg(F.count_if(answered).alias("n"), F.round(100 * F.avg(F.when(answered, (~F.col("entity_correct")).cast("int"))), 6).alias("confusion_rate"))


def coverage_gaps(registry: DataFrame, facts: DataFrame, chunks: DataFrame, entity: str = "entity_id", text: str = "text", max_facts: int = 1000) -> DataFrame:
    """entity, fact: pairs of a registered entity and a wanted fact (a term) that none of the entity's chunks mentions.

    The facts (facts: fact) become part of the plan, so their number is checked; chunks are read once, without a join, and
    only distinct pairs of an entity and a fact are exchanged.
    """
    terms = sorted(r["fact"] for r in facts.select(F.lower("fact").alias("fact")).where("fact is not null").distinct().limit(max_facts + 1).collect())
    if len(terms) > max_facts:
        raise ValueError(f"more than {max_facts} facts")
    wanted = registry.select(entity).distinct().select(entity, F.explode(F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")).alias("fact"))
    told = chunks.select(F.col(entity), F.explode(found_terms(F.lower(text), terms) if terms else F.array().cast("array<string>")).alias("fact")).distinct()
    return wanted.join(told, [entity, "fact"], "left_anti")
