"""Latencies and freshness from sketches that are kept by hour and merged again.

A sketch row has a period, a kind, how many, the highest, a KLL sketch of the values and a HyperLogLog
sketch of the keys. Rows of any periods merge to one for longer ones, and late or re-read events of an
hour replace that hour's row only, so reports over months read no events. At K = 200 a quantile's
rank is off by at most 1.65 % of the rows at 99 % confidence for one query; distinct counts are off by about 1.6 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of KLL sketches, its rank error at 99 % confidence, and bits of HyperLogLog sketches.
K, RANK_ERROR, LG_K = 200, 0.0165, 12


def hourly_sketches(events: DataFrame, value: str = "value", key: str = "user_id", kind: str = "event_type", ts: str = "ts") -> DataFrame:
    """hour, kind, n, worst, values (sketch), keys (sketch). Null values and keys are left out of the sketches."""
    rows = events.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour"), F.col(kind).alias("kind"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("worst"), F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("values"), F.hll_sketch_agg(F.col(key).cast("string"), LG_K).alias("keys"))


def replace_hours(kept: DataFrame, again: DataFrame) -> DataFrame:
    """The kept sketches with those hours' rows replaced that were made again."""
    return kept.join(again.select("hour", "kind"), ["hour", "kind"], "left_anti").unionByName(again)


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """The sketches of rows that agree in ``by`` as one."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.max("worst").alias("worst"), F.kll_merge_agg_double("values").alias("values"), F.hll_union_agg("keys").alias("keys"))


def latency_report(sketches: DataFrame, *by: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """by, n, worst, n_keys and the quantiles (p50 and p95 if none are named)."""
    m = merged(sketches, *by)
    told = [F.kll_sketch_get_quantile_double("values", F.lit(float(q))).alias(name) for name, q in (quantiles or {"p50": 0.5, "p95": 0.95}).items()]
    return m.select(*by, "n", "worst", F.hll_sketch_estimate("keys").alias("n_keys"), *told)
