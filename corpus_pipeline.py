"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, encoding.

Defined results: rows with null in any column, empty and very long texts, and
repeated rows take part in every stage. Null text counts as empty: it scores the
bias, equals other empty texts, is near to none, has size 0 and no tokens. Of
rows that are equal in id and text one stays; rows without an id stay, one of
each text. Ties go to the smallest doc_id. An empty table gives no rows. Columns
of any other name come through all stages but the last, whose columns are its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, exact_dedup, mixing, ngram_join, queries, toxicity
from quern.llm.common import cut, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of the n-gram Jaccard join the smallest doc_id stays."""
    return ngram_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as systematic sampling takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests."""
    return bpe.encode_documents(docs, queries.VOCABULARY, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: Learnt weights and BPE are not SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is cut, so that its successor's several passes do not run it again. A cut that nothing needs any more is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = cut(docs)
            release(before)
    return docs
