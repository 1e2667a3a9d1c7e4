"""Prompts, pluggable text generation, and what is done with generated text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import answers

INSTRUCTION = "Answer the question in at most three sentences, from the context alone. Give no advice, comparison or prediction."


def prompts(results: DataFrame, top: int = 3) -> DataFrame:
    """query_id, prompt from ranked results (query_id, query, rank, text): the best chunks in order."""
    best = results.where(F.col("rank") <= top).groupBy("query_id").agg(F.max("query").alias("query"), F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("c"))
    context = F.array_join(F.transform("c", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["text"])), "\n")
    return best.select("query_id", F.concat(F.lit(INSTRUCTION + "\n\nContext:\n"), context, F.lit("\n\nQuestion: "), F.col("query")).alias("prompt"))


def generate(rows: DataFrame, generator: Callable[[list[str]], list[str]]) -> DataFrame:
    """query_id (of any type), generated: the generator runs on executors over batches of prompts; null where it fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1).to_pylist()
            try:
                said = generator(asked)
            except Exception:  # noqa: BLE001  a failed service call falls back to extraction
                said = [None] * len(asked)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], ["query_id", "generated"])

    asked = rows.select("query_id", "prompt")
    return asked.mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, generated string")


def fallback(chunk: Column, url: Column, date: Column, limit: int = 2) -> Column:
    """The first pieces of the best chunk, finished."""
    return answers.finish(F.array_join(F.slice(answers.pieces(chunk), 1, limit), " "), url, date)


def final_text(generated: Column, chunk: Column, url: Column, date: Column) -> Column:
    return F.when(generated.isNotNull(), answers.edit_generated(generated, url, date)).otherwise(fallback(chunk, url, date))
