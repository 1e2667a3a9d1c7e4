"""Entity resolution against a registry of names and aliases.

Both directions of containment are joins without a nested loop. Aliases inside
queries: an automaton over all aliases, built once a Python worker, if the table was
counted to be small enough to travel; else, and for queries inside aliases, an
inverted index of character n-grams, which is two shuffle joins at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import lexicons as lx
from quern.functions.urls import slug

#: Characters of an alias table that travels to the workers; an automaton has at most as many nodes (some 50 bytes each).
MAX_CHARS = 2_000_000
#: Lengths of the n-grams of the inverted index. A text is found by a gram of the longest of these that it has.
GRAMS = (8, 4, 2, 1)


def aliases(registry: DataFrame, name_col: str = "name", replacements: list[tuple[str, str]] | None = None, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """entity_id (slug), name, alias, ord: the name, its lower case, variants with a part replaced, and extra terms by keyword.

    Variants are trimmed; empty and repeated aliases go.
    """
    name, low = F.col(name_col), F.lower(F.col(name_col))
    variants = [F.trim(F.replace(low, F.lit(a), F.lit(b))) for a, b in (lx.ALIAS_REPLACEMENTS if replacements is None else replacements)]
    keyed = [F.when(F.contains(low, F.lit(k)), F.array(*[F.lit(x) for x in v])).otherwise(F.array().cast("array<string>")) for k, v in (lx.ALIAS_TERMS if extra is None else extra).items()]
    every = F.array_distinct(F.filter(F.flatten(F.array(F.array(F.trim(name), F.trim(low), *variants), *keyed)), lambda a: a != ""))
    return registry.select(slug(name).alias("entity_id"), name.alias("name"), F.posexplode(every).alias("ord", "alias"))


# ---------------------------------------------------------------- containment by n-grams


def _grams(text: Column, n: Column | int) -> Column:
    """Distinct substrings of n characters; none of a shorter text."""
    letters = F.split(text, "")
    last = F.char_length(text) - n + 1
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda at: F.array_join(F.slice(letters, at, n), "")))


def contained_in(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needle, text: all pairs of a non-empty ``needle`` with a ``text`` that contains it, for tables of distinct ones.

    Every needle is looked for by its n-gram that the fewest texts have, so a frequent gram
    is used only by needles that have no other. One with a gram that no text has is in none.
    """
    size = F.coalesce(*[F.when(F.char_length("needle") >= n, n) for n in GRAMS])
    wanted = needles.where("needle <> ''").select("needle", size.alias("n"))
    used = sorted(r["n"] for r in wanted.select("n").distinct().collect())  # a few lengths
    every = F.flatten(F.array(*[_grams(F.col("text"), n) for n in used])) if used else F.array().cast("array<string>")
    index = texts.select("text", F.explode(every).alias("gram"))
    found_in = index.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    asked = wanted.select("needle", F.explode(_grams(F.col("needle"), F.col("n"))).alias("gram"))
    rarest = asked.join(found_in, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"), F.bool_and(F.col("df").isNotNull()).alias("all"))
    return rarest.where("all").join(index, "gram").where(F.contains("text", F.col("needle"))).select("needle", "text")


# ---------------------------------------------------------------- containment by an automaton

_AUTOMATA: dict[int, object] = {}
_NUMBERS = count()  # of the tables that one driver has sent


def _automaton(number: int, words: list[str]):
    """One automaton for each broadcast table in a worker: its values are the words' places."""
    import ahocorasick

    if number not in _AUTOMATA:
        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for place, word in enumerate(words):
            made.add_word(word, place)
        made.make_automaton()
        _AUTOMATA[number] = made
    return _AUTOMATA[number]


def _first_by_automaton(rows: DataFrame, table: pa.Table, order: DataFrame) -> DataFrame:
    """rows (key, q) with the first of ``table``'s rows, in their order, whose alias is in q; nulls where none is."""
    sent = rows.sparkSession.sparkContext.broadcast(table)
    number = next(_NUMBERS)
    names, kinds = order.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in order.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        words = known.column("alias").to_pylist()
        find = _automaton(number, words).iter if words else lambda text: ()
        for batch in batches:
            places = pa.array([min((p for _, p in find(q)), default=None) if q else None for q in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[known.column(n).combine_chunks().take(places) for n in names]], [*batch.schema.names, *names])

    return rows.mapInArrow(run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, q string, {kinds}")


def _first_by_grams(rows: DataFrame, order: DataFrame) -> DataFrame:
    texts = rows.select(F.col("q").alias("text")).where("text is not null").distinct()
    pairs = contained_in(order.select(F.col("alias").alias("needle")).distinct(), texts)
    hits = pairs.join(order, F.col("needle") == F.col("alias")).groupBy("text").agg(F.min(F.struct((-F.char_length("alias")).alias("n"), "entity_id", "alias", "name")).alias("best"))
    told = hits.select(F.col("text").alias("q"), *[F.col(f"best.{c}").alias(c) for c in order.columns])
    return rows.join(told, "q", "left").select("query_id", "q", *order.columns)


def as_written_confidence(query: Column, name: Column, alias: Column) -> Column:
    """Twice the matched characters, at most 1 - so 1 for any match; what the other rules add is cut off."""
    base = F.least(F.char_length(alias) * 2.0, F.lit(1.0))
    base = F.when(alias == F.lower(name), F.greatest(base, F.lit(0.9))).otherwise(base)
    return F.when(F.char_length(alias) > 10, F.least(base + 0.1, F.lit(1.0))).otherwise(base)


def share_confidence(query: Column, name: Column, alias: Column) -> Column:
    """The covered share of the query; 0.9 at least for the name itself, and 0.1 more for an alias of over 10 characters."""
    share = F.char_length(alias) / F.char_length(query)
    sure = F.when(query == F.lower(name), F.greatest(F.lit(0.9), share)).otherwise(share)
    return F.round(F.least(F.lit(1.0), sure + F.when(F.char_length(alias) > 10, 0.1).otherwise(0.0)), 6)


def resolve_longest(queries: DataFrame, alias_table: DataFrame, query_id: str = "query_id", query_text: str = "query", max_chars: int = MAX_CHARS, as_written: bool = False) -> DataFrame:
    """Every query row with the entity of its longest contained alias (ties: smaller entity, then alias), and a confidence.

    as_written takes the confidence that is 1 for any match. Null queries have none.
    An alias table of at most ``max_chars`` characters travels to the workers, and
    queries stay where they are; a larger one is joined by n-grams.
    """
    rows = queries.select(F.col(query_id).alias("query_id"), F.lower(F.col(query_text)).alias("q"))
    # Of entities with one alias the first has it.
    order = alias_table.where("alias <> ''").groupBy("alias").agg(F.min(F.struct("entity_id", "name")).alias("e")).select(F.col("e.entity_id").alias("entity_id"), F.col("e.name").alias("name"), "alias")
    size = alias_table.agg(F.sum(F.char_length("alias")).alias("alias"), F.sum(F.char_length("name")).alias("name")).first()
    if max(size["alias"] or 0, size["name"] or 0) <= max_chars:
        table = order.orderBy(F.desc(F.char_length("alias")), "entity_id", "alias").toArrow()
        found = _first_by_automaton(rows, table, order)
    else:
        found = _first_by_grams(rows, order)
    rule = as_written_confidence if as_written else share_confidence
    sure = rule(F.col("q"), F.col("name"), F.col("alias"))
    return found.select("query_id", "entity_id", "name", "alias", F.when(F.col("alias").isNotNull(), sure).otherwise(F.lit(0.0)).alias("confidence"))


def search_entities(queries: DataFrame, alias_table: DataFrame, limit: int = 5, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """query_id, entity_id, score, rank: entities with an alias that contains the query; score is the covered share."""
    rows = queries.select(F.col(query_id).alias("query_id"), F.lower(F.col(query_text)).alias("q")).distinct()
    low = alias_table.select("entity_id", F.lower("alias").alias("text")).distinct()
    pairs = contained_in(rows.select(F.col("q").alias("needle")).distinct(), low.select("text").distinct())
    best = pairs.join(low, "text").groupBy("needle", "entity_id").agg(F.round(F.max(F.char_length("needle") / F.char_length("text")), 6).alias("score"))
    # Cut per distinct query before its rows are joined.
    nth = F.row_number().over(Window.partitionBy("needle").orderBy(F.desc("score"), "entity_id"))
    top = best.withColumn("rank", nth).where(F.col("rank") <= limit)
    return rows.join(top, F.col("q") == F.col("needle")).select("query_id", "entity_id", "score", "rank")
