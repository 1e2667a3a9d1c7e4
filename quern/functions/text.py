"""Cleaning, relevance and chunking of text, as column expressions (JVM side)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from quern.functions import lexicons as lx
from quern.functions.slices import sliced


def words_in(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur in the text; each counts once."""
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def found_terms(text: Column, terms: list[str]) -> Column:
    """The terms that occur, in the list's order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms]))


def collapse(text: Column) -> Column:
    """Runs of white space (Unicode) as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_spaces(text: Column) -> Column:
    return collapse(F.translate(text, "\u00a0", " "))


def clean_symbols(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("•"), F.lit("- ")), F.lit("●"), F.lit("- "))
    return F.replace(out, F.lit("₹"), F.lit("Rs "))


def clean_text(text: Column) -> Column:
    return clean_symbols(clean_spaces(text))


def is_boilerplate(text: Column, lines: list[str] | None = None) -> Column:
    return (F.char_length(text) <= 2) | F.lower(text).isin(lines or lx.BOILERPLATE_LINES)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def first_occurrences(items: Column) -> Column:
    """Array without later items that equal an earlier one ignoring case; order kept. Nulls go.

    Sorted by lower case and place, the first of each run stays: m log m steps for m items.
    """
    kept = F.filter(items, lambda x: x.isNotNull())
    placed = F.array_sort(F.transform(kept, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("at"), x.alias("item"))))
    first = once(placed, lambda s: F.filter(s, lambda e, i: (i == 0) | (e["low"] != F.get(s, i - 1)["low"])))
    return F.transform(F.array_sort(F.transform(first, lambda e: F.struct(e["at"].alias("at"), e["item"].alias("item")))), lambda e: e["item"])


def clean_items(items: Column, lines: list[str] | None = None) -> Column:
    """Array of strings: cleaned, boilerplate dropped, repeats dropped."""
    return first_occurrences(F.filter(F.transform(items, clean_text), lambda x: ~is_boilerplate(x, lines)))


def relevance_score(text: Column, positive: list[str] | None = None, negative: list[str] | None = None) -> Column:
    low = F.lower(text)
    raw = words_in(low, positive or lx.RELEVANCE_TERMS) - words_in(low, negative or lx.NOISE_TERMS) * 0.8 + (F.char_length(text) >= 80).cast("int")
    return F.round(F.greatest(F.lit(0.0), raw) / 6, 4)


def is_relevant(text: Column, threshold: float = 0.25, positive: list[str] | None = None, negative: list[str] | None = None) -> Column:
    return (F.char_length(text) >= 30) & (relevance_score(text, positive, negative) >= threshold)


def overlap_pieces(text: str, low: int = lx.CHUNK_MIN, high: int = lx.CHUNK_MAX, overlap: int = lx.CHUNK_OVERLAP) -> Iterator[str]:
    """Overlapping pieces of a text, one after the other.

    A window of ``high`` characters that does not reach the end is cut after its
    last ". ", "; " or ", " if that lies at ``low`` or later; the next window begins
    ``overlap`` before the cut. Pieces are trimmed; empty ones are left out.
    """
    start, n = 0, len(text)
    while start < n:
        size = min(high, n - start)
        if start + high < n:
            cut = max(text.rfind(d, start, start + high) for d in (". ", "; ", ", ")) - start
            size = cut + 1 if cut >= low else size
        if piece := text[start : start + size].strip(" "):
            yield piece
        if start + size >= n:
            return
        start = max(start + size - overlap, start + 1)


def _checked_sizes(low: int, high: int, overlap: int) -> None:
    if not low > overlap >= 0 or high < low:
        raise ValueError("chunk sizes must satisfy high >= low > overlap >= 0")


def chunks(text: Column, low: int = lx.CHUNK_MIN, high: int = lx.CHUNK_MAX, overlap: int = lx.CHUNK_OVERLAP) -> Column:
    """The overlap_pieces() of a white-space-collapsed text as an array, linear in the text; null for null."""
    _checked_sizes(low, high, overlap)

    cut = sliced(lambda t: None if t is None else list(overlap_pieces(t, low, high, overlap)), T.ArrayType(T.StringType()))
    return cut(text)


@udtf(returnType="ord int, chunk string", useArrow=True)
class OverlapChunks:
    """ord (from 1), chunk of a text, as rows that are passed on as they are made: for very long texts and for SQL.

    ``spark.udtf.register("overlap_chunks", OverlapChunks)``, then ``LATERAL overlap_chunks(text, 600, 900, 150)``.
    """

    def eval(self, text: str, low: int, high: int, overlap: int):
        _checked_sizes(low, high, overlap)
        for n, piece in enumerate(overlap_pieces(text or "", low, high, overlap), 1):
            yield n, piece


def sentences(text: Column) -> Column:
    """Split after . ! or ? followed by white space."""
    return F.split(text, r"(?<=[.!?])\s+")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def sentence_count(text: Column) -> Column:
    return F.when(F.coalesce(F.char_length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]"))))


def flag_true(value: Column) -> Column:
    """Text flags: true, 1 and yes."""
    return F.coalesce(F.lower(F.trim(value)).isin("true", "1", "yes"), F.lit(False))


def comma_list(value: Column) -> Column:
    """Items of a comma-separated text, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
