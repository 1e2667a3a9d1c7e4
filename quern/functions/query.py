"""Query normalisation and features."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import lexicons as lx
from quern.functions.text import collapse


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark lacks."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def rewrite_patterns(query: Column) -> Column:
    """Currency, percentages, periods (a number with its unit right behind it) and three compound terms to one spelling each, in this order."""
    q = F.regexp_replace(query, r"[₹$€£]|\b(?:rs|inr)\b", " rs ")
    q = F.regexp_replace(q, r"percentage|percent|%", " percent ")
    q = F.regexp_replace(q, r"\b(\d+)(?:y|yr|year)s?\b", "$1 year")
    q = F.regexp_replace(q, r"\b(\d+)(?:m|month)s?\b", "$1 month")
    q = F.regexp_replace(q, r"\b(\d+)(?:d|day)s?\b", "$1 day")
    q = F.regexp_replace(q, r"\block[-\s]?in\b", "lockin")
    q = F.regexp_replace(q, r"\bexpense[-\s]?ratio\b", "expense ratio")
    return F.regexp_replace(q, r"\bexit[-\s]?load\b", "exit load")


def expand_abbreviations(query: Column, table: dict[str, str] | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for pair in (table or lx.ABBREVIATIONS).items() for x in pair])
    return F.array_join(F.transform(F.split(query, " "), lambda t: F.coalesce(F.element_at(known, t), t)), " ")


def normalize_query(query: Column, compose: bool = True, expand: bool = False) -> Column:
    """NFKC (a UDF; leave out for text known to be composed), lower case, spaces, rewrites."""
    q = collapse(F.lower(nfkc(query) if compose else query))
    if expand:
        q = expand_abbreviations(q)
    return F.trim(F.regexp_replace(rewrite_patterns(q), r" +", " "))


def numeric_features(query: Column, periods: list[str] | None = None, finance: list[str] | None = None) -> dict[str, Column]:
    any_of = lambda terms: F.greatest(F.lit(False), *[F.contains(query, F.lit(t)) for t in terms])
    numbers, currency, percent = F.regexp_like(query, F.lit(r"\b[0-9]+(\.[0-9]+)?\b")), F.regexp_like(query, F.lit(r"(?i)[₹$€£]|\b(rs|inr)\b")), F.regexp_like(query, F.lit("(?i)%|percent"))
    period = any_of(periods or lx.PERIOD_TERMS)
    return {
        "has_numbers": numbers,
        "has_currency": currency,
        "has_percentage": percent,
        "has_time_periods": period,
        "has_financial_terms": any_of(finance or lx.FINANCIAL_TERMS),
        "is_numeric_heavy": numbers & (currency | percent | period),
    }


def domain_tokens(query: Column, tokens: list[str] | None = None, table: dict[str, str] | None = None) -> Column:
    """Domain tokens among the query's words, and abbreviations whose expansion has one of its words. Sorted."""
    words = F.array_distinct(F.split(query, " "))
    direct = F.array_intersect(words, F.array(*[F.lit(t) for t in tokens or lx.DOMAIN_TOKENS]))
    back = [F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in e.split()])), F.lit(a)) for a, e in (table or lx.ABBREVIATIONS).items()]
    return F.array_sort(F.array_union(direct, F.array_compact(F.array(*back))))


def is_entity_specific(query: Column, indicators: list[str] | None = None) -> Column:
    return F.greatest(F.lit(False), *[F.contains(query, F.lit(t)) for t in indicators or lx.ENTITY_INDICATORS])
