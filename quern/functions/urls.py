"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import lexicons as lx


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_from_url(url: Column) -> Column:
    """The last path segment with spaces for hyphens and capitalised words."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.initcap(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("-"), F.lit(" ")))


def snapshot_name(url: Column) -> Column:
    """A file name for a fetched body: the URL without scheme, slashes as underscores, and 12 digits of its digest."""
    bare = F.replace(F.regexp_replace(url, "https?://", ""), F.lit("/"), F.lit("_"))
    return F.concat(bare, F.lit("_"), F.substring(F.sha2(url, 256), 1, 12), F.lit(".html"))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1)


def urls_in(text: Column) -> Column:
    """Distinct URLs of the lower-cased text in order, without trailing punctuation."""
    found = F.regexp_extract_all(F.lower(text), F.lit(lx.URL_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "[.,;:!?]+$", "")))


def without_urls(text: Column) -> Column:
    return F.regexp_replace(text, lx.URL_PATTERN, "")
