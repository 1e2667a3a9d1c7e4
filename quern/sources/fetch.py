"""Fetching of URLs on executors through a pluggable function, with an allowlist before it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FETCHED = "url string, fetch_status string, http_status_code int, response_fingerprint string, content_type string, content_length long, error_message string, body binary"


class HttpFailure(Exception):
    """A response with an error status."""

    def __init__(self, code: int, message: str = ""):
        super().__init__(message or f"HTTP {code}")
        self.code = code


def http_get(url: str, timeout: float = 20.0, listed: frozenset[str] = frozenset()) -> tuple[int, str, bytes]:
    """Status, content type and body, by the standard library. A redirect is followed only to a listed URL, and fails with its status else."""
    import urllib.error
    import urllib.request

    class Listed(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, headers, newurl):
            if newurl not in listed:
                raise HttpFailure(code, f"redirect to a URL that is not listed: {newurl}")
            return super().redirect_request(req, fp, code, msg, headers, newurl)

    try:
        with urllib.request.build_opener(Listed).open(urllib.request.Request(url, headers={"User-Agent": "quern"}), timeout=timeout) as r:
            return r.status, r.headers.get("Content-Type", ""), r.read()
    except urllib.error.HTTPError as e:
        raise HttpFailure(e.code, str(e)) from e


def listed_get(approved: DataFrame, limit: int = 100_000) -> Callable[[str], tuple[int, str, bytes]]:
    """http_get that follows redirects to approved URLs; their table travels to the tasks, so its size is checked."""
    urls = [r["url"] for r in approved.select("url").distinct().limit(limit + 1).collect()]
    if len(urls) > limit:
        raise ValueError(f"the allowlist has more than {limit} URLs")
    return partial(http_get, listed=frozenset(urls))


def fetch_one(url: str, get: Callable[[str], tuple[int, str, bytes]], retries: int = 2) -> tuple:
    """A row of FETCHED. An error status keeps its code; other failures have code 0 and are tried again."""
    for left in range(retries, -1, -1):
        try:
            code, kind, body = get(url)
            return url, "success", code, hashlib.sha256(body).hexdigest(), kind, len(body), None, body
        except HttpFailure as e:
            return url, "failed", e.code, "", None, 0, str(e), None
        except Exception as e:  # noqa: BLE001  whatever a fetcher raises is a failed fetch
            if not left:
                return url, "failed", 0, "", None, 0, f"{type(e).__name__}: {e}", None
    raise AssertionError("unreachable")


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, str, bytes]] = http_get, retries: int = 2) -> DataFrame:
    """One row per URL, by fetch_one()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            rows = [fetch_one(u, get, retries) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in FETCHED.split(", ")])

    return urls.select("url").where("url is not null").mapInArrow(run, FETCHED)


def from_pages(pages: DataFrame, *keep: str) -> DataFrame:
    """A table of stored pages (url, html) in the form of fetch(), with further columns to keep."""
    body = F.col("html").cast("binary")
    ok = F.col("html").isNotNull()
    return pages.select(
        *keep,
        "url",
        F.when(ok, "success").otherwise("failed").alias("fetch_status"),
        F.when(ok, 200).otherwise(0).alias("http_status_code"),
        F.coalesce(F.sha2(body, 256), F.lit("")).alias("response_fingerprint"),
        F.lit("text/html").alias("content_type"),
        F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("content_length"),
        F.lit(None).cast("string").alias("error_message"),
        body.alias("body"),
    )


def fetch_summary(fetched: DataFrame) -> DataFrame:
    return fetched.agg(F.count(F.lit(1)).alias("total_urls"), F.count_if(F.col("fetch_status") == "success").alias("success_count"), F.count_if(F.col("fetch_status") != "success").alias("failure_count"))
