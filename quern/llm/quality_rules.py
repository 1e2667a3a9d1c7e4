"""Quality rules: per-document counts, then cross-document line frequency.

One pass over whole texts gives, per document, counts and the hashes of its
normalised lines (white-space runs as one space, ends trimmed, lower-cased) with
their words. Documents with equal texts count as one document. A line whose
number of documents within a host passes the host's limit is boilerplate: it is
removed, and a document left with too small a share of its words is rejected.

The limit is ``min_docs`` distinct texts, whatever the size of the host, so a
passage planted in a few dozen documents of a host with a third of all rows is
found there as it is in a small one. A ``share`` above 0 raises the limit to that
share of the host's texts. Counting is by (host, line, document) and then (host,
line), both with partial sums on the map side; lines above limits meet documents
again in a salted join.

Defined results: null text has no words or lines; a null host is a host of its
own; rows without a line left or too few words fail the base rules; null and
repeated ids are kept apart as rows; an empty table gives no rows; texts of any
length are read whole; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import pieces, cut, free_name

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
SALTS = 16
_SPACES = b" \t\n\x0b\x0c\r"
_NOT_CODE_POINTS = bytes(range(0x80, 0xC0)) + _SPACES


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more in the text, all of them counted. Exact: ids, not hashes."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    # Numbers of 2, 4, 8 ... words from the numbers of two halves.
    width, base = 1, ids
    while width * 2 <= window:
        pair = base[:-width] * (int(base.max()) + 1) + base[width:]
        base = np.unique(pair, return_inverse=True)[1]
        width *= 2
    if width < window:
        base = np.unique(base[: n] * (int(base.max()) + 1) + base[window - width : window - width + n], return_inverse=True)[1]
    again = np.bincount(base)[base] > 1
    if not again.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int], int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line hashes, words of each line, hash of the text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [ln for ln in raw.split(b"\n") if ln.strip(_SPACES)]
    hashes, counts = [], []
    for ln in lines:
        parts = ln.split()
        hashes.append(xxhash.xxh3_64_intdigest(b" ".join(parts).decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass")) - 2**63)
        counts.append(len(parts))
    return len(words), len(raw.translate(None, _NOT_CODE_POINTS)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), hashes, counts, xxhash.xxh3_64_intdigest(raw) - 2**63


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words", "same"]
    types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = [measure(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), *(pa.array([g[k] for g in got], t) for k, t in enumerate(types))], ["id", "host", *names])

    host = F.col(f"`{host_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.concat(F.lit("h"), host), F.lit("n")).alias("host"), F.col(f"`{text_col}`").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>, same long")


def frequent_lines(rows: DataFrame, min_docs: int, share: float) -> DataFrame:
    """host, line: those whose number of distinct documents passes the host's limit."""
    lines = rows.select("host", "same", F.explode(F.array_distinct("lines")).alias("line")).distinct()
    per_line = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    if not share:
        return per_line.select("host", "line")
    hosts = rows.select("host", "same").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    return per_line.join(hosts, "host").where(F.col("n_docs") > F.col("host_docs") * share).select("host", "line")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 20, max_repeat_percent: int = 30, min_docs: int = 10, share: float = 0.0, left_percent: int = 30) -> DataFrame:
    """One row per document: id, the counts, base_failed, removed_words, removed_lines (their places among lines with a word), kept."""
    rows = cut(_measured(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()))
    hot = frequent_lines(rows, min_docs, share).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    places = rows.select("host", "row", F.posexplode(F.arrays_zip("lines", "line_words")).alias("place", "x")).select("host", "row", "place", F.col("x.lines").alias("line"), F.col("x.line_words").alias("w"))
    gone = places.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(hot, ["host", "line", "salt"]).groupBy("row").agg(F.sum("w").alias("removed_words"), F.sort_array(F.collect_list("place")).alias("removed_lines"))
    out = rows.drop("lines", "line_words", "same", "host").join(gone, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    depleted = (F.col("n_words") - F.col("removed_words")) * 100 < F.col("n_words") * left_percent
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"), "kept"
    )


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows that are kept, without their boilerplate lines; all columns. Rows travel through the verdict whole, so ids may be null or repeated."""
    row = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    whole = docs.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in row.items()]).alias("doc"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{host_col}`").alias("host"))
    kept = quality_rules(whole, "doc", "text", "host", **limits).where("kept").select("doc.*", "removed_lines").withColumnsRenamed({n: c for c, n in row.items()} | {"removed_lines": (gone := free_name(docs, "_gone"))})
    lines = F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    left = F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains(F.col(gone), i), x)), lambda x: x.isNotNull()), "\n")
    return kept.withColumn(text_col, F.when(F.size(gone) > 0, left).otherwise(F.col(f"`{text_col}`"))).select(*[f"`{c}`" for c in docs.columns])
