"""Pages to indexed chunks: extract, clean, chunk, embed. One lazy plan; the pages are read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.html import html_sections, section_text, tidy_sections
from quern.functions.urls import slug, title_from_url
from quern.functions.vectors import hash_encoder
from quern.operators.ranking import distributed_rank

CLEANER_VERSION = "2.3-v1"


def extract(pages: DataFrame, mode: str = "strict") -> DataFrame:
    """url, sections, full_text of (url, html)."""
    got = pages.withColumn("sections", tidy_sections(html_sections(F.col("html"), mode)))
    return got.drop("html").withColumn("full_text", section_text(F.col("sections")))


def clean(docs: DataFrame) -> DataFrame:
    """Cleans every section's lines, drops sections left empty, and counts the lines that went."""
    tidy = F.transform("sections", lambda s: F.struct(s["heading_level"].alias("heading_level"), tx.clean_text(s["heading"]).alias("heading"), tx.clean_items(s["content"]).alias("content")))
    lines = lambda c: F.aggregate(F.transform(c, lambda s: F.size(s["content"])), F.lit(0), lambda a, n: a + n)
    out = docs.withColumn("_before", lines(F.col("sections"))).withColumn("sections", tidy_sections(tidy))
    return out.withColumn("removed_lines", F.greatest(F.lit(0), F.col("_before") - lines(F.col("sections")))).withColumn("full_text", section_text(F.col("sections"))).drop("_before")


def chunk(docs: DataFrame, positive: list[str] | None = None, negative: list[str] | None = None, threshold: float = 0.25, fallback_threshold: float = 0.2) -> DataFrame:
    """chunk_id, text and metadata. A document without a relevant section is cut from its relevant sentences instead.

    Both ways are decided inside a document's row, without a join; the number of a
    document is its place in a fixed order of the urls.
    """
    numbered = distributed_rank(docs, "url", "doc_no")
    score = lambda c: tx.relevance_score(c, positive, negative)
    section = lambda s, i: F.struct((i + 1).alias("no"), s["heading"].alias("heading"), tx.collapse(F.array_join(s["content"], " ")).alias("text"))
    good = F.filter(F.transform("sections", section), lambda s: tx.is_relevant(s["text"], threshold, positive, negative))
    kept = F.filter(tx.sentences(tx.collapse(F.col("full_text"))), lambda s: tx.is_relevant(s, fallback_threshold, positive, negative))
    fallback = F.filter(F.array(F.struct(F.lit(999).alias("no"), F.lit("Document").alias("heading"), F.array_join(kept, " ").alias("text"))), lambda s: s["text"] != "")
    picked = numbered.withColumn("_good", good).withColumn("s", F.explode(F.when(F.size("_good") > 0, F.col("_good")).otherwise(fallback)))
    # Of when the page was fetched; the footer of an answer cites it.
    date = F.col("source_date").cast("string") if "source_date" in docs.columns else F.lit(None).cast("string")
    pieces = picked.withColumn("source_date", date).select("url", "source_date", "doc_no", F.col("s.no").alias("section_no"), F.col("s.heading").alias("section_heading"), F.posexplode(tx.chunks(F.col("s.text"))).alias("pos", "text"))
    title = title_from_url(F.col("url"))
    return pieces.select(
        F.format_string("c-%02d-%03d-%03d", "doc_no", "section_no", F.col("pos") + 1).alias("chunk_id"),
        "text",
        F.col("url").alias("source_url"),
        title.alias("scheme"),
        slug(title).alias("entity_id"),
        F.lit("web_page").alias("doc_type"),
        "section_heading",
        "source_date",
        F.lit(CLEANER_VERSION).alias("cleaner_version"),
        score(F.col("text")).alias("relevance_score"),
    )


def embed(chunks: DataFrame, encoder=None, dim: int = 384, model: str = "hashed-words") -> DataFrame:
    """Adds embedding, embedding_dim, embedding_model; blank chunks get none. Ids stay with their rows."""
    encode = encoder or hash_encoder(dim)
    v = F.when(F.trim("text") != "", encode(F.col("text")))
    return chunks.withColumn("embedding", v).withColumn("embedding_dim", F.when(F.col("embedding").isNotNull(), F.size("embedding"))).withColumn("embedding_model", F.lit(model))


def ingest(pages: DataFrame, approved: DataFrame | None = None, mode: str = "strict", **options) -> DataFrame:
    """Pages (url, html and, where known, source_date) to chunks, after the allowlist if one is given."""
    listed = pages if approved is None else pages.join(approved.select("url").distinct(), "url", "left_semi")
    return listed.transform(extract, mode).transform(clean).transform(chunk, **options)


def refresh(index: DataFrame, new_chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """The index without the rows of changed URLs, with their new chunks."""
    return index.join(changed.select(F.col("url").alias("source_url")), "source_url", "left_anti").unionByName(new_chunks, allowMissingColumns=True)


def now_text(now: Column) -> Column:
    return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX")


def chunks_per_document(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """url, n_chunks; documents without a chunk are there with 0."""
    n = chunks.groupBy(F.col("source_url").alias("url")).agg(F.count(F.lit(1)).alias("n"))
    return docs.select("url").distinct().join(n, "url", "left").select("url", F.coalesce("n", F.lit(0)).alias("n_chunks"))


def embedding_summary(embedded: DataFrame) -> DataFrame:
    """total, embedded, failed, and the number of different dimensions (more than one is an error)."""
    return embedded.agg(F.count(F.lit(1)).alias("total"), F.count("embedding").alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("failed"), F.count_distinct("embedding_dim").alias("dimensions"))
