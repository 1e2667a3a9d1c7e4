"""A stored inverted index for BM25: built in one scan, read by the tokens that are asked for.

Layout below one path:

* ``blocks/bucket=N``: postings in blocks of one token, of a few documents of one
  segment each, with the highest tf and the least length of the block. Files are sorted by
  token, so that readers open the buckets of their tokens only and skip row groups in them.
* ``tokens/bucket=N``: token, df.
* ``blocks/bucket=-1``: for each segment how many documents and words it has.
* ``stats``: one row: n_docs, avgdl, mean_idf (of the raw idf of all tokens), buckets, id_type.

A segment is what one task read of the documents up to a number of postings, so it is
bounded, a token of every document has blocks in all of them, and no exchange is needed to
build it. A search brings the matching blocks of a segment together with the weights of a
block of queries: documents are scored whole, in one group, and leave it as k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.operators.retrieval import ranked, small_side

#: Postings after which a segment ends, and documents of a block.
SEGMENT, BLOCK = 400_000, 128


_NAMES = ["bucket", "token", "segment", "block", "ids", "tf", "dl", "groups", "n", "max_tf", "min_dl"]


class _Segment:
    """Postings of some documents, by numbers of tokens and documents."""

    def __init__(self, buckets: int, block: int):
        self.buckets, self.block = buckets, block
        self.number: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # token, document, tf
        self.ids, self.groups, self.lengths, self.size = [], [], [], 0
        self.docs, self.texts, self.words = 0, 0, 0

    def add(self, ids: pa.Array, words: pa.Array, groups: pa.Array) -> None:
        n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        said = words.flatten().dictionary_encode()
        known = np.array([self.number.setdefault(t, len(self.number)) for t in said.dictionary.to_pylist()], np.int64)
        if len(said):
            place = np.repeat(np.arange(len(n)), n) * len(known) + said.indices.to_numpy()
            place, tf = np.unique(place, return_counts=True)
            first = sum(map(len, self.ids))
            self.parts.append((known[place % len(known)], place // len(known) + first, tf))
            self.size += len(tf)
        self.docs += len(n)
        self.texts += len(n) - words.null_count  # a null text is a document, but its length is not averaged
        self.words += int(n.sum())
        self.ids.append(ids)
        self.groups.append(groups)
        self.lengths.append(n)

    def batches(self, segment: int) -> Iterator[pa.RecordBatch]:
        """The blocks, and a row of bucket -1 with the numbers of documents, texts and words."""
        if not self.docs:
            return
        some = lambda *v: pa.array([v], pa.list_(pa.int32()))
        kind = self.ids[0].type
        number = lambda v: pa.array([v], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [number(-1), pa.array([None], pa.string()), pa.array([segment]), number(0), pa.array([[]], pa.list_(kind)), some(self.docs, self.texts), some(self.words), pa.array([[]], pa.list_(pa.string())), number(0), number(0), number(0)], _NAMES
        )
        if self.parts:
            yield self.rows(segment)

    def rows(self, segment: int) -> pa.RecordBatch:
        token, doc, tf = (np.concatenate(c) for c in zip(*self.parts))
        words = np.array(list(self.number), object)
        bucket = np.array([crc32(w.encode("utf-8", "surrogatepass")) % self.buckets for w in words])
        place = np.empty(len(words), np.int64)
        place[sorted(range(len(words)), key=lambda k: (bucket[k], words[k]))] = np.arange(len(words))
        order = np.lexsort((doc, place[token]))
        token, doc, tf = token[order], doc[order], tf[order]
        runs = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[runs, len(token)])
        blocks = -(-size // self.block)
        nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = np.repeat(runs, blocks) + nth * self.block
        dl = np.concatenate(self.lengths)[doc]
        offsets = pa.array(np.r_[starts, len(token)], pa.int32())
        listed = lambda values: pa.ListArray.from_arrays(offsets, values)
        of = token[starts]
        at = pa.array(doc)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[of], pa.int32()),
                pa.array(words[of], pa.string()),
                pa.array(np.full(len(starts), segment)),
                pa.array(nth, pa.int32()),
                listed(pa.chunked_array(self.ids).combine_chunks().take(at)),
                listed(pa.array(tf, pa.int32())),
                listed(pa.array(dl, pa.int32())),
                listed(pa.chunked_array(self.groups).combine_chunks().take(at)),
                pa.array(np.diff(np.r_[starts, len(token)]), pa.int32()),
                pa.array(np.maximum.reduceat(tf, starts), pa.int32()),
                pa.array(np.minimum.reduceat(dl, starts), pa.int32()),
            ],
            _NAMES,
        )


_BLOCKS = "bucket int, token string, segment long, block int, ids array<{}>, tf array<int>, dl array<int>, groups array<string>, n int, max_tf int, min_dl int"


def bucket_of(token: Column, buckets: int) -> Column:
    return (F.crc32(token.cast("binary")) % buckets).cast("int")


def write_postings(docs: DataFrame, path: str, chunk_id: str = "chunk_id", text: str = "text", group: str | None = None, buckets: int = 16, block: int = BLOCK, segment: int = SEGMENT) -> None:
    """Writes the index of (chunk_id, text[, group]) to a new path.

    Null ids are left out; null and empty texts count as documents without tokens.
    """
    rows = docs.where(F.col(chunk_id).isNotNull()).select(F.col(chunk_id).alias("id"), tokens(F.col(text)).alias("t"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nth, task = _Segment(buckets, block), 0, TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                now.add(*whole.slice(at, 256).columns)
                if now.size >= segment:
                    yield from now.batches(task << 24 | nth)
                    now, nth = _Segment(buckets, block), nth + 1
        yield from now.batches(task << 24 | nth)

    schema = _BLOCKS.format(kind)
    rows.mapInArrow(run, schema).sortWithinPartitions("bucket", "token").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    written = spark.read.schema(schema).parquet(f"{path}/blocks")
    found = written.where("bucket >= 0").groupBy("bucket", "token").agg(F.sum("n").cast("long").alias("df"))
    found.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/tokens")
    total = written.where("bucket = -1").agg(F.sum(F.col("tf")[0].cast("long")).alias("docs"), F.sum(F.col("tf")[1].cast("long")).alias("texts"), F.sum(F.col("dl")[0].cast("long")).alias("words")).first()
    n = total["docs"] or 0
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = _tokens(spark, path).agg(F.avg(raw).alias("m")).first()["m"]
    spark.createDataFrame([(n, (total["words"] / total["texts"] if total["texts"] else 0.0) or 1.0, float(mean or 0.0), buckets, kind)], "n_docs long, avgdl double, mean_idf double, buckets int, id_type string").coalesce(1).write.parquet(f"{path}/stats")


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, df long, bucket int").parquet(f"{path}/tokens")


def _scores(k: int, k1: float, b: float, avgdl: float, grouped: bool):
    """For the blocks of a segment and the weights of some queries: the best k documents of each query."""

    def part(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("token", "ascending"), ("block", "ascending")]).combine_chunks()
        words = left.column("token").combine_chunks().dictionary_encode()
        token_at = np.searchsorted(words.indices.to_numpy(), np.arange(len(words.dictionary) + 1))
        ids = left.column("ids").combine_chunks()
        first = np.r_[0, np.cumsum(pc.list_value_length(ids).to_numpy())]
        named = ids.flatten().dictionary_encode()
        doc, n_docs = named.indices.to_numpy(), len(named.dictionary)
        flat = lambda c: left.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        parts = part(flat("tf"), flat("dl"))
        most = part(left.column("max_tf").to_numpy(), left.column("min_dl").to_numpy())
        right = right.sort_by([("query_id", "ascending")])
        query_ids = right.column("query_id").combine_chunks()
        known = pc.index_in(right.column("token").combine_chunks(), words.dictionary).to_pylist()
        weights, wanted = right.column("w").to_pylist(), right.column("wanted").to_pylist()
        owner = [None] * n_docs
        if grouped:
            owner = np.empty(n_docs, object)
            owner[doc] = np.array(left.column("groups").combine_chunks().flatten().to_pylist(), object)
        starts = np.flatnonzero(np.r_[True, pc.not_equal(query_ids[1:], query_ids[:-1]).to_numpy(zero_copy_only=False)]) if len(query_ids) else np.empty(0, int)
        out: list[tuple] = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(query_ids)]):
            own = [(t, w) for t, w in zip(known[lo:hi], weights[lo:hi]) if t is not None]
            if not own:
                continue
            fits = None if wanted[lo] is None else owner == wanted[lo]
            blocks = [(np.arange(token_at[t], token_at[t + 1]), w) for t, w in own]
            s = _sum(blocks, _worth(blocks, most, k, first, doc, parts, n_docs, fits), first, doc, parts, n_docs)
            s = np.round(s, 6)
            good = np.flatnonzero(s > 0 if fits is None else (s > 0) & fits)
            if len(good) > k:
                least = -np.partition(-s[good], k - 1)[k - 1]
                good = good[s[good] >= least]
            named_rows = sorted(zip((-s[good]).tolist(), named.dictionary.take(pa.array(good)).to_pylist()))[:k]
            out += [(lo, i, -x) for x, i in named_rows]
        rows, names, scores = zip(*out) if out else ((), (), ())
        return pa.table([query_ids.take(pa.array(rows, pa.int64())), pa.array(names, named.type.value_type), pa.array(scores, pa.float64())], ["query_id", "chunk_id", "score"])

    return run


def _sum(blocks: list, keep: list[np.ndarray] | None, first: np.ndarray, doc: np.ndarray, parts: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores of a segment's documents from the kept blocks of a query's tokens."""
    s = np.zeros(n_docs)
    for j, (own, w) in enumerate(blocks):
        own = own if keep is None else own[keep[j]]
        if len(own) and own[-1] - own[0] == len(own) - 1:  # blocks in a row are one slice
            at = slice(first[own[0]], first[own[-1] + 1])
            s += np.bincount(doc[at], weights=w * parts[at], minlength=n_docs)
        else:
            for x in own.tolist():
                at = slice(first[x], first[x + 1])
                s[doc[at]] += w * parts[at]
    return s


def _worth(blocks: list, most: np.ndarray, k: int, first: np.ndarray, doc: np.ndarray, parts: np.ndarray, n_docs: int, fits: np.ndarray | None) -> list[np.ndarray] | None:
    """Of each token the blocks that may hold one of the best k documents, by the blocks' maxima; None for all.

    A document of a block has at most the block's bound and the highest bound of every
    other token. What the best block of every token gives alone is a lower bound of scores.
    """
    if any(w <= 0 for _, w in blocks) or max(len(own) for own, _ in blocks) < 2:
        return None
    bounds = [w * most[own] for own, w in blocks]
    best = [np.arange(len(x)) == x.argmax() for x in bounds]
    sure = _sum(blocks, best, first, doc, parts, n_docs)
    sure = sure if fits is None else sure[fits]
    if len(sure) < k:
        return None
    least, top = np.partition(sure, -k)[-k], sum(x.max() for x in bounds)
    return [x + (top - x.max()) >= least - 1e-5 for x in bounds]


def search_postings(queries: DataFrame, path: str, k: int = 10, query_id: str = "query_id", query_text: str = "query", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, max_weights: int = 200_000, wanted: str | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: what bm25_topk finds, from the stored index.

    Only buckets with a token of the queries are opened. Queries are dealt out to blocks of about
    ``max_weights`` weights; each meets each segment in a group of its own, so neither the
    number of queries nor that of documents is bounded by a task or the driver.
    """
    spark = queries.sparkSession
    stats = spark.read.parquet(f"{path}/stats").first()
    group = F.col(wanted).cast("string") if wanted else F.lit(None).cast("string")
    asked = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("query_id"), group.alias("wanted"), F.explode(tokens(F.col(query_text))).alias("token"))
    asked = asked.groupBy("query_id", "wanted", "token").agg(F.count(F.lit(1)).alias("qtf")).withColumn("bucket", bucket_of(F.col("token"), stats["buckets"]))
    size = asked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row a bucket
    used, deals = [r["bucket"] for r in size], max(1, -(-sum(r["n"] for r in size) // max_weights))
    raw = F.log(F.lit(stats["n_docs"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = F.when(raw < 0, F.lit(stats["mean_idf"] * epsilon)).otherwise(raw)
    deal = F.pmod(F.xxhash64("query_id"), F.lit(deals)).cast("int")
    weights = asked.join(_tokens(spark, path).where(F.col("bucket").isin(used)), ["bucket", "token"]).select(deal.alias("deal"), "query_id", "wanted", "token", (F.col("qtf") * idf).alias("w"))
    blocks = spark.read.schema(_BLOCKS.format(stats["id_type"])).parquet(f"{path}/blocks").where(F.col("bucket").isin(used))
    # Counted: up to a million tokens are sent to the blocks, which are then exchanged only where they match.
    matched = blocks.join(small_side(weights.select("deal", "token").distinct(), 1_000_000), "token")
    there = matched.select("segment", "deal").distinct()
    kind = queries.schema[query_id].dataType.simpleString()
    left = matched.select("segment", "deal", "token", "block", "ids", "tf", "dl", "groups", "max_tf", "min_dl").groupBy("segment", "deal")
    right = weights.join(there, "deal").select(F.col("segment").alias("s"), F.col("deal").alias("d"), "query_id", "wanted", "token", "w")
    met = left.cogroup(right.groupBy("s", "d")).applyInArrow(_scores(k, k1, b, stats["avgdl"], wanted is not None), f"query_id {kind}, chunk_id {stats['id_type']}, score double")
    return ranked(met, k)
