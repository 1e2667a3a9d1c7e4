"""Dense and sparse retrieval, fusion, boosts, reranking and confidence gates.

Queries are rows: every operator answers all of them at once. Ties go to the
smaller chunk id everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import lexicons as lx
from quern.functions.text import tokens
from quern.functions.vectors import overlap_score


def ranked(scores: DataFrame, k: int | None = None, by: str = "query_id", score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """Adds rank (1-based); with k keeps the best k, cut before the shuffle by a window group limit."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie)))
    return out if k is None else out.where(F.col("rank") <= k)


_QUERY_BLOCK = 256
_NOWHERE = np.iinfo(np.int64).max


def _best(scores: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k highest scores with their places, smaller places first among equal scores; -inf is no candidate."""
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero((scores >= least) & (scores > -np.inf))  # ties at the edge are all in
    s, n = scores[row, col], places[row, col]
    order = np.lexsort((n, -s, row))
    row, s, n = row[order], s[order], n[order]
    at = np.arange(len(row)) - np.searchsorted(row, np.arange(len(scores)))[row]
    keep = at < k
    out = np.full((len(scores), k), -np.inf), np.full((len(scores), k), _NOWHERE)
    for o, x in zip(out, (s, n)):
        o[row[keep], at[keep]] = x[keep]
    return out


class Kept:
    """The best k names of each query so far, whatever type names have; a smaller name comes first among equal scores."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.places, self.names = k, np.full((n, k), -np.inf), np.full((n, k), _NOWHERE), None

    def add(self, names: np.ndarray, score: Callable[[slice], np.ndarray]) -> None:
        """score: of a block of queries with all the names, -inf for no candidate."""
        known = len(self.names) if self.names is not None else 0
        both, at = np.unique(np.concatenate([self.names, names]) if known else names, return_inverse=True)
        there = self.scores > -np.inf
        places = np.full(self.places.shape, _NOWHERE)
        places[there] = at[:known][self.places[there]]
        for lo in range(0, len(self.scores), _QUERY_BLOCK):
            part = slice(lo, lo + _QUERY_BLOCK)
            new = score(part)
            self.scores[part], places[part] = _best(np.hstack([self.scores[part], new]), np.hstack([places[part], np.broadcast_to(at[known:], new.shape)]), self.k)
        there = self.scores > -np.inf
        used, self.places[there] = np.unique(places[there], return_inverse=True)
        self.names = both[used]

    def rows(self, query_ids: pa.Array, name_type: pa.DataType) -> pa.RecordBatch:
        there = self.scores > -np.inf
        names = self.names[self.places[there]] if self.names is not None else np.empty(0, object)
        asked = query_ids.take(pa.array(np.repeat(np.arange(len(there)), there.sum(1)), pa.int64()))
        return pa.RecordBatch.from_arrays([asked, pa.array(names, name_type), pa.array(self.scores[there])], ["query_id", "chunk_id", "score"])


def _scored(queries: DataFrame, corpus: DataFrame) -> str:
    """The schema of query_id, chunk_id, score; ids keep their types."""
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {corpus.schema['chunk_id'].dataType.simpleString()}, score double"


def _allowed(wanted: list | None, groups: list | None) -> Callable[[slice], np.ndarray] | None:
    """For a block of queries and all rows: whether a row's group is the one that a query wants; one that wants none takes all."""
    if wanted is None or groups is None:
        return None
    number = {g: k for k, g in enumerate(dict.fromkeys(groups), 1)}
    rows, asked = np.array([number[g] for g in groups]), np.array([-1 if w is None else number.get(w, 0) for w in wanted])
    return lambda part: (asked[part, None] == -1) | (asked[part, None] == rows[None, :])


def _asked(queries: DataFrame, query_id: str, vector: str, wanted: str | None = None) -> DataFrame:
    group = F.col(wanted).cast("string") if wanted else F.lit(None).cast("string")
    return queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v"), group.alias("wanted")).where("v is not null")


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors without nulls as rows, from the flat buffer; different lengths are an error."""
    sizes = set(pc.unique(pc.list_value_length(column)).to_pylist())
    if len(sizes) > 1:
        raise ValueError(f"vectors of different dimensions: {sorted(sizes)}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(got: pa.Table, queries: DataFrame, corpus: DataFrame, k: int, chunk_id: str, vector: str, group: str | None) -> DataFrame:
    """query_id, chunk_id, score: at most k rows of each task for each row (query_id, v, wanted) of ``got``, which travels to the tasks."""
    ids = got.column("query_id").combine_chunks()
    q = _matrix(got.column("v").combine_chunks()) if got.num_rows else np.zeros((0, 0))
    q_norm = np.sqrt((q * q).sum(1))
    wanted = got.column("wanted").to_pylist() if group else None
    grouped = F.col(group).cast("string") if group else F.lit(None).cast("string")
    rows = corpus.select(F.col(chunk_id).alias("chunk_id"), F.col(vector).cast("array<double>").alias("v"), grouped.alias("g")).where("chunk_id is not null and v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        kept, name_type = Kept(len(ids), k), None
        for batch in batches:
            if not batch.num_rows:
                continue
            name_type, c = batch.column(0).type, _matrix(batch.column(1))
            if c.shape[1] != q.shape[1]:
                raise ValueError(f"queries have {q.shape[1]} dimensions, rows {c.shape[1]}")
            c_norm, fits = np.sqrt((c * c).sum(1)), _allowed(wanted, batch.column(2).to_pylist() if wanted else None)

            def score(part: slice) -> np.ndarray:
                s = np.round(q[part] @ c.T / (q_norm[part, None] * c_norm[None, :] + 1e-8), 12)
                return s if fits is None else np.where(fits(part), s, -np.inf)

            kept.add(batch.column(0).to_numpy(zero_copy_only=False), score)
        if name_type is not None:
            yield kept.rows(ids, name_type)

    return rows.mapInArrow(run, _scored(queries, rows))


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, query_id: str = "query_id", chunk_id: str = "chunk_id", vector: str = "embedding", max_queries: int = 20_000, wanted: str | None = None, group: str | None = None) -> DataFrame:
    """query_id, chunk_id, score (cosine), rank: exact, one matrix product per Arrow batch. Ids may have any type with an order.

    The queries travel to every task, so their number is checked against
    ``max_queries``; dense_topk_blocks takes any number. A task emits at most k
    rows per query, whatever the size of its partition. Where a query's ``wanted``
    is not null, only rows with that ``group`` are ranked for it. Rows without a
    vector or an id are no candidates; vectors of another dimension are an error.
    """
    asked = _asked(queries, query_id, vector, wanted)
    got = asked.limit(max_queries + 1).toArrow()
    if got.num_rows > max_queries:
        raise ValueError(f"more than {max_queries} queries; ask them by dense_topk_blocks")
    return ranked(_nearest(got, asked, corpus, k, chunk_id, vector, group), k)


def dense_topk_blocks(queries: DataFrame, corpus: DataFrame, k: int = 10, query_id: str = "query_id", chunk_id: str = "chunk_id", vector: str = "embedding", max_queries: int = 20_000, wanted: str | None = None, group: str | None = None) -> DataFrame:
    """dense_topk for any number of queries: blocks of at most ``max_queries``, one pass over the corpus each, ranked together.

    A task holds one block; the driver holds all query vectors, read once.
    """
    asked = _asked(queries, query_id, vector, wanted)
    got = asked.toArrow()
    blocks = [_nearest(got.slice(at, max_queries), asked, corpus, k, chunk_id, vector, group) for at in range(0, max(1, got.num_rows), max_queries)]
    return ranked(reduce(DataFrame.unionByName, blocks), k)


def small_side(df: DataFrame, limit: int) -> DataFrame:
    """df with a broadcast hint if it was counted to have at most ``limit`` rows; else df as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def corpus_stats(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """One row: n_docs, avgdl."""
    return docs.select(F.size(tokens(F.col(text_col))).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def token_idf(docs: DataFrame, text_col: str = "text", epsilon: float = 0.25) -> DataFrame:
    """token, df, idf. Negative idf becomes epsilon x the mean raw idf of the vocabulary."""
    # A join by token puts this filter under one of the two uses of df; where both have it, they share one scan.
    df = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token")).where("token is not null").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    raw = df.crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, F.col("mean_idf") * epsilon).otherwise(F.col("raw")).alias("idf"))


def token_weights(queries: DataFrame, docs: DataFrame, query_id: str = "query_id", query_text: str = "query", text_col: str = "text", epsilon: float = 0.25) -> DataFrame:
    """query_id, token, w (times in the query x idf) of the queries' tokens that documents have."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query_text))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))
    return asked.join(token_idf(docs, text_col, epsilon), "token").select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("w"))


def bm25_scores(queries: DataFrame, docs: DataFrame, query_id: str = "query_id", query_text: str = "query", chunk_id: str = "chunk_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, broadcast_tokens: int = 500_000) -> DataFrame:
    """query_id, chunk_id, score for pairs that share a token: one row each, so for few queries or rare words; bm25_topk makes no pairs.

    The queries' tokens are counted; up to ``broadcast_tokens`` of them filter the
    documents' tokens before any shuffle, more of them join by shuffle.
    """
    weights = token_weights(queries, docs, query_id, query_text, text_col, epsilon)
    asked = queries.select(F.explode(tokens(F.col(query_text))).alias("token")).distinct()
    words = docs.select(F.col(chunk_id).alias("chunk_id"), tokens(F.col(text_col)).alias("t"))
    postings = words.select("chunk_id", F.size("t").alias("dl"), F.explode("t").alias("token")).join(small_side(asked, broadcast_tokens), "token", "left_semi").groupBy("chunk_id", "token", "dl").agg(F.count(F.lit(1)).alias("f"))
    pairs = postings.join(weights, "token").crossJoin(F.broadcast(corpus_stats(docs, chunk_id, text_col).select("avgdl")))
    part = F.col("w") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return pairs.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))


_COUNTS_HELD = 400_000


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, n: how often lists hold each token; a task's counts are merged as they come, and leave it in parts where many differ."""
    held, rows = [], 0
    for batch in batches:
        counts = pc.value_counts(batch.column(0).flatten())
        held.append(pa.table([counts.field("values"), counts.field("counts")], ["token", "n"]))
        rows += len(counts)
        if rows > _COUNTS_HELD:
            held = [pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])]
            rows = held[0].num_rows
            if 2 * rows > _COUNTS_HELD:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"]).to_batches()


def _counted(asked: pa.Table, docs: DataFrame, text_col: str, broadcast_tokens: int) -> tuple[pa.Table, pa.Table]:
    """(token, df) of the asked tokens and lengths, and (df, n): how many tokens each number of documents has. One scan of the documents.

    A document's length goes through the same count as one more token, " " and the
    number, which no text has. There are at most about the square root of twice the
    corpus' words of different lengths, and of different df.
    """
    words = docs.select(tokens(F.col(text_col)).alias("t"))
    length = F.concat(F.lit(" "), F.coalesce(F.size("t").cast("string"), F.lit("")))
    lists = words.select(F.array_append(F.coalesce(F.array_distinct("t"), F.array().cast("array<string>")), length).alias("said"))
    df = lists.mapInArrow(_token_counts, "token string, n long").groupBy("token").agg(F.sum("n").alias("df"))
    vocabulary = pc.unique(asked.column("token"))
    known = docs.sparkSession.createDataFrame(pa.table({"token": vocabulary, "asked": pa.repeat(True, len(vocabulary))}), "token string, asked boolean")
    marked = df.join(F.broadcast(known) if len(vocabulary) <= broadcast_tokens else known, "token", "left")
    is_length = F.startswith("token", F.lit(" "))
    named = F.when(F.col("asked") | is_length, F.col("token"))
    got = marked.groupBy(named.alias("token"), is_length.alias("is_length"), "df").agg(F.count(F.lit(1)).alias("n")).toArrow()
    return got.filter(pc.is_valid(got.column("token"))).select(["token", "df"]), got.filter(pc.invert(got.column("is_length"))).select(["df", "n"])


def _weighted(asked: pa.Table, named: pa.Table, spread: pa.Table, epsilon: float) -> tuple[pa.Table, float]:
    """The asked tokens that documents have, with w (times in the query x idf), by query and token; and the mean length."""
    token, df = named.column("token").to_pylist(), named.column("df").to_pylist()
    lengths = [(int(t[1:]) if t[1:] else None, n) for t, n in zip(token, df) if t[0] == " "]
    n_docs, texts = sum(n for _, n in lengths), sum(n for size, n in lengths if size is not None)
    raw = lambda df: np.log(n_docs - df + 0.5) - np.log(df + 0.5)
    mean = float(np.average(raw(spread.column("df").to_numpy()), weights=spread.column("n").to_numpy())) if spread.num_rows else 0.0
    at = pc.index_in(asked.column("token"), named.column("token").combine_chunks())
    asked, at = asked.filter(pc.is_valid(at)), at.drop_null().to_numpy()
    idf = raw(named.column("df").to_numpy()[at])
    w = asked.column("qtf").to_numpy() * np.where(idf < 0, mean * epsilon, idf)
    average = sum(size * n for size, n in lengths if size is not None) / texts if texts else 0.0
    return asked.append_column("w", pa.array(w, pa.float64())).sort_by([("query_id", "ascending"), ("token", "ascending")]), average or 1.0


def _bm25_best(got: pa.Table, avgdl: float, docs: DataFrame, query_schema: DataFrame, k: int, chunk_id: str, text_col: str, group: str | None, k1: float, b: float) -> DataFrame:
    """query_id, chunk_id, score above 0: at most k rows of each task for each query of ``got`` (query_id, wanted, token, w)."""
    got = got.sort_by([("query_id", "ascending")])
    ids = pc.unique(got.column("query_id").combine_chunks())
    query = pc.index_in(got.column("query_id").combine_chunks(), ids).to_numpy()
    words = got.column("token").combine_chunks().dictionary_encode()
    token, vocabulary = words.indices.to_numpy(), words.dictionary
    by_token = np.argsort(token, kind="stable")
    w, query, first = got.column("w").to_numpy()[by_token], query[by_token], np.searchsorted(token[by_token], np.arange(len(vocabulary) + 1))
    wanted = dict(zip(got.column("query_id").to_pylist(), got.column("wanted").to_pylist())) if group else None
    wanted = [wanted[i] for i in ids.to_pylist()] if group else None
    grouped = F.col(group).cast("string") if group else F.lit(None).cast("string")
    # Documents without tokens go below: a filter by t here would find the tokens twice.
    rows = docs.select(F.col(chunk_id).alias("chunk_id"), tokens(F.col(text_col)).alias("t"), grouped.alias("g")).where("chunk_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        kept, name_type = Kept(len(ids), k), None
        for whole in batches:
            for at in range(0, whole.num_rows, _QUERY_BLOCK):
                batch = whole.slice(at, _QUERY_BLOCK)
                batch = batch.filter(pc.greater(pc.list_value_length(batch.column(1)), 0))
                name_type, dl = batch.column(0).type, pc.list_value_length(batch.column(1)).to_numpy()
                said = batch.column(1).flatten().dictionary_encode()
                known = pc.fill_null(pc.index_in(said.dictionary, vocabulary), -1).to_numpy()[said.indices.to_numpy()]
                doc = np.repeat(np.arange(len(dl)), dl)[known >= 0]
                if not len(doc):
                    continue
                used, column = np.unique(known[known >= 0], return_inverse=True)
                f = np.bincount(doc * len(used) + column, minlength=len(dl) * len(used)).reshape(len(dl), -1)
                part_of = f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avgdl)[:, None])
                # Weights of the used tokens, by query: a block of queries is a slice of them.
                sizes = first[used + 1] - first[used]
                entry = np.repeat(first[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                order = np.argsort(query[entry], kind="stable")
                q_at, t_at, w_at = query[entry][order], np.repeat(np.arange(len(used)), sizes)[order], w[entry][order]
                fits = _allowed(wanted, batch.column(2).to_pylist() if wanted else None)

                def score(part: slice) -> np.ndarray:
                    n = min(part.stop, len(ids)) - part.start
                    lo, hi = np.searchsorted(q_at, (part.start, part.start + n))
                    weights = np.zeros((n, len(used)))
                    weights[q_at[lo:hi] - part.start, t_at[lo:hi]] = w_at[lo:hi]
                    s = np.round(weights @ part_of.T, 6)
                    return np.where((s > 0) if fits is None else (s > 0) & fits(part), s, -np.inf)

                kept.add(batch.column(0).to_numpy(zero_copy_only=False), score)
        if name_type is not None:
            yield kept.rows(ids, name_type)

    return rows.mapInArrow(run, _scored(query_schema, rows))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 10, query_id: str = "query_id", query_text: str = "query", chunk_id: str = "chunk_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, max_weights: int = 500_000, wanted: str | None = None, group: str | None = None) -> DataFrame:
    """The best k per query with a score above 0; a document is scored where it is, so at most k rows of a task and query are shuffled.

    The weights of the queries' tokens travel to the tasks, in blocks of queries
    with about ``max_weights`` of them, one pass over the documents each; the driver
    holds them all. Where a query's ``wanted`` is not null, only documents with that
    ``group`` are ranked for it. Null ids are neither asked nor found.
    """
    asked = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query_text))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))
    group_of = queries.select(F.col(query_id).alias("query_id"), (F.col(wanted).cast("string") if wanted else F.lit(None).cast("string")).alias("wanted"))
    asked = asked.join(group_of, "query_id") if wanted else asked.withColumn("wanted", F.lit(None).cast("string"))
    words = asked.toArrow()
    got, avgdl = _weighted(words, *_counted(words, docs, text_col, max_weights), epsilon)
    blocks, at = [], 0
    ids = got.column("query_id").to_pylist()
    while at < len(ids) or not blocks:
        end = min(len(ids), at + max_weights)
        while end < len(ids) and ids[end] == ids[end - 1]:  # a query is in one block
            end += 1
        blocks.append(_bm25_best(got.slice(at, end - at), avgdl, docs, asked, k, chunk_id, text_col, group, k1, b))
        at = max(end, at + 1)
    return ranked(reduce(DataFrame.unionByName, blocks), k)


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, dense_weight: Column | float = 0.7, sparse_weight: Column | float = 0.3, k: int = 20) -> DataFrame:
    """query_id, chunk_id, score from two ranked lists (query_id, chunk_id, rank, any weight columns). One shuffle."""
    as_col = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    sides = [side.select("query_id", "chunk_id", (as_col(w) / (k + F.col("rank"))).alias("part"), F.lit(n).alias("n")) for side, w, n in ((dense, dense_weight, 0), (sparse, sparse_weight, 1))]
    # Each side has one row per pair, so the two sums are single values added in a fixed order.
    both = sides[0].unionByName(sides[1]).groupBy("query_id", "chunk_id").agg(*[F.coalesce(F.sum(F.when(F.col("n") == n, F.col("part"))), F.lit(0.0)).alias(f"p{n}") for n in (0, 1)])
    return both.select("query_id", "chunk_id", (F.col("p0") + F.col("p1")).alias("score"))


def channel_weights(numeric_heavy: Column) -> tuple[Column, Column]:
    """Dense and sparse weight: .7/.3, turned round for numeric queries."""
    return F.when(numeric_heavy, 0.3).otherwise(0.7), F.when(numeric_heavy, 0.7).otherwise(0.3)


def section_boost(query: Column, section: Column, boosts: dict[str, float] | None = None) -> Column:
    """Factor for a result whose section shares words, as white space parts them, with the query; a key may be any part of a shared word."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda w: w != ""))
    q, s = words(query), words(section)
    shared = F.array_intersect(q, s)
    has = lambda key: F.exists(shared, lambda t: F.contains(t, F.lit(key)))
    best = F.greatest(F.lit(1.0), *[F.when(has(key), F.lit(float(v))).otherwise(F.lit(1.0)) for key, v in (boosts or lx.SECTION_BOOSTS).items()])
    return F.when(F.size(shared) > 0, best + F.size(shared) * 0.1 / F.greatest(F.size(q), F.lit(1))).otherwise(F.lit(1.0))


def filter_or_relax(results: DataFrame, keep: Column, by: str = "query_id", relax: Column | None = None) -> DataFrame:
    """Rows that fit; of queries where none fits (and which may relax), all. One window, no second job."""
    flagged = results.withColumn("_fits", keep).withColumn("_any", F.max(F.col("_fits").cast("int")).over(Window.partitionBy(by)))
    none = F.coalesce(F.col("_any"), F.lit(0)) == 0
    return flagged.where(F.col("_fits") | (none if relax is None else none & relax)).drop("_fits", "_any")


def rerank(results: DataFrame, k: int = 3, scorer: Callable[[Column, Column], Column] = overlap_score, query_text: str = "query", text_col: str = "text") -> DataFrame:
    """Best k by a pair scorer; a failed (null) score counts as 0."""
    scored = results.drop("rank").withColumn("score", F.coalesce(scorer(F.col(query_text), F.col(text_col)), F.lit(0.0)))
    return ranked(scored, k)


def confidence(results: DataFrame, threshold: float = 0.1, margin: float = 0.05) -> DataFrame:
    """Per query: top_score, second_score, margin, is_confident, reason. A single result has margin 0."""
    tops = results.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    gap = F.when(F.col("second").isNull(), F.lit(0.0)).otherwise(F.col("top_score") - F.col("second"))
    told = tops.select("query_id", "top_score", F.coalesce("second", F.lit(0.0)).alias("second_score"), gap.alias("margin"))
    low, narrow = F.col("top_score") < threshold, F.col("margin") < margin
    return told.withColumn("is_confident", ~low & ~narrow).withColumn("reason", F.when(low, "low_score").when(narrow, "low_margin").otherwise("confident"))


def gate(told: DataFrame, min_score: float = -1.0) -> DataFrame:
    """should_proceed, fallback_action, confidence_level on the rows of confidence()."""
    hopeless = F.col("top_score") < min_score
    level = F.when(hopeless, "very_low").when(~F.col("is_confident"), "low").otherwise("high")
    return told.withColumn("confidence_level", level).withColumn("should_proceed", ~hopeless & F.col("is_confident")).withColumn("fallback_action", F.when(hopeless | ~F.col("is_confident"), "dont_know"))


def adaptive_thresholds(kind: Column, threshold: float = 0.1, margin: float = 0.05) -> tuple[Column, Column]:
    """Thresholds by kind of query: eased for numeric, raised for comparison, slightly eased for specific ones."""
    scale = lambda a, b: (F.lit(threshold * a), F.lit(margin * b))
    table = {"numeric": scale(0.8, 0.5), "comparison": scale(1.2, 1.5), "specific": scale(0.9, 0.9)}
    pick = lambda n: F.coalesce(*[F.when(kind == name, v[n]) for name, v in table.items()], F.lit((threshold, margin)[n]))
    return pick(0), pick(1)


def rerank_statistics(results: DataFrame) -> DataFrame:
    """Per query: count, mean, population deviation, extremes, upper median, the best three, and three score ranges."""
    s = F.col("score")
    got = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(s).alias("mean_score"),
        F.stddev_pop(s).alias("std_score"),
        F.min(s).alias("min_score"),
        F.max(s).alias("max_score"),
        F.array_sort(F.collect_list(s)).alias("all"),
        F.count_if(s > 0.5).alias("n_high"),
        F.count_if((s >= 0.2) & (s <= 0.5)).alias("n_medium"),
        F.count_if(s < 0.2).alias("n_low"),
    )
    return got.select("query_id", "n", "mean_score", "std_score", "min_score", "max_score", F.element_at("all", (F.floor(F.col("n") / 2) + 1).cast("int")).alias("median_score"), F.slice(F.reverse("all"), 1, 3).alias("top_scores"), "n_high", "n_medium", "n_low")


def freshness_boost(score: Column, date: Column, today: Column, half_life_days: float = 180.0, floor: float = 0.5) -> Column:
    """A score that falls with the age of its source, by half each half-life, to ``floor`` of it at least; an unknown date counts as oldest."""
    age = F.greatest(F.lit(0), F.datediff(today, date))
    return score * F.when(date.isNull(), F.lit(floor)).otherwise(F.greatest(F.lit(floor), F.pow(F.lit(0.5), age / F.lit(half_life_days))))


def generic_penalty(score: Column, section: Column, generic: tuple[str, ...] = ("Document", "Untitled Section"), factor: float = 0.8) -> Column:
    """A lower score for chunks whose section says nothing."""
    return F.when(section.isNull() | section.isin(*generic), score * F.lit(factor)).otherwise(score)
