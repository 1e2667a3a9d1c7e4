"""N-gram Jaccard self-join: MinHash banding, verification on full n-gram sets.

Words are runs of characters other than white space; an n-gram is five words (a
shorter text is one n-gram). Two documents are linked when the Jaccard
similarity of their sets of n-grams is at least the threshold.

1. One pass over whole texts makes, per document, a digest of its n-gram set
   and the band hashes of its MinHash signature. Rows and bands are chosen so
   that a pair at the threshold shares a band with the target recall.
2. Documents with equal sets become one representative with a count (salted
   first), so copies are never compared with each other.
3. Every representative is tied to the smallest one of each of its band
   buckets - a star, linear in the bucket - and the stars' components hold all
   pairs that share a band.
4. Within a component all pairs are verified exactly. Components larger than a
   block are dealt out by hash to blocks; each pair of blocks is one task group
   of bounded size. Pairs are counted where they are verified and never become
   rows; a group gives one row per member: its links and its smallest member
   connected inside the group. These edges' components are the classes.

No pair that shares a band is dropped, whatever the size of its bucket. What a
component of n representatives costs: each text goes to n / block groups, and
the n x n comparisons are dealt out over (n / block)**2 of them.

Defined results: ids may have any type with an order; a document without words
(null, empty, blank) is alone in its class without links; a null id has null
class; rows that share an id are versions of one document and fall into one
class; an empty table gives no rows; texts of any length are read whole; other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import pieces, cut, free_name
from quern.llm.components import connected_components

N = 5
BLOCK = 512
SALTS = 32
_CACHE_WORDS = 150_000


def choose_bands(threshold: float, target_recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows per band, so the fewest false candidates, that reach the recall within max_hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        miss = math.log1p(-(threshold**rows)) if threshold < 1 else -math.inf
        if not miss:  # a shared band is too rare for any number of them
            break
        bands = max(1, math.ceil(math.log(1 - target_recall) / miss))
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no bands reach this recall; raise max_hashes")
    return best


class Signer:
    """n-gram hashes, set digests and band hashes of texts."""

    def __init__(self, bands: int, rows: int, n: int = N, seed: int = 11):
        self.bands, self.rows, self.n = bands, rows, n
        self.of_word = np.random.default_rng(seed + 1).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)  # digests must not depend on bands and rows
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        self.of_row = rng.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)
        self.known: dict[bytes, int] = {}

    def ngrams(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's n-grams."""
        words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        for w in [w for w in dict.fromkeys(words) if w not in known]:
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.frombuffer(array("Q", map(known.__getitem__, words)), np.uint64)
        k = min(self.n, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):  # the multiplier and the turn make the place in the n-gram count
            x = (h[j : len(h) - k + 1 + j] + out) * self.of_word[j]
            out = x ^ (x >> np.uint64(29))
        return np.unique(out)

    def key(self, grams: np.ndarray) -> bytes:
        return blake2b(grams.tobytes(), digest_size=16).digest()

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.uint64(2**64 - 1))
        for at in range(0, len(grams), 2048):
            x = grams[at : at + 2048, None] * self.a + self.b
            low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(0))
        bands = low.reshape(self.bands, self.rows)
        x = (bands * self.of_row).sum(1, dtype=np.uint64)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def _signed(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in pieces(batches):
            keys, hashes = [], []
            for text in batch.column("text").to_pylist():
                grams = signer.ngrams(text or "")
                keys.append(signer.key(grams) if len(grams) else None)
                hashes.append(signer.band_hashes(grams) if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], ["id", "key", "bands"])

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, key binary, bands array<long>")


def exact_sets(texts: list[str], n: int = N) -> list[np.ndarray]:
    """The texts' sets of n-grams as sorted ids, equal exactly where the n-grams are equal word for word."""
    vocabulary: dict[bytes, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t.encode("utf-8", "surrogatepass").split()], np.int64) for t in texts]
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(docs)
    lengths = np.array([len(d) for d in docs], np.int64)
    # Ids of k words are numbered anew from the pairs (id of k - 1 words, next word), so they stay small and exact.
    ids, width = [d for d in docs], len(vocabulary) + 1
    base = 0
    for k in range(1, n + 1):
        if k > 1:
            rows = [np.empty(0, np.int64) if lengths[i] < k else ids[i][: lengths[i] - k + 1] * width + docs[i][k - 1 :] for i in range(len(docs))]
            cuts = np.cumsum([len(r) for r in rows])[:-1]
            flat = np.unique(np.concatenate(rows), return_inverse=True)[1] if rows else np.empty(0, np.int64)
            ids = np.split(flat, cuts)
        for i in np.flatnonzero((lengths == k) if k < n else (lengths >= n)):
            out[i] = np.unique(ids[i]) + base
        base += 1 + max((int(x.max()) for x in ids if len(x)), default=0)
    return out


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the n-grams that both sides have."""
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    at = [[np.searchsorted(shared, x[np.isin(x, shared, assume_unique=True)]) for x in side] for side in (left, right)]
    total = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(shared), width):
        parts = []
        for side in at:
            m = np.zeros((len(side), width), np.float32)
            for i, x in enumerate(side):
                a, b = np.searchsorted(x, (lo, lo + width))
                m[i, x[a:b] - lo] = 1
            parts.append(m)
        total += parts[0] @ parts[1].T
    return total


def _connected(linked: np.ndarray, left: np.ndarray, right: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The smallest place that each place is connected with, by links of left with right places and by equal values of ``same``."""
    low = np.arange(len(same))
    while True:
        before, none = low, len(same)
        low = low.copy()
        low[left] = np.minimum(low[left], np.where(linked, low[right][None, :], none).min(1, initial=none))
        low[right] = np.minimum(low[right], np.where(linked, low[left][:, None], none).min(0, initial=none))
        least = np.full(len(same), none)
        np.minimum.at(least, same, low)
        low = least[same]
        if (low == before).all():
            return low


def _verify(threshold: float):
    """For one pair of blocks: links of each member, and its smallest member connected here; alone: it is all of its component."""

    def run(group: pa.Table) -> pa.Table:
        rep, key, copies, block, bi, bj, blocks, texts = (group.column(c).to_pylist() for c in ("rep", "key", "copies", "block", "bi", "bj", "blocks", "text"))
        signer = Signer(1, 1)
        # Rows that share an id may have other texts; only the representative's own counts, once.
        mine: dict[tuple[int, bytes], int] = {}
        for k, t in enumerate(texts):
            if (rep[k], key[k]) not in mine and signer.key(signer.ngrams(t or "")) == key[k]:
                mine[rep[k], key[k]] = k
        rows = sorted(mine.values(), key=lambda k: (rep[k], key[k]))
        n, rep, key = len(rows), [rep[k] for k in rows], [key[k] for k in rows]
        left = np.array([i for i, k in enumerate(rows) if block[k] == bi[k]], np.int64)
        right = left if bi[0] == bj[0] else np.array([i for i, k in enumerate(rows) if block[k] == bj[k]], np.int64)
        weight, links, linked = np.array([copies[k] for k in rows], np.int64), np.zeros(n, np.int64), np.zeros((len(left), len(right)), bool)
        if len(left) and len(right):
            sets = exact_sets([texts[k] for k in rows])
            both = _overlaps([sets[i] for i in left], [sets[i] for i in right])
            size = np.array([len(x) for x in sets], np.float64)
            linked = both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-9
            if left is right:
                np.fill_diagonal(linked, False)
            else:
                links[right] = linked.T @ weight[left]
            links[left] = linked @ weight[right]
        # Rows are in order of their ids, so the smallest place has the smallest id; rows of one id are one document.
        same = np.cumsum([0] + [a != b for a, b in zip(rep, rep[1:])]) if n else np.empty(0, np.int64)
        low = _connected(linked, left, right, same)
        id_type = group.schema.field("rep").type
        return pa.table({"rep": pa.array(rep, id_type), "key": pa.array(key, pa.binary()), "links": pa.array(links), "root": pa.array([rep[i] for i in low], id_type), "alone": pa.array([blocks[0] == 1] * n, pa.bool_())})

    return run


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, target_recall: float = 0.9995, max_hashes: int = 128, block: int = BLOCK) -> DataFrame:
    """One row per document: id, class_id (smallest id of its class), rep_id, copies (documents with its set), n_links (documents linked to it)."""
    bands, rows = choose_bands(threshold, target_recall, max_hashes)
    signed = cut(_signed(docs, id_col, text_col, bands, rows))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    known = signed.where("id is not null and key is not null")
    salted = known.withColumn("salt", salt).groupBy("key", "salt").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    reps = cut(salted.groupBy("key").agg(F.min("id").alias("rep"), F.sum("n").alias("copies"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask")))

    # Buckets: band number and hash, of representatives only.
    own = known.join(reps.select("key", "rep"), "key").where("id = rep").select("rep", "key", "bands").dropDuplicates(["rep", "key"])
    buckets = own.select("rep", F.posexplode("bands").alias("band", "hash"))
    leaders = buckets.groupBy("band", "hash").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = buckets.join(leaders, ["band", "hash"]).select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    groups = connected_components(stars)

    # Blocks of a component by hash; a component that fits in one block has one.
    members = groups.join(reps.select(F.col("rep").alias("node"), "key", "copies"), "node")
    sizes = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    texts = docs.select(F.col(f"`{id_col}`").alias("node"), F.col(f"`{text_col}`").alias("text"))
    dealt = texts.join(placed, "node").select("comp", "block", "blocks", F.col("node").alias("rep"), "key", "copies", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = dealt.select("comp", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "blocks", "rep", "key", "copies", "text")
    id_type = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    found = cut(pairs.groupBy("comp", "bi", "bj").applyInArrow(_verify(threshold), f"rep {id_type}, key binary, links long, root {id_type}, alone boolean"))
    # A component that one block holds has its classes already; the others' edges are joined over their groups.
    joined = connected_components(found.where("not alone").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = found.where("alone").select(F.col("rep").alias("node"), F.col("root").alias("comp")).distinct().unionByName(joined)

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    told = reps.join(links, "key", "left").join(classes, F.col("rep") == F.col("node"), "left").select("key", "rep", "copies", "mask", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "rep").alias("class_id"))
    spread = told.withColumn("salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s)) != 0)))
    every = signed.select("id", "key").withColumn("salt", salt).join(spread.drop("mask"), ["key", "salt"], "left")
    return every.select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("rep", "id").alias("rep_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, one of each class: its smallest id; rows without an id all stay. All columns."""
    name = free_name(docs, "_gone")
    gone = ngram_join(docs, id_col, text_col, **options).where(F.col("class_id") != F.col(f"`{id_col}`")).select(F.col(f"`{id_col}`").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")
