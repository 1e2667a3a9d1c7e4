"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Training reads a bounded sample of labelled rows (``max_rows``, in a fixed
pseudo-random order of the id). Their features, at most ``2**bits`` places a
text, are made where the texts are; one task then learns from all of them in a
fixed order. The update keeps a rate per coordinate, and its L1 term leaves most
weights at exactly zero: what the driver and the executors get is the list of
non-zero places and weights, in practice some thousands, whatever the size of
the corpus.

Scoring reads whole texts. A score is the logistic of the bias and the weights
of the features present. Only the text enters it.

Defined results: null and empty texts score the bias alone; labels that are
null, or of ids without a document, are left out; of several labels of an id the
largest counts, of several texts of a labelled id the one whose places come
first; without any labels every score is 0.5, which predicts toxic in a query
but drops nothing; repeated rows and ids, null ids among them, are scored row by
row; an empty table gives no rows; texts of any length are read whole; other
columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import pieces, sampled
from quern.llm.features import WordHasher


@dataclass
class SparseModel:
    bits: int
    bias: float
    places: np.ndarray  # int32, sorted
    weights: np.ndarray  # float32

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.places] = self.weights
        return w


class Ftrl:
    """FTRL-proximal for logistic loss over presence features.

    Toxic rows are rare and mostly hold several toxic words, so they weigh more:
    one such word alone must outweigh the bias.
    """

    def __init__(self, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.5, positive_weight: float = 3.0):
        self.bits, self.alpha, self.beta, self.l1, self.l2, self.positive_weight = bits, alpha, beta, l1, l2, positive_weight
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last place is the bias

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << self.bits, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.append(places, 1 << self.bits)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label) * (self.positive_weight if label else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g

    def model(self) -> SparseModel:
        w = self.weights(np.arange((1 << self.bits) + 1))
        places = np.flatnonzero(w[:-1])
        return SparseModel(self.bits, float(w[-1]), places.astype(np.int32), w[places].astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 8_000, epochs: int = 4, bits: int = 20, seed: str = "toxicity") -> SparseModel:
    """A model from at most ``max_rows`` labelled rows; ``labels`` has only rows that may be learnt from."""
    lab = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    chosen = sampled(lab, id_col, max_rows, seed)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col(id_col)).select("_id", "_text", "_label")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(bits)
        for batch in pieces(batches):
            places = [hasher.places(t or "").astype(np.int32) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([y > 0 for y in batch.column("_label").to_pylist()], pa.bool_()), pa.array(places, pa.list_(pa.int32()))], ["id", "y", "places"])

    def learnt(sample: pa.Table) -> pa.Table:
        model = train(sample, bits, epochs)
        return pa.table({"bias": pa.array([model.bias]), "places": pa.array([model.places], pa.list_(pa.int32())), "weights": pa.array([model.weights], pa.list_(pa.float32()))})

    # Bounded by max_rows: the ids are broadcast, an id has one row after the aggregate, and one task learns from all.
    found = rows.mapInArrow(features, f"id {rows.schema['_id'].dataType.simpleString()}, y boolean, places array<int>")
    sample = found.groupBy("id").agg(F.max("y").alias("y"), F.min("places").alias("places"))
    got = sample.groupBy(F.lit("all")).applyInArrow(learnt, "bias double, places array<int>, weights array<float>").toArrow()
    if not got.num_rows:
        return Ftrl(bits).model()
    return SparseModel(bits, got.column("bias")[0].as_py(), np.array(got.column("places")[0].values, np.int32), np.array(got.column("weights")[0].values, np.float32))


def train(sample: pa.Table, bits: int, epochs: int) -> SparseModel:
    """A model from id, y, places, in a fixed shuffled order of the ids."""
    ids, y = sample.column("id").to_pylist(), sample.column("y").to_pylist()
    lists = sample.column("places").combine_chunks()
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    order = sorted(range(len(ids)), key=ids.__getitem__)
    np.random.default_rng(7).shuffle(order)
    ftrl = Ftrl(bits)
    for _ in range(epochs):
        for k in order:
            ftrl.learn(flat[ends[k] : ends[k + 1]], int(y[k]))
    return ftrl.model()


def score(docs: DataFrame, model: SparseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score for every document."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_scorer(model, "text", ["id"]), f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def _scorer(model: SparseModel, text_col: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(model.bits, weights=model.dense())
        for batch in pieces(batches):
            logits = np.array([model.bias + hasher.total(t or "") for t in batch.column(text_col).to_pylist()])
            scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, "score"])

    return run


def drop_toxic(docs: DataFrame, model: SparseModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score at most the threshold, with all their columns. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(model.bits, weights=model.dense())
        edge = np.log(threshold / (1 - threshold))
        at = names.index(text_col)
        for batch in pieces(batches):
            keep = [model.bias + hasher.total(t or "") <= edge for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    names = docs.columns
    return docs.mapInArrow(run, docs.schema)
