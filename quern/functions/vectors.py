"""Vector expressions, the offline text encoder and the offline pair scorer."""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.slices import sliced
from quern.functions.text import tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-8))


def hash_encoder(dim: int = 384):
    """Stand-in for a sentence model, which needs weights: signed hashed words, unit length.

    Any UDF of the same shape (string -> array<float>) takes its place.
    """

    def encode(text: str | None) -> np.ndarray:
        v = np.zeros(dim, np.float32)
        for w in (text or "").lower().split():
            h = crc32(w.encode("utf-8", "surrogatepass"))
            v[h % dim] += 1 if h & 0x80000000 else -1
        n = float(np.linalg.norm(v))
        return v / n if n else v

    return sliced(encode, T.ArrayType(T.FloatType()))


def overlap_score(query: Column, text: Column) -> Column:
    """Stand-in for a cross-encoder: Jaccard similarity of the token sets."""
    a, b = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))
