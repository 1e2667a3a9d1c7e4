"""Language identification by compression with per-language zstandard dictionaries.

For every language a raw-content dictionary of plain training text is built from
a bounded sample of labelled documents. A text - letters, lower-cased, other
characters as single spaces - is cut into pieces of a few thousand bytes, each
piece is compressed with every dictionary, and the language with the smallest
sum wins. Pieces keep the dictionaries in reach: at the end of a long text its
own beginning would otherwise be the better dictionary. Nothing is left out.

The score falls with the ratio of the best to the second-best size; a text whose
margin is below ``min_margin`` is marked ``rejected`` and keeps its best guess.

Bounds: ``docs_per_lang`` documents of each of the ``max_langs`` languages that
have most documents are learnt from, and ``dict_bytes`` of each language kept; a
document gives words drawn from its whole text, of 4 x ``dict_bytes`` /
``docs_per_lang`` (256 at least) bytes. Documents are drawn by a hash of the id
that counts of ids per language make low enough, and their words where they are.

Equal sizes, which whole bytes can't tell apart, go to the dictionary with the
smaller ideal code length in bits: of an order-0 coder of words whose counts are
the dictionary's.

Defined results: null text and text without a letter are ``und`` with score 0;
without training rows every text is ``und``; remaining ties go to the first
language by code point; rows with null lang or null id teach nothing; rows that
repeat an id and a language teach as one, the one whose drawn words come first;
repeated rows and null ids are predicted row by row; an empty table gives no
rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import hash_unit, pieces, sample_limit

_NO_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    return _NO_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def drawn(text: bytes, size: int) -> list[bytes]:
    """Words from all of the text in a fixed random order, as many as fit into ``size`` bytes; all of a text that fits."""
    words = text.split()
    if len(text) <= size:
        return words
    random.Random(5).shuffle(words)
    return b" ".join(words)[:size].split()


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_lang: int, share: int, max_langs: int, seed: str) -> DataFrame:
    """lang, nth, words: of each language at most ``docs_per_lang`` documents with a letter, each with the words drawn from it."""
    low = hash_unit(seed, F.col(f"`{id_col}`"))
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    sizes = rows.groupBy(F.col(f"`{lang_col}`").cast("string").alias("lang")).agg(F.approx_count_distinct(F.col(f"`{id_col}`")).alias("n"))
    limits = [(r["lang"], sample_limit(docs_per_lang, r["n"])) for r in sizes.orderBy(F.desc("n"), "lang").limit(max_langs).collect()]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = [b" ".join(drawn(plain(t or ""), share)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "h", "id")), pa.array(got, pa.binary())], ["lang", "h", "id", "words"])

    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits for x in pair]), F.col("lang")) if limits else F.lit(0)
    near = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), low.alias("h"), F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.col("h") < limit)
    each = near.mapInArrow(words, "lang string, h long, id string, words binary").where("length(words) > 0").groupBy("lang", "h", "id").agg(F.min("words").alias("words"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    return each.withColumn("nth", nth).where(F.col("nth") <= docs_per_lang).select("lang", "nth", "words")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 200, dict_bytes: int = 65_536, max_langs: int = 200, seed: str = "langid") -> dict[str, bytes]:
    """lang -> dictionary content, from at most docs_per_lang x max_langs documents of ``docs``."""
    # Each document gives an equal share, so one very long document does not fill a dictionary; it is drawn from
    # the whole text, since heads can be licences or quotations. Words are shuffled, so a passage that a text
    # shares with the sample is no long match for one language.
    share = max(256, 4 * dict_bytes // docs_per_lang)
    got: dict[str, list[bytes]] = {}
    # Bounded by docs_per_lang x max_langs x share.
    for row in sample(docs, id_col, text_col, lang_col, docs_per_lang, share, max_langs, seed).orderBy("lang", "nth").toArrow().to_pylist():
        got.setdefault(row["lang"], []).extend(row["words"].split())
    out = {}
    for lang, words in got.items():
        random.Random(5).shuffle(words)
        out[lang] = b" ".join(words)[:dict_bytes]
    return out


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes], piece: int = 2048, level: int = 7):
        self.langs, self.piece = sorted(dictionaries), piece
        self.contents: list[bytes] = [dictionaries[lang] for lang in self.langs]
        self.counts: list[Counter | None] = [None] * len(self.langs)
        self.by = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(dictionaries[lang]), source_size=piece, min_match=4, write_checksum=0, write_content_size=0, write_dict_id=0)
            d.precompute_compress(compression_params=how)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def sizes(self, raw: bytes) -> list[int]:
        pieces = [raw[k : k + self.piece] for k in range(0, len(raw), self.piece)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.by]

    def code_length(self, raw: bytes, k: int) -> float:
        """Bits of an ideal order-0 coder of words with the counts (and one for any other word) of a dictionary."""
        if self.counts[k] is None:
            self.counts[k] = Counter(self.contents[k].split())
        counts = self.counts[k]
        return len(words := raw.split()) * math.log2(counts.total() + 1) - sum(math.log2(counts[w] + 1) for w in words)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """lang, score, margin (how much smaller the best is than the second, as a share)."""
        raw = plain(text) if text else b""
        if not raw or not self.langs:
            return "und", 0.0, 0.0
        sizes = self.sizes(raw)
        least = min(sizes)
        ties = [k for k, size in enumerate(sizes) if size == least]
        best = ties[0] if len(ties) == 1 else min(ties, key=lambda k: (self.code_length(raw, k), k))
        second = min((size for k, size in enumerate(sizes) if k != best), default=2 * least)
        margin = 1 - least / second
        return self.langs[best], min(1.0, 0.5 + 2.5 * margin), margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.02) -> DataFrame:
    """id, lang_pred, score, rejected for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(dictionaries)
        for batch in pieces(batches):
            got = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] < min_margin for g in got], pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
