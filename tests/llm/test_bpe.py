import hashlib
import os
import random
import struct

import pytest

from quern.llm import bpe
from quern.llm.queries import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file here")

SPECIAL = ["", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|", "  \n\n x  ", "　 z 😀 नमस्ते 你好", " " * 700, "x" * 9000, "ab" * 400, "!!??", "'s't 'RE'll", "é" * 200, "\x00\x01\x1c\x85 a", "\ufffd\u200b"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    letters = "aeiou thsnrl cdé'\n\t 12!?.,ñ😀世ß "
    return SPECIAL + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(1500)] + ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x400, 0xD7FF)])) for _ in range(40)) for _ in range(300)]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_ids_and_text_equal_the_library(texts, reference):
    enc = bpe.ByteBpe(VOCABULARY)
    got = [b for k in range(0, len(texts), 100) for b in enc.encode_batch(texts[k : k + 100])]
    want = reference.encode_batch(texts, add_special_tokens=False)
    for t, g, w in zip(texts, got, want):
        assert list(struct.unpack(f"<{len(g) // 4}I", g)) == w.ids, t
        assert enc.decode(g) == reference.decode(w.ids, skip_special_tokens=False)
    assert 0 < enc.repaired < enc.speculated  # both ways are taken


def test_odd_numerals_are_split_as_published(reference):
    """In texts whose words are new, known, and known again without the odd characters."""
    enc = bpe.ByteBpe(VOCABULARY)
    rng = random.Random(11)
    letters = "ab 12²½Ⅳ〇一_.\x1c\x1f\n'"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    for texts in (odd[:200], [t.translate({ord(c): "x" for c in "²½Ⅳ〇\x1c\x1f"}) for t in odd], odd, ["x²", "2²"], ["²"], ["²", "²²"]):
        got = [list(struct.unpack(f"<{len(g) // 4}I", g)) for g in enc.encode_batch(texts)]
        assert got == [w.ids for w in reference.encode_batch(texts, add_special_tokens=False)]


def test_odd_characters():
    odd = bpe.odd_characters()
    assert set("²½Ⅳ\x1c\x1f") <= odd and odd.isdisjoint("aé世9٣ _.\n\xa0'😀")
    assert 1155 <= len(odd) < 60_000


def test_merging_long_words_is_the_same(reference):
    enc = bpe.ByteBpe(VOCABULARY)
    rng = random.Random(3)
    for n in (5, 63, 64, 65, 66, 300):
        w = "".join(rng.choice("thesandoin") for _ in range(n)).encode()
        assert enc.merge(w) == enc._merge_long([enc.byte_id[b] for b in w]) == reference.encode(w.decode()).ids


def test_broken_ids_decode_with_replacement():
    enc = bpe.ByteBpe(VOCABULARY)
    ids = enc.encode_batch(["é"])[0]
    lone = struct.pack("<I", enc.byte_id[0xC3])
    assert enc.decode(ids) == "é" and enc.decode(lone) == "\ufffd"


def test_caches_are_bounded(monkeypatch, texts):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 20)
    small, large = bpe.ByteBpe(VOCABULARY), bpe.ByteBpe(VOCABULARY)
    some = texts[:400]
    got = [b for k in range(0, 400, 7) for b in small.encode_batch(some[k : k + 7])]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10**6)
    assert got == large.encode_batch(some)


def test_operator(spark, reference):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, "x"), (2, "", None), (3, "word " * 50_000, "y"), (4, "<|endoftext|> é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_documents(df, VOCABULARY, with_ids=True, with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {1: "a b", None: "", 2: "", 3: "word " * 50_000, 4: "<|endoftext|> é"}[r["doc_id"]]
        ids = reference.encode(text, add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids) and r["decoded"] == text
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(df.where("false"), VOCABULARY).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.ByteBpe(VOCABULARY.replace("byte_bpe_50k", "word_bpe_49k"))
