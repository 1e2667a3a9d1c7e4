"""Properties of the pure functions under the operators."""

import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe, ngram_join, quality_rules, url_filter
from quern.llm.langid import plain
from quern.llm.queries import VOCABULARY

texts = st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60)
words = st.lists(st.sampled_from("a b c d".split()), max_size=40)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file here")
@settings(max_examples=150, deadline=None)
@given(texts)
def test_decoding_undoes_encoding(text):
    enc = bpe.loaded(VOCABULARY)
    ids = enc.encode_batch([text])[0]
    assert enc.decode(ids) == text


@settings(max_examples=150, deadline=None)
@given(words, words)
def test_overlaps_are_set_intersections(a, b):
    sets = ngram_join.exact_sets([" ".join(a), " ".join(b)])
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    assert [len(s) for s in sets] == [len(grams(a)), len(grams(b))]
    assert ngram_join._overlaps(sets[:1], sets[1:])[0, 0] == len(grams(a) & grams(b))


@settings(max_examples=150, deadline=None)
@given(words)
def test_repeated_words_match_brute_force(w):
    raw = [x.encode() for x in w]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    want = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
    assert quality_rules.repeated_words(raw) == len(want)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB:/?#.-é", max_size=20))
def test_urls_split_as_stated(url):
    host, path = url_filter.split_url(url)
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url, re.S)
    assert (host, path) == ((m[1].replace("B", "b"), m[2]) if m else ("", ""))


@settings(max_examples=100, deadline=None)
@given(texts)
def test_plain_text_has_letters_or_nothing(text):
    got = plain(text).decode()
    assert all(c.isalpha() or c == " " or not c.isascii() for c in got) and "  " not in got
