"""BPE encoding and decoding by speculation and verification.

Texts are split at special tokens and by the byte-level pattern into words. For
the words that a worker has not met yet, as a batch:

1. speculate: greedy longest match against the vocabulary proposes tokens; all
   words walk the vocabulary's trie together, a byte a step;
2. verify: a sequence is the right one exactly if every token encodes to itself
   and every adjacent pair (a, b) is compatible, that is, merging a's and b's
   bytes by rank gives (a, b) again. All adjacent pairs of the batch are tested
   at once against a sorted table of pairs already decided; a pair new to the
   table is decided once by exact merging of its two tokens;
3. repair: only words with a failing pair are merged exactly, those of one
   length together: each round merges one pair in every row of a matrix.

Words of more than ``WIDE`` bytes go the same three ways one by one, with a heap.

The tables are the vocabulary file's (its path is a parameter) and bounded: a word
cache that is half full is laid aside, for words to be taken from until the next
is, and a full pair table is emptied, which changes speed only. Texts of any length
are encoded whole, word by word, and decoded whole.

Defined results: null text counts as empty and has no tokens; repeated rows and
ids, null ids among them, are encoded row by row; an empty table gives no rows;
other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.common import pieces

#: The published splitting rule of byte-level BPE (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same in the standard library's terms, for texts without odd_characters().
FAST_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
CACHE_WORDS, CACHE_PAIRS = 600_000, 1_000_000
#: Longest word, in bytes, that takes part in steps over whole batches.
WIDE = 64
#: Tokens that one step of decoding gathers.
DECODE_STEP = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: character -> byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


def odd_characters() -> frozenset[str]:
    """What the two engines class differently: numerals that are no decimal digits, some controls, and what the older one's Unicode lacks."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s"))
    return frozenset().union(*[set(re.findall(fast, every)) ^ set(regex.findall(published, every)) for fast, published in classes])


class ByteBpe:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        alphabet = byte_alphabet()
        raw = lambda piece: bytes(alphabet[c] for c in piece)
        self.id_of = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {self.id_of[raw(a)] << 20 | self.id_of[raw(b)]: k for k, (a, b) in enumerate(merges)}
        self.made, self.no_rank = [self.id_of[raw(a + b)] for a, b in merges], len(merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.id_of.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        self.longest = [0] * 256  # by first byte
        for b in self.id_of:
            self.longest[b[0]] = max(self.longest[b[0]], len(b))
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words, self.fast_words, self.odd = regex.compile(PATTERN).findall, re.compile(FAST_PATTERN).findall, odd_characters()
        self.size = size
        self._index()
        self._forget_pairs()
        self.stable = np.zeros(size, bool)  # tokens whose own bytes encode to them
        tokens = list(self.id_of.items())
        narrow = [(b, i) for b, i in tokens if len(b) <= WIDE]
        flat, counts = self.merge_many([b for b, _ in narrow])
        own = np.array([i for _, i in narrow])
        self.stable[own] = (counts == 1) & (flat[np.cumsum(counts) - counts] == own)
        for b, i in tokens:
            if len(b) > WIDE:
                self.stable[i] = self.merge(b) == [i]
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # words not met since the cache was full
        self.speculated = self.repaired = 0

    def _index(self) -> None:
        """The vocabulary's trie, the ranks and the tokens' bytes as arrays."""
        child: dict[tuple[int, int], int] = {}
        token = [-1]
        for word, i in self.id_of.items():
            node = 0
            for byte in word:
                if (nxt := child.get((node, byte))) is None:
                    nxt = child[node, byte] = len(token)
                    token.append(-1)
                node = nxt
            token[node] = i
        # Nodes with children come first, so that only they have a row of steps; the last row, of all others, leads nowhere.
        inner = np.zeros(len(token), bool)
        edges = np.array([(a, b, c) for (a, b), c in child.items()], np.int64).reshape(-1, 3)
        inner[edges[:, 0]] = True
        place = np.empty(len(token), np.int64)
        place[np.argsort(~inner, kind="stable")] = np.arange(len(token))  # the root stays first
        self.inner = int(inner.sum())
        self.steps = np.full((self.inner + 1, 256), -1, np.int32)
        self.steps[place[edges[:, 0]], edges[:, 1]] = place[edges[:, 2]]
        self.token_at = np.empty(len(token), np.int32)
        self.token_at[place] = token

        pairs = np.array([((k >> 20) * self.size + (k & 0xFFFFF), r) for k, r in self.rank.items()], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pair_codes = np.append(pairs[:, 0], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(pairs[:, 1], self.no_rank).astype(np.int32)
        self.made_of = np.append(np.array(self.made, np.int32), np.int32(-1))
        self.byte_ids = np.array(self.byte_id, np.int32)
        ids = self.byte_ids.astype(np.int64)
        self.byte_ranks = self._ranks(np.repeat(ids, 256), np.tile(ids, 256)).reshape(256, 256)

        self.lengths = np.fromiter(map(len, self.bytes_of), np.int64, self.size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.text_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, ``no_rank`` for pairs that never merge."""
        code = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.pair_codes, code)
        return np.where(self.pair_codes[at] == code, self.pair_ranks[at], np.int32(self.no_rank))

    def _forget_pairs(self) -> None:
        self.pairs, self.fits = np.empty(0, np.int64), np.empty(0, bool)

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: again and again the adjacent pair of lowest rank, leftmost first."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > WIDE:
            return self._merge_long(ids)
        get, made, last = self.rank.get, self.made, self.no_rank
        ranks = [get(a << 20 | b, last) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != last:
            k = ranks.index(best)
            ids[k : k + 2] = [made[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 20 | ids[k], last)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 20 | ids[k + 1], last)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        import heapq

        n = len(ids)
        nxt, prv, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def push(k: int) -> None:
            if k >= 0 and nxt[k] >= 0 and (r := self.rank.get(ids[k] << 20 | ids[nxt[k]])) is not None:
                heapq.heappush(heap, (r, k, ids[k], ids[nxt[k]], self.made[r]))

        for k in range(n):
            push(k)
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            j = nxt[k] if alive[k] else -1
            if j < 0 or ids[k] != a or ids[j] != b:
                continue
            ids[k], nxt[k], alive[j] = made, nxt[j], False
            if nxt[j] >= 0:
                prv[nxt[j]] = k
            push(prv[k])
            push(k)
        return [i for i, keep in zip(ids, alive) if keep]

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of words of at most ``WIDE`` bytes: all their ids, and how many each word has.

        Rows of one length lose one id a round, so the matrix stays full; rows without a pair left leave it.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        counts, done = np.zeros(len(words), np.int64), []
        by_size = np.argsort(sizes, kind="stable")
        for part in np.split(by_size, np.flatnonzero(np.diff(sizes[by_size])) + 1):
            for lo in range(0, len(part), 1 << 15):
                rows = part[lo : lo + (1 << 15)]
                width = int(sizes[rows[0]]) if len(rows) else 0
                if not width:
                    continue
                codes = raw[begin[rows][:, None] + np.arange(width)]
                ids, ranks = self.byte_ids[codes], self.byte_ranks[codes[:, :-1], codes[:, 1:]]
                while len(rows):
                    if width > 1:
                        at = ranks.argmin(1)  # the leftmost of the lowest
                        best = ranks[np.arange(len(rows)), at]
                        go = best < self.no_rank
                    else:
                        go = np.zeros(len(rows), bool)
                    if not go.all():
                        counts[rows[~go]] = width
                        done.append((rows[~go], ids[~go]))
                        rows = rows[go]
                        if not len(rows):
                            break
                        ids, ranks, at, best = ids[go], ranks[go], at[go], best[go]
                    row = np.arange(len(rows))
                    ids[row, at] = self.made_of[best]
                    keep = np.ones(ids.shape, bool)
                    keep[row, at + 1] = False
                    ids = ids[keep].reshape(len(rows), width - 1)
                    keep = np.ones(ranks.shape, bool)
                    keep[row, at] = False
                    ranks = ranks[keep].reshape(len(rows), width - 2)
                    width -= 1
                    left = np.flatnonzero(at > 0)
                    ranks[left, at[left] - 1] = self._ranks(ids[left, at[left] - 1], ids[left, at[left]])
                    right = np.flatnonzero(at < width - 1)
                    ranks[right, at[right]] = self._ranks(ids[right, at[right]], ids[right, at[right] + 1])
        flat, first = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for rows, ids in done:
            flat[first[rows][:, None] + np.arange(ids.shape[1])] = ids
        return flat, counts

    def greedy(self, word: bytes) -> list[int]:
        """Longest match from the left. Every byte is a token, so it always ends."""
        out, at, n, get = [], 0, len(word), self.id_of.get
        while at < n:
            for end in range(min(n, at + self.longest[word[at]]), at, -1):
                if (i := get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def greedy_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """greedy() of words of at most ``WIDE`` bytes: all their ids, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        end = np.cumsum(sizes)
        at, counts, rounds = end - sizes, np.zeros(len(words), np.int64), []
        open_ = np.flatnonzero(sizes)
        while len(open_):
            best, reach = np.empty(len(open_), np.int32), at[open_]
            walk, place, node, last = np.arange(len(open_)), at[open_], np.zeros(len(open_), np.int32), end[open_]
            while len(walk):
                node = self.steps[np.minimum(node, self.inner), raw[place]]
                on = np.flatnonzero((node >= 0) & (place < last))
                walk, place, node, last = walk[on], place[on] + 1, node[on], last[on]
                hit = self.token_at[node]
                found = np.flatnonzero(hit >= 0)
                best[walk[found]], reach[walk[found]] = hit[found], place[found]
            rounds.append((open_, counts[open_], best))
            counts[open_] += 1
            at[open_] = reach
            open_ = open_[reach < end[open_]]
        flat, first = np.empty(int(counts.sum()), np.int64), np.cumsum(counts) - counts
        for rows, nth, ids in rounds:
            flat[first[rows] + nth] = ids
        return flat, counts

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For codes a * size + b: whether the bytes of a and b merge to (a, b)."""
        if len(self.pairs) > CACHE_PAIRS:
            self._forget_pairs()
        ask = np.unique(pairs)
        at = np.searchsorted(self.pairs, ask)
        new = ask[self.pairs[np.minimum(at, len(self.pairs) - 1)] != ask] if len(self.pairs) else ask
        if len(new):
            both, fits = np.concatenate([self.pairs, new]), np.concatenate([self.fits, self._decide(new // self.size, new % self.size)])
            order = np.argsort(both, kind="stable")
            self.pairs, self.fits = both[order], fits[order]
        return self.fits[np.searchsorted(self.pairs, pairs)]

    def _decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible(), by exact merging."""
        out = np.zeros(len(a), bool)
        narrow = self.lengths[a] + self.lengths[b] <= WIDE
        for k in np.flatnonzero(~narrow):
            out[k] = self.merge(self.bytes_of[a[k]] + self.bytes_of[b[k]]) == [a[k], b[k]]
        if len(at := np.flatnonzero(narrow)):
            flat, counts = self.merge_many([self.bytes_of[x] + self.bytes_of[y] for x, y in zip(a[at].tolist(), b[at].tolist())])
            first, two = np.cumsum(counts) - counts, counts == 2
            out[at[two]] = (flat[first[two]] == a[at[two]]) & (flat[first[two] + 1] == b[at[two]])
        return out

    def _fitting(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For proposals: whether all tokens are stable and all adjacent pairs compatible."""
        owner = np.repeat(np.arange(len(counts)), counts)
        good = np.ones(len(counts), bool)
        good[owner[~self.stable[flat]]] = False
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inside):
            good[owner[inside[~self.compatible(flat[inside] * self.size + flat[inside + 1])]]] = False
        return good

    def learn(self, words: list[str]) -> None:
        """Encodes the words and puts them into the cache."""
        for word in self.special.keys() & set(words):  # words never contain one, so such a word is the token itself
            self.cache[word] = np.array([self.special[word]], "<u4").tobytes()
        narrow, raw = [], []
        for word in words:
            if word in self.special:
                continue
            if len(b := word.encode("utf-8", "surrogatepass")) <= WIDE:
                narrow.append(word)
                raw.append(b)
                continue
            proposal = self.greedy(b)
            good = bool(self._fitting(np.array(proposal, np.int64), np.array([len(proposal)]))[0])
            self.cache[word] = np.array(proposal if good else self.merge(b), "<u4").tobytes()
            self.speculated, self.repaired = self.speculated + 1, self.repaired + (not good)
        if not narrow:
            return
        flat, counts = self.greedy_many(raw)
        good = self._fitting(flat, counts)
        self._keep(narrow, flat, counts, good)
        bad = np.flatnonzero(~good).tolist()
        flat, counts = self.merge_many([raw[k] for k in bad])
        self._keep([narrow[k] for k in bad], flat, counts, np.ones(len(bad), bool))
        self.speculated, self.repaired = self.speculated + len(narrow), self.repaired + len(bad)

    def _keep(self, words: list[str], flat: np.ndarray, counts: np.ndarray, which: np.ndarray) -> None:
        coded, ends = flat.astype("<u4").tobytes(), np.cumsum(counts) * 4
        cache = self.cache
        for word, lo, hi, yes in zip(words, (ends - counts * 4).tolist(), ends.tolist(), which.tolist()):
            if yes:
                cache[word] = coded[lo:hi]

    def _split(self, texts: list[str], words: Callable[[str], list[str]]) -> list[list[str]]:
        out: list[list[str]] = []
        for text in texts:
            if self.split_special and any(s in text for s in self.special):
                parts = self.split_special.split(text)
                out.append([w for p in parts for w in ([p] if p in self.special else words(p))])
            else:
                out.append(words(text))
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers.

        Texts are split by a rule that the standard library runs faster. It differs
        from the published one only around odd characters, which no cached word has;
        texts with one are split again.
        """
        cut = self._split(texts, self.fast_words)
        distinct = set().union(*cut)
        missing = [w for w in distinct if w not in self.cache]
        if odd := not self.odd.isdisjoint("".join(missing)):
            which = [k for k, text in enumerate(texts) if not self.odd.isdisjoint(text)]
            for k, words in zip(which, self._split([texts[k] for k in which], self.words)):
                cut[k] = words
            distinct = set().union(*cut)
            missing = [w for w in distinct if w not in self.cache]
        again = {w: self.older[w] for w in missing if w in self.older}
        self.cache.update(again)
        self.learn([w for w in missing if w not in again])
        out = [b"".join(map(self.cache.__getitem__, words)) for words in cut]
        if odd:
            for w in missing:
                if not self.odd.isdisjoint(w):
                    del self.cache[w]
        if 2 * len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        every, out = np.frombuffer(ids, "<u4"), []
        for lo in range(0, len(every), DECODE_STEP):
            part = every[lo : lo + DECODE_STEP]
            n = self.lengths[part]
            from_ = np.repeat(self.starts[part] - (np.cumsum(n) - n), n)
            from_ += np.arange(len(from_))
            out.append(self.text_bytes[from_].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One encoder for each vocabulary in a Python worker, kept over tasks."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and on request ids (array<int>) and decoded (string).

    The decoded text is made from the ids alone.
    """
    extra = [("ids", "array<int>")] * with_ids + [("decoded", "string")] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for part in pieces(batches):
            ids = bpe.encode_batch([t or "" for t in part.column("text").to_pylist()])
            texts = [bpe.decode(i) for i in ids]
            columns = [
                part.column("id"),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]),
            ]
            if with_ids:
                columns.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())))
            if with_text:
                columns.append(pa.array(texts))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(n for n, _ in extra)])

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {n} {t}" for n, t in extra)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
