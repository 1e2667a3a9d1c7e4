"""URL filter: a table of host and path rules, then a weighted vocabulary.

The vocabulary is searched with one Aho-Corasick automaton over the URL with A-Z
lower-cased. A hit counts only between boundaries: the characters beside it are
no ASCII letters or digits. A strict term has weight 1, a soft one less; the URL
is rejected when the weights of its distinct hits reach 1, so one strict or
several distinct soft terms reject it.

Rules come first. A rule is a host and a path prefix; it fits its host and all
subdomains if the URL's path starts with its path. Of the rules that fit, the
longest (host and path together, then the longer host) decides.

Both tables are parameters whose size the caller bounds; they travel with the
function. Defined results: a null URL or one without ``://`` has empty host and
path, fits no rule, and is judged by the vocabulary alone (null: allowed). URLs of
any length are searched whole, in one pass; null and repeated ids and repeated
rows are judged row by row; an empty table gives no rows; other columns, whatever
their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import pieces

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

STRICT = ("adult-x", "casino", "cheap-pills", "escort", "free-bets", "gambling", "hentai", "malware", "phishing", "porn", "spam-farm", "viagra", "warez", "xxx")
SOFT = ("ad", "ads", "adult", "bet", "bets", "bonus", "cam", "cams", "cheap", "click", "crack", "farm", "free", "jackpot", "loan", "loans", "nude", "pills", "poker", "popup", "serial", "sex", "slots", "spam", "torrent", "track", "tracker", "win", "winner")
VOCABULARY = {**dict.fromkeys(SOFT, 0.5), **dict.fromkeys(STRICT, 1.0)}


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = lambda s, stops: s[: min((i for c in stops if (i := s.find(c)) >= 0), default=len(s))]
    host = cut(rest, "/?#")
    return host.translate(_LOWER), cut(rest[len(host) :], "?#")


class UrlJudge:
    """The compiled tables. Built once in each Python worker."""

    def __init__(self, rules: Iterable[tuple[str, str, str]] = RULES, vocabulary: dict[str, float] | None = None):
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.rules.setdefault(host, []).append((path, verdict))
        self.weights = VOCABULARY if vocabulary is None else vocabulary
        self.automaton = ahocorasick.Automaton()
        for term in self.weights:
            self.automaton.add_word(term, term)
        self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        labels, best = host.split("."), None
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for prefix, verdict in self.rules.get(suffix, ()):
                if path.startswith(prefix) and (best is None or (len(suffix) + len(prefix), len(suffix)) > best[0]):
                    best = (len(suffix) + len(prefix), len(suffix)), suffix + prefix, verdict
        return best and best[1:]

    def hits(self, url: str) -> set[str]:
        s = url.translate(_LOWER)
        plain = lambda c: c.isascii() and c.isalnum()
        found = set()
        if self.weights:
            for end, term in self.automaton.iter(s):
                start = end - len(term) + 1
                if not (start > 0 and plain(s[start - 1])) and not (end + 1 < len(s) and plain(s[end + 1])):
                    found.add(term)
        return found

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, list[str]]:
        host, path = split_url(url)
        found = sorted(self.hits(url)) if url else []
        if by_rule := self.rule(host, path):
            return host, path, by_rule[0], by_rule[1], found
        return host, path, None, "block" if sum(self.weights[t] for t in found) >= 1 else "allow", found


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[tuple[str, str, str]] = RULES, vocabulary: dict[str, float] | None = None) -> DataFrame:
    """id, host, path, rule, verdict, terms (the distinct hits, sorted)."""
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = UrlJudge(rules, vocabulary)
        for batch in pieces(batches):
            found = [judge.judge(u) for u in batch.column("url").to_pylist()]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "host", "path", "rule", "verdict", "terms"])

    rows = pages.selectExpr(f"`{id_col}` AS id", f"`{url_col}` AS url")
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, host string, path string, rule string, verdict string, terms array<string>").withColumnRenamed("id", id_col)
