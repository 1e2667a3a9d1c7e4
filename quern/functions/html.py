"""HTML to sections, as an Arrow-batched UDF over the standard library's event parser.

``h1`` to ``h3`` with a text open a section; an empty heading opens none. In
``strict`` mode the pieces of text since the last end tag, trimmed and joined by
spaces, are kept when a block tag (p li td th div span) ends; every other end tag
throws them away. In ``inline`` mode the text of inline tags flows to the block
around it and is flushed at block boundaries and at br, tr and hr. The last section
is kept without content, too, if it has a heading.
"""

from __future__ import annotations

from functools import partial
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.slices import sliced

_HEADINGS, _BLOCKS, _SILENT, _BREAKS = {"h1", "h2", "h3"}, {"p", "li", "td", "th", "div", "span"}, {"script", "style", "noscript"}, {"br", "tr", "hr"}
SECTIONS = T.ArrayType(T.StructType([T.StructField("heading_level", T.StringType()), T.StructField("heading", T.StringType()), T.StructField("content", T.ArrayType(T.StringType()))]))


class _Events(HTMLParser):
    def __init__(self, inline: bool):
        super().__init__(convert_charrefs=True)
        self.inline, self.silent, self.pending = inline, 0, []
        self.level, self.title, self.lines, self.naming = "h1", "Document", [], None
        self.done: list[tuple[str, str, list[str]]] = []

    def take(self) -> str:
        glue = "" if self.inline else " "
        text, self.pending = " ".join(glue.join(self.pending).split()), []
        return text

    def keep(self) -> None:
        if text := self.take():
            self.lines.append(text)

    def close_section(self, last: bool = False) -> None:
        if self.lines or (last and self.title != "Document"):
            self.done.append((self.level, self.title, self.lines))
            self.lines = []

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif not self.silent and tag in _HEADINGS:
            if self.inline:
                self.keep()
            self.pending, self.naming = [], tag
        elif self.inline and not self.silent and (tag in _BLOCKS or tag in _BREAKS) and not self.naming:
            self.keep()

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.silent:
            return
        elif tag in _HEADINGS:
            name, self.naming = self.take(), None
            if name:
                self.close_section()
                self.level, self.title = tag, name
        elif tag in _BLOCKS or (self.inline and tag in _BREAKS):
            if not (self.inline and self.naming):
                self.keep()
        elif not self.inline:
            self.take()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.silent:
            self.pending.append(data)


def sections_of(html: str | None, inline: bool = False) -> list[dict]:
    events = _Events(inline)
    events.feed(html or "")
    events.close()
    events.keep()
    events.close_section(last=True)
    return [{"heading_level": a, "heading": b, "content": c} for a, b, c in events.done]


_strict = sliced(sections_of, SECTIONS)
_inline = sliced(partial(sections_of, inline=True), SECTIONS)


def html_sections(html: Column, mode: str = "strict") -> Column:
    if mode not in ("strict", "inline"):
        raise ValueError("mode is strict or inline")
    return (_strict if mode == "strict" else _inline)(html)


def section_text(sections: Column) -> Column:
    """All content, joined by spaces."""
    return F.array_join(F.flatten(F.transform(sections, lambda s: s["content"])), " ")


def tidy_sections(sections: Column) -> Column:
    """Headings defaulted, sections without content dropped."""
    named = F.transform(sections, lambda s: F.struct(s["heading_level"].alias("heading_level"), F.coalesce(F.nullif(s["heading"], F.lit("")), F.lit("Untitled Section")).alias("heading"), s["content"].alias("content")))
    return F.filter(named, lambda s: F.size(s["content"]) > 0)
