"""HTML tables to lines, each cell with the headers that it stands under.

A cell takes the first free place of its row; colspan and rowspan take places to the right and below. A header
row is one in ``thead`` or with ``th`` cells only. A cell has the texts of the header cells above it and of the
``th`` cells to its left, each once, outer first. Tables in cells are tables of their own, after the outer one.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.slices import sliced

#: Largest spans that HTML allows.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
CELLS = T.ArrayType(T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("table", "row", "col")], T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())]))


class _Cell:
    def __init__(self, header: bool, rows: int, cols: int):
        self.header, self.rows, self.cols, self.pieces = header, rows, cols, []

    @property
    def text(self) -> str:
        return " ".join(" ".join(self.pieces).split())


class _Table:
    def __init__(self, number: int):
        self.number, self.rows, self.in_head, self.cell = number, [], False, None

    def row(self) -> None:
        self.cell = None
        self.rows.append((self.in_head, []))

    def cells(self) -> list[dict]:
        out, taken, above = [], {}, {}  # by column: up to which row it is taken; its header texts
        for r, (head, cells) in enumerate(self.rows):
            head = head or (bool(cells) and all(c.header for c in cells))
            at, beside = 0, []
            for cell in cells:
                while taken.get(at, 0) > r:
                    at += 1
                columns = range(at, at + cell.cols)
                for c in columns:
                    taken[c] = r + (cell.rows or MAX_ROWSPAN)
                if head:
                    for c in columns:
                        above.setdefault(c, []).append(cell.text)
                elif cell.header:
                    beside.append(cell.text)
                else:
                    headers = [h for c in columns for h in above.get(c, [])] + beside
                    out.append({"table": self.number, "row": r, "col": at, "headers": [h for h in dict.fromkeys(headers) if h], "text": cell.text})
                at += cell.cols
        return out


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.done, self.silent = [], [], 0

    def _span(self, attrs, name: str, most: int) -> int:
        value = dict(attrs).get(name) or ""
        return min(int(value), most) if value.isascii() and value.isdigit() else 1

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.silent += 1
        elif tag == "table":
            self.open.append(_Table(len(self.done)))
            self.done.append(self.open[-1])
        elif self.open:
            now = self.open[-1]
            if tag in ("thead", "tbody", "tfoot"):
                now.in_head, now.cell = tag == "thead", None
            elif tag == "tr":
                now.row()
            elif tag in ("td", "th"):
                if not now.rows:
                    now.row()
                now.cell = _Cell(tag == "th", self._span(attrs, "rowspan", MAX_ROWSPAN), max(1, self._span(attrs, "colspan", MAX_COLSPAN)))
                now.rows[-1][1].append(now.cell)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.silent = max(0, self.silent - 1)
        elif self.open:
            if tag == "table":
                self.open.pop()
            elif tag in ("td", "th", "tr"):
                self.open[-1].cell = None
            elif tag == "thead":
                self.open[-1].in_head = False

    def handle_data(self, data):
        if self.open and self.open[-1].cell and not self.silent and data.strip():
            self.open[-1].cell.pieces.append(data.strip())


def cells_of(html: str | None) -> list[dict]:
    """table, row, col, headers and text of every data cell, in reading order of each table."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return [c for t in parser.done for c in t.cells()]


_cells = sliced(cells_of, CELLS)


def table_cells(html: Column) -> Column:
    return _cells(html)


def table_lines(html: Column) -> Column:
    """``header, header: cell`` for each cell with a text, the text alone where no header is."""
    filled = F.filter(table_cells(html), lambda c: c["text"] != "")
    return F.transform(filled, lambda c: F.when(F.size(c["headers"]) > 0, F.concat(F.array_join(c["headers"], ", "), F.lit(": "), c["text"])).otherwise(c["text"]))
