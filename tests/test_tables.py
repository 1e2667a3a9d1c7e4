"""Tables against grids made by hand."""

from quern.functions.tables import cells_of, table_lines
from pyspark.sql import functions as F


def grid(html):
    return [(c["table"], c["row"], c["col"], c["headers"], c["text"]) for c in cells_of(html)]


def test_spans_and_two_header_rows():
    html = """<table><thead><tr><th rowspan=2>Fund</th><th colspan="2">Return</th></tr><tr><th>1y</th><th>3y</th></tr></thead>
    <tbody><tr><td>A</td><td>5</td><td>7</td></tr><tr><td rowspan="2">B</td><td colspan=2>none <b>yet</b></td></tr><tr><td>1</td><td>2</td></tr></tbody></table>"""
    assert grid(html) == [
        (0, 2, 0, ["Fund"], "A"), (0, 2, 1, ["Return", "1y"], "5"), (0, 2, 2, ["Return", "3y"], "7"),
        (0, 3, 0, ["Fund"], "B"), (0, 3, 1, ["Return", "1y", "3y"], "none yet"),
        (0, 4, 1, ["Return", "1y"], "1"), (0, 4, 2, ["Return", "3y"], "2"),
    ]


def test_row_headers_and_unclosed_cells():
    html = "<table><tr><th>Key<th>Value<tr><th>Size<td>10<tr><th>Load<td>1%<td>extra</table>after"
    assert grid(html) == [(0, 1, 1, ["Value", "Size"], "10"), (0, 2, 1, ["Value", "Load"], "1%"), (0, 2, 2, ["Load"], "extra")]


def test_nested_tables_are_their_own():
    html = "<table><tr><th>H</th></tr><tr><td>out <table><tr><td>in</td></tr></table> side</td></tr></table>"
    assert grid(html) == [(0, 1, 0, ["H"], "out side"), (1, 0, 0, [], "in")]


def test_ragged_and_odd():
    assert grid(None) == [] and grid("<td>no table</td>") == [] and grid("<table></table><table><tr></tr></table>") == []
    html = "<table><tr><td rowspan=0>all</td><td>1</td></tr><tr><td>2</td><td>3</td></tr><tr><td colspan=x>4</td></tr></table>"
    assert grid(html) == [(0, 0, 0, [], "all"), (0, 0, 1, [], "1"), (0, 1, 1, [], "2"), (0, 1, 2, [], "3"), (0, 2, 1, [], "4")]
    assert len(grid("<table><tr><td rowspan=99999999 colspan=99999999>x</td></tr>" + "<tr><td>y</td></tr>" * 50 + "</table>")) == 51
    assert grid("<table><tr><td>a<script>b</script></td></tr></table>") == [(0, 0, 0, [], "a")]


def test_lines(spark):
    df = spark.createDataFrame([("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td></td><td>3</td></tr></table>",), (None,)], "html string")
    assert [r[0] for r in df.select(table_lines(F.col("html"))).collect()] == [["A: 1", "3"], []]
