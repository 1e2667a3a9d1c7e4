import random
import re

from pyspark.sql import functions as F

from quern.functions import query as qn
from quern.functions import text as tx
from quern.functions import urls as ul
from quern.functions.html import sections_of


def test_clean_text(evaluate):
    assert evaluate(tx.clean_text(F.lit("  a \t b\n c "))) == "a b c"
    assert evaluate(tx.clean_symbols(F.lit("• ₹5 ● x"))) == "-  Rs 5 -  x"


def test_boilerplate_is_whole_line(evaluate):
    assert evaluate(tx.is_boilerplate(F.lit("Read More")))
    assert evaluate(tx.is_boilerplate(F.lit("ab")))
    assert not evaluate(tx.is_boilerplate(F.lit("read more about it")))


def test_first_occurrences_ignore_case_and_null(evaluate):
    items = F.array(*[F.lit(x) for x in ("Abc", "abc", "d", None, "ABC", "d")])
    assert evaluate(tx.first_occurrences(items)) == ["Abc", "d"]
    assert evaluate(tx.clean_items(F.array(F.lit("x  y"), F.lit("login"), F.lit("X y"), F.lit("zzz")))) == ["x y", "zzz"]


def test_relevance(evaluate):
    # three terms found ("fund", "nav", "risk"), one noise term, 80 characters or more
    text = "The fund has a NAV and a risk and nothing on stocks " + "x" * 40
    assert evaluate(tx.relevance_score(F.lit(text))) == round((3 - 0.8 + 1) / 6, 4)
    assert evaluate(tx.relevance_score(F.lit("stocks"))) == 0
    assert not evaluate(tx.is_relevant(F.lit("fund nav risk")))


def expected_chunks(text, low=600, high=900, overlap=150):
    """The rule, recursively: the head up to its last late delimiter, then the rest from `overlap` before the cut."""
    if len(text) <= high:
        return [text.strip()] if text.strip() else []
    late = [m.start() + 1 for m in re.finditer("[.;,] ", text[:high]) if m.start() >= low]
    cut = late[-1] if late else high
    return [text[:cut].strip()] + expected_chunks(text[cut - overlap :], low, high, overlap)


def test_chunks_match_brute_force(spark):
    import random

    rng = random.Random(4)
    texts = ["", "short one", "x" * 900, "x" * 901, "y" * 5000]
    texts += [" ".join(rng.choice(["alpha", "beta,", "gamma;", "delta."]) for _ in range(n)) for n in (50, 200, 700, 3000)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.chunks(F.col("t")).alias("c")).collect()
    for row in got:
        assert row["c"] == expected_chunks(texts[row["i"]])
        assert all(len(c) <= 900 for c in row["c"])


def test_sentences_and_tokens(evaluate):
    assert evaluate(tx.sentences(F.lit("A b. C d! E"))) == ["A b.", "C d!", "E"]
    assert evaluate(tx.tokens(F.lit("Ünï_1 x-y"))) == ["ünï_1", "x", "y"]
    assert evaluate(tx.sentence_count(F.lit("one"))) == 1
    assert evaluate(tx.sentence_count(F.lit("a. b! c?"))) == 3
    assert evaluate(tx.sentence_count(F.lit(""))) == 0


def test_urls(evaluate):
    assert evaluate(ul.slug(F.lit("  Mid-Cap Fund! "))) == "mid-cap-fund"
    assert evaluate(ul.title_from_url(F.lit("https://x.org/a/big-blue-thing/?q=1"))) == "Big Blue Thing"
    assert evaluate(ul.urls_in(F.lit("See HTTPS://a.b/c, https://a.b/c. and http://d.e!"))) == ["https://a.b/c", "http://d.e"]
    name = evaluate(ul.snapshot_name(F.lit("https://x.org/a")))
    assert name.startswith("x.org_a_") and name.endswith(".html") and len(name) == len("x.org_a_") + 12 + 5


def test_query_rewrites(evaluate):
    n = lambda s, **k: evaluate(qn.normalize_query(F.lit(s), **k))
    assert n("Lock-in for 3 yrs, 5%") == "lockin for 3 yrs, 5 percent"
    assert n("block-in 10 m expenseratio 5yrs") == "block-in 10 m expense ratio 5 year"
    assert n("Lock in, lockin, 3year 1y 18months 6m 30days 1d x3y") == "lockin, lockin, 3 year 1 year 18 month 6 month 30 day 1 day x3y"
    assert n("exitload Exit-Load expense-ratio EXPENSE RATIO") == "exit load exit load expense ratio expense ratio"
    assert n("What is the exit load for HDFC Mid Cap Fund?") == "what is the exit load for hdfc mid cap fund?"
    assert n("How much is the expense ratio % for ELSS?") == "how much is the expense ratio percent for elss?"
    assert n("₹500 SIP for 3 years returns?") == "rs 500 sip for 3 years returns?"
    assert n("1 year lockin period for tax saver fund") == "1 year lockin period for tax saver fund"
    assert n("0.45% expense ratio comparison") == "0.45 percent expense ratio comparison"
    assert n("₹500 over years") == "rs 500 over years"
    assert n("percentage of ﬁve") == "percent of five"
    assert n("nav today", expand=True) == "net asset value today"


def test_query_features(spark):
    f = qn.numeric_features(F.col("q"))
    rows = spark.createDataFrame([("5 percent exit load",), ("plain words",), ("3 apples",)], "q string").select(*[c.alias(n) for n, c in f.items()]).collect()
    assert rows[0]["is_numeric_heavy"] and rows[0]["has_financial_terms"]
    assert not any(rows[1])
    assert rows[2]["has_numbers"] and not rows[2]["is_numeric_heavy"]


def test_domain_tokens(evaluate):
    assert evaluate(qn.domain_tokens(F.lit("nav of it"))) == ["amfi", "crisil", "nav", "sebi"]
    assert evaluate(qn.is_entity_specific(F.lit("a mid cap one")))


def test_html_strict_drops_inline_tails():
    html = "<h1>T</h1><p>one <b>two</b> three</p><li>four</li><script>var x='</p>'</script><h2>U</h2><div>five"
    strict = sections_of(html)
    assert [(s["heading"], s["content"]) for s in strict] == [("T", ["three", "four"]), ("U", ["five"])]
    inline = sections_of(html, inline=True)
    assert inline[0]["content"] == ["one two three", "four"]
    assert sections_of(None) == [] and sections_of("") == []


def test_clean_items_of_many_lines_is_not_quadratic(spark):
    """20,000 lines, each twice: a few seconds, where each line against all others would take hours."""
    lines = [f"line {k} of  it" for k in range(20_000)]
    items = F.split(F.lit("\n".join(lines + [x.upper() for x in lines] + ["x", "Login"])), "\n")
    got = spark.range(1).select(tx.clean_items(items).alias("c")).first()["c"]
    assert got == [f"line {k} of it" for k in range(20_000)]


def test_first_occurrences(evaluate):
    got = evaluate(tx.first_occurrences(F.array(*[F.lit(x) for x in ["b", "A", "a", None, "B", "c", "", "A"]])))
    assert got == ["b", "A", "c", ""]
    assert evaluate(tx.first_occurrences(F.array().cast("array<string>"))) == [] and evaluate(tx.first_occurrences(F.lit(None).cast("array<string>"))) is None


def test_chunks_of_a_very_long_text(spark):
    text = " ".join(f"word {k}; and, more." for k in range(220_000))  # 5 MB
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(tx.chunks(F.col("t")).alias("c")).collect()
    pieces = got[0]["c"]
    assert got[1]["c"] is None and got[2]["c"] == []
    at = 0
    for p in pieces:
        assert p == p.strip(" ") and len(p) <= 900
        at = text.index(p, max(0, at - 200))
        at += len(p)
    assert at == len(text) and len(text) / 752 - 5 < len(pieces) < len(text) / 700


def test_chunks_by_sql(spark):
    spark.udtf.register("overlap_chunks", tx.OverlapChunks)
    spark.createDataFrame([(1, "a, b. " * 400), (2, "short"), (3, None)], "id long, t string").createOrReplaceTempView("long_texts")
    got = spark.sql("SELECT id, ord, chunk FROM long_texts, LATERAL overlap_chunks(t, 600, 900, 150) ORDER BY id, ord").collect()
    want = [(1, n, c) for n, c in enumerate(tx.overlap_pieces("a, b. " * 400), 1)] + [(2, 1, "short")]
    assert [tuple(r) for r in got] == want and len(want) > 3


def by_loop(html):
    """Strict extraction of simple markup, token by token: another way than the event parser's."""
    sections, now, pending, silent = [], ["h1", "Document", []], [], 0
    for end, tag, slash, data in re.findall(r"<(/?)([a-z0-9]+)[^>]*?(/?)>|([^<]+)", html):
        if data:
            pending += [data.strip()] * (not silent and bool(data.strip()))
            continue
        if tag in ("script", "style", "noscript") and not slash:
            silent = max(0, silent - 1) if end else silent + 1
            continue
        if silent:
            continue
        if not end and tag in ("h1", "h2", "h3"):
            pending = []
        if end or slash:
            text, pending = " ".join(" ".join(pending).split()), []
            if text and tag in ("h1", "h2", "h3"):
                sections += [now] * bool(now[2])
                now = [tag, text, []]
            elif text and tag in ("p", "li", "td", "th", "div", "span"):
                now[2].append(text)
    now[2] += [" ".join(" ".join(pending).split())] * bool(pending)
    sections += [now] * (bool(now[2]) or now[1] != "Document")
    return [tuple(s) for s in sections]


def test_strict_sections_equal_a_loop():
    rnd = random.Random(8)
    parts = ["<h1>", "</h1>", "<h2>", "</h2>", "<h3></h3>", "<p>", "</p>", "<li>", "</li>", "<b>", "</b>", "<br>", "<br/>", "<div>", "</div>", "<span>", "</span>", "<script>", "</script>", "<td>", "</td>", " ", "\n", "word", " two words ", "3  x"]
    for _ in range(3000):
        html = "".join(rnd.choices(parts, k=rnd.randint(0, 25)))
        if html.count("<script>") != html.count("</script>") or re.search(r"<script>(?!</script>)", html):
            continue  # inside a script there is no markup
        assert [(s["heading_level"], s["heading"], s["content"]) for s in sections_of(html)] == by_loop(html), html


def test_breaks_and_headings():
    assert [s["content"] for s in sections_of("<p>a<br>b</p>")] == [["a b"]]
    assert [s["content"] for s in sections_of("<p>a<br>b<br/>c</p><table><tr><td>d<tr><td>e</table>", inline=True)] == [["a", "b", "c", "d", "e"]]
    html = "<h1>One</h1><p>x</p><h2></h2><p>y</p><h2>Foo <b>bar</b></h2><p>z</p><h3>Last</h3>"
    assert [(s["heading"], s["content"]) for s in sections_of(html)] == [("One", ["x", "y", "z"]), ("Last", [])]
    assert [(s["heading"], s["content"]) for s in sections_of(html, inline=True)] == [("One", ["x", "y"]), ("Foo bar", ["z"]), ("Last", [])]
    assert [s["content"] for s in sections_of("<p>a<b>b</b>c</p>", inline=True)] == [["abc"]]


def test_udfs_hold_a_slice_of_a_batch(spark):
    import pyarrow as pa
    from pyspark.sql import types as T

    from quern.functions import html, tables
    from quern.functions.slices import sliced
    from quern.functions.vectors import hash_encoder

    for udf in (hash_encoder(8), html._strict, html._inline, tables._cells):
        parts = list(udf.func(iter([pa.array(["<p>x</p>"] * 1000)])))
        assert sum(map(len, parts)) == 1000 and max(map(len, parts)) <= 64
    rows = spark.range(1000, numPartitions=1).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("a. "), F.col("id").cast("string"))).alias("t"))
    got = [r["x"] for r in rows.select(sliced(lambda t: t and t + "!", T.StringType(), 3)(F.col("t")).alias("x")).collect()]
    assert got == [None if k % 7 == 0 else f"a. {k}!" for k in range(1000)]
    both = rows.select("t", tx.chunks(F.col("t")).alias("c"), hash_encoder(8)(F.col("t")).alias("v")).collect()
    assert all(r["c"] == (None if r["t"] is None else [r["t"]]) and len(r["v"]) == 8 for r in both)
