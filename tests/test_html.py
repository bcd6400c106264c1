"""The parsing stage: links and Markdown."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webcorpus.operators import html
from webcorpus.operators.html import _parse, parse_pages
from webcorpus.operators.links import classify_links, explode_links

MARKDOWN = [
    ("<p>a <b>bold</b> c</p><p>x<br>y</p>", "a **bold** c\n\nx  \ny"),
    ("<ul><li>one<ul><li>two</li></ul></li><li>three</li></ul><ol><li>x<li>y</ol>after", "* one\n  * two\n* three\n\n1. x\n2. y\n\nafter"),
    ("<table><tr><th>a<th>b</tr><tr><td>1</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 |  |"),
    ("<p><b>X y.<br><p>Z</article>", "**X y.**\n\nZ"),
    ("<blockquote><p>q1</p><p>q2</p></blockquote>", "> q1\n\n> q2"),
    ("<pre>a\n  b</pre>", "```\na\n  b\n```"),
    ("<h2>T &amp; U</h2>text<hr>z<img src='/i.png' alt='al'> <a href='/x?a=1&amp;b=2'>  link </a>.", "## T & U\n\ntext\n\n---\n\nz![al](/i.png) [link](/x?a=1&b=2) ."),
    ("<p>a<b> b </b>c<i></i> <code>k</code></p>", "a **b** c `k`"),
    ("<head><title>t</title><style>x</style></head><body>hi<script>var x='</p>';</script><!-- c --></body>", "hi"),
    ("<p>unfinished <a href='/x'>link", "unfinished [link](/x)"),
    ("", None), ("   ", None), (None, None),
]


@pytest.mark.parametrize("html,markdown", MARKDOWN)
def test_markdown(html, markdown):
    assert _parse("https://h/p", html)[1] == markdown


LINKS = [
    ('<a href="#x">', []), ('<a href="mailto:a@h">', []), ('<a href="/q?z=1">', [("page", "https://h/q")]),
    ('<a href="/r.pdf?z=1">', [("file", "https://h/r.pdf")]), ('<img src="/i.png">', []),
    ('<iframe src="/s.pdf?z=1">', [("file", "https://h/s.pdf?z=1")]),
    ("""<div style="background:url('/t.pdf')">""", [("file", "https://h/t.pdf")]),
    ('<a href="https://other/x">', []), ('<a name="n">', []), ('<a href="">', [("page", "https://h/p")]), ("", []),
    ('<a href="http://[bad">', []), ('<!-- <a href="/c"> --><script>"<a href=/s>"</script>', []),
    ('<a href="team"><a href="../y"><a href="//cdn.org/z"><a href="?q=1"><a href="tel:123">', [("page", "https://h/team"), ("page", "https://h/y"), ("page", "https://h/p")]),
    ('<a href=/1><a href=/2><a href=/1>', [("page", "https://h/1"), ("page", "https://h/2"), ("page", "https://h/1")]),
]


def test_links(spark):
    df = spark.createDataFrame([(i, "https://h/p", html) for i, (html, _) in enumerate(LINKS)], "page_id long, url string, html string")
    parsed = parse_pages(df, keep=("page_id", "url"))
    rows = classify_links(explode_links(parsed, ("page_id", "url")), "url").orderBy("page_id", "source", "pos").collect()
    found = {i: [] for i in range(len(LINKS))}
    for row in rows:
        found[row.page_id].append((row.kind, row.norm))
    assert list(found.values()) == [expected for _, expected in LINKS]


def test_parsing_keeps_columns_and_survives_any_input(spark):
    df = spark.createDataFrame([(1, "s", "https://h/", "<<<>&#x;<a href=x" * 3), (2, "t", None, "<p>x"), (3, "u", "https://h/", None)],
                               "page_id long, site string, url string, html string")
    rows = parse_pages(df, keep=("page_id", "site")).orderBy("page_id").collect()
    assert [(r.page_id, r.site) for r in rows] == [(1, "s"), (2, "t"), (3, "u")]
    assert rows[2].markdown is None and rows[2].links == []


def test_pages_are_parsed_in_slices(spark):
    """A worker holds a bounded part of a batch as parsed objects; no row is lost where slices meet."""
    texts = pa.array(["x" * 10] * 1000 + ["x" * (html.SLICE_BYTES + 1), None, "y"])
    slices = list(html._slices(texts))
    assert [at for start, n in slices for at in range(start, start + n)] == list(range(len(texts)))
    assert max(n for _, n in slices) <= html.SLICE_ROWS
    assert all(sum(len(t or "") for t in texts.slice(start, n - 1).to_pylist()) < html.SLICE_BYTES for start, n in slices)
    assert list(html._slices(texts.slice(0, 0))) == []
    pages = spark.range(700).coalesce(1).selectExpr("id AS page_id", "'https://h/' AS url", "if(id % 9 = 0, NULL, concat('<a href=/', id, '>', id)) AS html")
    found = parse_pages(pages, keep=("page_id",)).collect()
    assert [(r.page_id, r.markdown, [x.resolved for x in r.links]) for r in found] == [
        (i, None, []) if i % 9 == 0 else (i, f"[{i}](/{i})", [f"https://h/{i}"]) for i in range(700)
    ]
