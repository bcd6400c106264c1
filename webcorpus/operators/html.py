"""One parse of each page: its links, its title and its Markdown.

The only stage that runs in Python workers. It is handed Arrow batches, keeps
no state between pages and never looks at more than one page at a time.

Markdown dialect: ``#`` headings; a blank line between blocks; ``*`` and ``1.``
lists nested by two spaces; ``[text](href)``; ``![alt](src)``; ``**b**``,
``_i_``, `` `code` ``, fenced ``pre``; ``>`` quotes; pipe tables; ``br`` is two
spaces and a newline, dropped at a block's end; an unclosed inline tag closes
with its block. Scripts, styles, comments and the head are left out. No line is
wrapped.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.fixed import CSS_URL, SRC_TAGS, UNFOLLOWED_PREFIXES

# Executors need no copy of this module: it travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINK = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("raw", T.StringType()),
    T.StructField("resolved", T.StringType()),
])
PARSED = [
    T.StructField("title", T.StringType()),
    T.StructField("markdown", T.StringType()),
    T.StructField("links", T.ArrayType(LINK)),
]

# Of a batch, what is parsed and handed on at once: the links of a page, as Python objects, take many times its size.
SLICE_ROWS = 64
SLICE_BYTES = 1_000_000

_BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table ul".split()
)
_HIDDEN = frozenset("head script style noscript template".split())
_MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_", "code": "`", "kbd": "`", "tt": "`"}


class PageParser(HTMLParser):
    """Collects links and Markdown blocks in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = {"a": [], "src": [], "css": []}
        self.title, self.in_title, self.hidden = [], False, 0
        self.blocks, self.text, self.open = [], [], []  # finished blocks; current block; its open inline tags
        self.lists, self.bullet, self.quotes, self.prefix, self.pre = [], "", 0, "", 0
        self.rows, self.tables = [], 0

    # -- links -----------------------------------------------------------
    def collect_links(self, tag, attrs):
        if tag == "a" and "href" in attrs and not attrs["href"].startswith(UNFOLLOWED_PREFIXES):
            self.found["a"].append(attrs["href"])
        if tag in SRC_TAGS and "src" in attrs:
            self.found["src"].append(attrs["src"])
        if "url(" in attrs.get("style", ""):
            self.found["css"].extend(re.findall(CSS_URL, attrs["style"]))

    # -- inline text -----------------------------------------------------
    def close_inline(self, tag):
        """Close ``tag`` and whatever was opened inside it."""
        while self.open:
            name, at, tail = self.open.pop()
            if "".join(self.text[at + 1:]).strip() or name == "a":
                trailing = []
                while self.text and self.text[-1].isspace():
                    trailing.append(self.text.pop())
                self.text.append(tail)
                self.text.extend(trailing[:1])
            else:
                del self.text[at:]
            if name == tag:
                break

    def open_inline(self, tag, mark, tail):
        self.open.append((tag, len(self.text), tail))
        self.text.append(mark)

    # -- blocks ----------------------------------------------------------
    def end_block(self):
        while self.text and self.text[-1].isspace():
            self.text.pop()
        self.close_inline(None)
        text = "".join(self.text).strip("\n" if self.pre else None)
        self.text = []
        if self.pre and text:
            text = f"```\n{text}\n```"
        if not text:
            return
        if self.tables:
            if self.rows and self.rows[-1]:
                cell = self.rows[-1]
                cell[-1] = f"{cell[-1]} {text}".strip()
            return
        kind, indent = "p", "  " * len(self.lists)
        if self.lists:
            kind = "li"
            first, self.bullet = self.bullet, ""
            text = (first or indent) + text.replace("\n", "\n" + indent)
        elif self.prefix:
            text = self.prefix + text
        if self.quotes:
            mark = "> " * self.quotes
            text = mark + text.replace("\n", "\n" + mark)
        self.blocks.append((kind, text))

    def end_table(self):
        rows = [row for row in self.rows if row]
        self.rows = []
        if rows:
            width = max(map(len, rows))
            lines = ["| " + " | ".join(row + [""] * (width - len(row))) + " |" for row in rows]
            lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
            self.blocks.append(("p", "\n".join(lines)))

    # -- parser events ---------------------------------------------------
    def handle_starttag(self, tag, pairs):
        attrs = {name: value or "" for name, value in pairs}
        self.collect_links(tag, attrs)
        if tag == "title":
            self.in_title = True
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "body":
            self.hidden = 0
        if tag in _BLOCKS:
            self.end_block()
            self.start_block(tag)
        elif tag in ("tr", "td", "th") and self.tables == 1:
            self.end_block()
            if tag == "tr":
                self.rows.append([])
            elif self.rows:
                self.rows[-1].append("")
        elif self.hidden:
            return
        elif tag == "br":
            while self.text and self.text[-1] == " ":
                self.text.pop()
            self.text.append("  \n")
        elif tag == "img":
            self.text.append(f"![{attrs.get('alt', '')}]({attrs.get('src', '')})")
        elif tag == "a" and "href" in attrs:
            self.open_inline("a", "[", f"]({attrs['href']})")
        elif tag in _MARKS and not self.pre:
            self.open_inline(tag, _MARKS[tag], _MARKS[tag])

    def start_block(self, tag):
        if tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li" and self.lists:
            indent = "  " * (len(self.lists) - 1)
            if self.lists[-1] is None:
                self.bullet = indent + "* "
            else:
                self.lists[-1] += 1
                self.bullet = f"{indent}{self.lists[-1]}. "
        elif tag == "blockquote":
            self.quotes += 1
        elif tag == "pre":
            self.pre += 1
        elif tag == "table":
            self.tables += 1
        elif tag == "hr" and not self.hidden:
            self.blocks.append(("p", "---"))
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.prefix = "#" * int(tag[1]) + " "

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in _BLOCKS or (tag in ("tr", "td", "th") and self.tables):
            self.end_block()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
                if not self.lists:
                    self.blocks.append(("gap", ""))
            elif tag == "blockquote" and self.quotes:
                self.quotes -= 1
            elif tag == "pre" and self.pre:
                self.pre -= 1
            elif tag == "table" and self.tables:
                self.tables -= 1
                if not self.tables:
                    self.end_table()
            elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self.prefix = ""
        elif any(name == tag for name, _, _ in self.open):
            self.close_inline(tag)

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif self.hidden:
            return
        elif self.pre:
            self.text.append(data)
        else:
            data = re.sub(r"\s+", " ", data)
            before = self.text[-1] if self.text else " "
            if before[-1:].isspace():
                data = data.lstrip()
            elif data[0] == " " and self.open and self.open[-1][1] == len(self.text) - 1:
                tag, at, tail = self.open[-1]
                if at and not self.text[at - 1].isspace():  # the blank belongs in front of the mark
                    self.text.insert(at, " ")
                    self.open[-1] = (tag, at + 1, tail)
                data = data.lstrip()
            if data.endswith(" ") and data != " ":
                self.text.extend([data[:-1], " "])
            elif data:
                self.text.append(data)

    def result(self):
        self.close()
        self.end_block()
        self.end_table()
        out, last = [], None
        for kind, text in self.blocks:
            if kind != "gap":
                if out:
                    out.append("\n" if kind == last == "li" else "\n\n")
                out.append(text)
            last = kind
        return " ".join("".join(self.title).split()), "".join(out)


def _resolve(base, raw):
    try:
        return urljoin(base, raw)
    except ValueError:
        return None


def _parse(base, html):
    if not html:
        return None, None, []
    try:
        parser = PageParser()
        parser.feed(html)
        title, markdown = parser.result()
    except Exception:  # a page that cannot be parsed yields nothing; it never fails the task
        return None, None, []
    links = [
        {"source": source, "pos": pos, "raw": raw, "resolved": _resolve(base, raw)}
        for source, raws in parser.found.items()
        for pos, raw in enumerate(raws, 1)
    ]
    return title, markdown or None, links


def _slices(texts):
    """(offset, length) of stretches of at most SLICE_ROWS texts, ended by the text that brings them over SLICE_BYTES."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        held += size
        if held >= SLICE_BYTES or at + 1 - start == SLICE_ROWS or at + 1 == len(sizes):
            yield start, at + 1 - start
            start, held = at + 1, 0


def parse_pages(pages: DataFrame, keep: tuple[str, ...], url: str = "url", html: str = "html") -> DataFrame:
    """Columns ``keep`` of ``pages`` plus title, markdown and links.

    Links are resolved against ``url``. Markdown is NULL for a page without
    content or one that cannot be parsed. A worker holds a slice of a batch in
    parsed form, however many rows Spark sends it at once.
    """
    schema = T.StructType([pages.schema[name] for name in keep] + PARSED)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for some in _slices(batch.column(html)):
                part = batch.slice(*some)
                parsed = [
                    _parse(base, text)
                    for base, text in zip(part.column(url).to_pylist(), part.column(html).to_pylist())
                ]
                kept = [part.column(name).cast(arrow.field(name).type) for name in keep]
                made = [pa.array([row[i] for row in parsed], arrow.field(len(keep) + i).type) for i in range(3)]
                yield pa.RecordBatch.from_arrays(kept + made, schema=arrow)

    columns = list(dict.fromkeys([*keep, url, html]))
    return pages.select(*columns).mapInArrow(run, schema)
