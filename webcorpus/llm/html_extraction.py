"""The main text of HTML pages, by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: stretches of text between block
tags, each with the path of tags above it and its words. The whole path and all
words, with their counts, are hashed into sparse vectors of fixed width; a bidirectional LSTM in numpy reads the sequence, so that every
block is judged with all that comes before and after it in the document, and
labels it as article or not.

The labeller is trained here, without labels from outside, on pages it makes
from a bounded sample of the given ones (``SAMPLE_PAGES``): where a page says by
its markup what a block is (article, nav, footer, a class such as ``ad``), that
is the label, while the path that the network is shown has these names hidden
half of the time, so that it must use position, neighbours, words and links as
well. Pages are then labelled in the tasks that read them, a few hundred in one
matrix product per position; there is no shuffle.

Where the markup rules a block out it stays out, whatever the network says:
script, style, form and the like are no blocks at all (a form, button or the like
without an end tag only up to the first block tag in it), and blocks in a nav, a
footer or an element named as an advert, a menu or comments are never kept. Only
a whole class, id or role counts, of the nearest element that says something; on
an element that is or holds an article or main it is evidence for the network and
no more. If the sample doesn't state labels of both kinds there is no network:
then every block is kept that the markup doesn't rule out.

Defined cases: null or empty html gives an empty text; a page without article
blocks has an empty text; broken markup is read leniently; repeated rows are
extracted each; an empty table gives an empty result. Columns other than
page_id, url and html are not read.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_PAGES = 240
MOST_BLOCKS = 400  # of a training page: longer ones are not learnt from; pages to extract are of any length
MOST_HTML = 200_000  # characters of a training page, likewise
TAG_BUCKETS, WORD_BUCKETS, HIDDEN = 256, 512, 16
EPOCHS, RATE = 6, 0.02
_TOGETHER = 256  # pages labelled in one go

# Names of HTML: fixed values.
_BLOCK = frozenset(
    "html head body title article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption nav aside header footer form fieldset address hr details summary".split()
)
_NEVER = frozenset("script style noscript template head title form button select textarea iframe svg math object canvas".split())
_HEAD_CONTENT = frozenset("html head title meta link base basefont bgsound script style noscript noframes template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY = {"p": _BLOCK - {"html", "head", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
_CLOSED_BY |= {"option": {"option", "optgroup"}, "optgroup": {"optgroup"}, "select": {"select", "input", "textarea"}, "button": {"button"}}
_OUTSIDE = frozenset("nav footer aside header".split())
_OUTSIDE_WORDS = (
    r"(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|foot\w*|head(?:er)?|masthead|cookies?|consent|notice|"
    r"comments?|reply|replies|disqus|share|social|related|recommend\w*|newsletter|subscribe|login|search|widget|popup|modal|copyright|legal|meta|tags?)"
)
_OUTSIDE_NAME = re.compile(rf"(?:^| ){_OUTSIDE_WORDS}(?:$| )")  # as a whole name: tag-python or no-sidebar say nothing
_INSIDE = frozenset("article main".split())
_INSIDE_NAME = re.compile(  # post-meta or comment-text say nothing
    rf"(?:^| )(?!(?:[^ ]*[-_])?{_OUTSIDE_WORDS}(?:$|[-_ ]))(?:[^ ]*[-_])?(?:article|content|post|entry|story|main|body|text)(?:$|[-_ ])"
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|([^<]+|<)", re.S)
_NAME = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")  # also no-break and other blanks that references stand for
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # tag, or tag.names for elements with a class, id or role
    linked: int  # characters inside links
    holders: int = 0  # so many elements of the path, from the top, are or hold an article or main


@dataclass(eq=False)
class _Element:
    tag: str
    shown: str
    holds: bool = False  # it is or holds an article or main
    ended: bool = False  # by its own end tag
    reach: int | None = None  # blocks found when the first block tag opened in it


def _hidden(above: list[_Element], at: int) -> bool:
    """Whether an element hides block ``at``: wholly if its end tag is there, else up to the first block tag in it."""
    return any(e.tag in _NEVER and (e.ended or e.reach is None or at < e.reach) for e in above)


def blocks_of(html: str) -> list[Block]:
    """The leaf blocks of a page in order: text between block tags, white space made one blank."""
    found: list[tuple[str, list[_Element], int]] = []
    stack: list[_Element] = []
    text: list[str] = []
    linked = [0]
    open_never: list[_Element] = []

    def close_block() -> None:
        joined = _SPACE.sub(" ", "".join(text)).strip(" ")
        if joined:
            found.append((joined, stack.copy(), linked[0]))
        text.clear()
        linked[0] = 0

    def pop(to: int) -> None:
        if open_never and any(e.tag in _NEVER for e in stack[to:]):
            close_block()
        while len(stack) > to:
            if stack.pop().tag in _NEVER:
                open_never.pop()

    def opens(tag: str) -> None:
        """Close what the start tag ends."""
        if stack and stack[-1].tag == "head" and tag not in _HEAD_CONTENT:
            pop(len(stack) - 1)
        if open_never and open_never[-1].tag in ("select", "button") and tag in _CLOSED_BY[open_never[-1].tag]:
            pop(stack.index(open_never[-1]))
        while stack and tag in _CLOSED_BY.get(stack[-1].tag, ()):
            pop(len(stack) - 1)

    at, end = 0, len(html)
    while at < end:
        match = _TOKEN.match(html, at)
        if match is None:  # a tag that never ends
            break
        at = match.end()
        closing, tag, attributes, words = match.groups()
        if words is not None:
            if stack and stack[-1].tag == "head" and words.strip():
                pop(len(stack) - 1)
            plain = unescape(words)
            text.append(plain)
            if any(e.tag == "a" for e in stack):
                linked[0] += len(plain)
        elif tag:
            tag = tag.lower()
            if tag == "br":
                text.append(" ")
                continue
            if tag in _BLOCK or tag in _NEVER:
                close_block()
            if closing:
                where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
                if where is not None:
                    stack[where].ended = True
                    pop(where)
                continue
            if tag == "head" and any(e.tag != "html" for e in stack):  # only one, at the start
                continue
            opens(tag)
            if tag in _VOID:
                continue
            if tag in _BLOCK:  # inline elements left open don't reach into the next block
                while stack and stack[-1].tag not in _BLOCK and stack[-1].tag not in _NEVER:
                    pop(len(stack) - 1)
                opens(tag)
                for e in open_never:
                    if e.reach is None:
                        e.reach = len(found)
            names = " ".join(next(filter(None, m), "") for m in _NAME.findall(attributes)).lower() if "=" in attributes else ""
            stack.append(_Element(tag, f"{tag}.{names}" if names else tag))
            if tag in _INSIDE:
                for e in reversed(stack):
                    if e.holds:  # so do all above it
                        break
                    e.holds = True
            if tag in _NEVER:
                open_never.append(stack[-1])
            if tag in _RAW:
                ending = _RAW[tag].search(html, at)
                at = ending.end() if ending else end
                pop(len(stack) - 1)
    close_block()
    return [Block(joined, tuple(e.shown for e in above), n, sum(e.holds for e in above)) for i, (joined, above, n) in enumerate(found) if not _hidden(above, i)]


def stated(block: Block) -> int:
    """What the markup says: 1 article, 0 not, -1 nothing or both.

    Tags such as nav rule out all below them, but a header in an article or main is
    the article's own. Of the names, the nearest that says anything counts. On what is or holds an article or main, the name of something
    outside rules nothing out.
    """
    tags = [shown.partition(".")[0] for shown in block.path]
    if any(tag in _OUTSIDE and not (tag == "header" and _INSIDE & {*tags[:k]}) for k, tag in enumerate(tags)):
        return 0
    verdict = -1
    for depth in range(len(block.path) - 1, -1, -1):
        tag, _, names = block.path[depth].partition(".")
        outside = names and tag not in ("html", "body") and _OUTSIDE_NAME.search(names)
        inside = tag in _INSIDE or (names and _INSIDE_NAME.search(names))
        if depth < block.holders:
            if verdict < 0 and inside and not outside:
                verdict = 1
        elif outside:
            return -1 if verdict == 1 else 0  # article text below something outside: the network decides
        elif inside:
            verdict = 1
    return verdict


def _hide(path: tuple[str, ...]) -> tuple[str, ...]:
    return tuple("div" if (tag := shown.partition(".")[0]) in _OUTSIDE | _INSIDE | {"section"} else tag for shown in path)


Features = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_seen: dict[tuple[str, int], int] = {}


def _bucket(name: str, size: int) -> int:
    if len(name) > 60:
        return crc32(name.encode("utf-8", "replace")) % size
    found = _seen.get((name, size))
    if found is None:
        if len(_seen) > 200_000:
            _seen.clear()
        found = _seen[name, size] = crc32(name.encode("utf-8", "replace")) % size
    return found


def features(blocks: list[Block], hide: bool = False) -> Features:
    """(indices, weights, starts, dense): the buckets of each block's whole path and all its words, with their counts, and plain measures.

    A tag counts by its distance from the text, and once more by its name alone.
    """
    flat: list[int] = []
    weights: list[float] = []
    paths: dict[tuple[str, ...], list[int]] = {}
    starts = [0]
    dense = np.zeros((len(blocks), 6), np.float32)
    n = len(blocks)
    for i, block in enumerate(blocks):
        path = _hide(block.path) if hide else block.path
        above = paths.get(path)
        if above is None:
            above = [_bucket(f"{k}:{shown}", TAG_BUCKETS) for k, shown in enumerate(reversed(path))]
            above += [_bucket(f"^:{shown}", TAG_BUCKETS) for shown in sorted(set(path))]
            paths[path] = above
        counts: Counter[int] = Counter()
        for word, times in Counter(block.text.lower().split(" ")).items():
            counts[TAG_BUCKETS + _bucket(word, WORD_BUCKETS)] += times
        flat += above
        flat += counts.keys()
        weights += [1.0] * len(above)
        weights += [1 + log(times) for times in counts.values()]
        starts.append(len(flat))
        length = len(block.text)
        dense[i] = (
            np.log1p(length) / 6, block.linked / length, block.text[-1:] in ".!?…", i / n, min(n - i, 10) / 10, block.text.count(".") / (1 + length / 60),
        )
    starts_at, weight = np.array(starts), np.array(weights, np.float32)
    if blocks:
        weight /= np.sqrt(np.repeat(np.add.reduceat(weight * weight, starts_at[:-1]), np.diff(starts_at)))
    return np.array(flat, np.int64), weight, starts_at, dense


@dataclass
class Labeller:
    """Weights of both directions and of the output; ``p`` holds all by name."""

    p: dict[str, np.ndarray]

    def read(self, pages: list[Features]) -> tuple[np.ndarray, np.ndarray, dict]:
        """(logits, mask, what training needs) for pages side by side: pages x positions."""
        longest = max(len(d) for *_, d in pages)
        inputs = np.zeros((len(pages), longest, HIDDEN), np.float32)
        mask = np.zeros((len(pages), longest), bool)
        for k, (flat, weight, starts, dense) in enumerate(pages):
            if len(dense):
                inputs[k, : len(dense)] = np.add.reduceat(self.p["table"][flat] * weight[:, None], starts[:-1], axis=0) + dense @ self.p["dense"]
                mask[k, : len(dense)] = True
        inputs = np.tanh(inputs)
        memo: dict = {"inputs": inputs, "mask": mask}
        out = np.zeros((len(pages), longest, 2 * HIDDEN), np.float32)
        for way, order in (("f", range(longest)), ("b", range(longest - 1, -1, -1))):
            w, u, b = (self.p[way + x] for x in "wub")
            h = c = np.zeros((len(pages), HIDDEN), np.float32)
            steps = []
            for t in order:
                z = inputs[:, t] @ w + h @ u + b
                gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
                i, f, o = np.split(gates, 3, axis=1)
                g = np.tanh(z[:, 3 * HIDDEN :])
                m = mask[:, t, None]
                new = f * c + i * g
                tanh = np.tanh(new)
                steps.append((t, h, c, i, f, o, g, tanh, m))
                c, h = np.where(m, new, c), np.where(m, o * tanh, h)
                out[:, t, HIDDEN * (way == "b") : HIDDEN * (1 + (way == "b"))] = h
            memo[way] = steps
        memo["out"] = out
        return out @ self.p["out"] + self.p["base"][0], mask, memo

    def gradients(self, pages: list, memo: dict, error: np.ndarray) -> dict[str, np.ndarray]:
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        out, inputs = memo["out"], memo["inputs"]
        g["out"], g["base"][0] = np.einsum("pt,pth->h", error, out), error.sum()
        g_out = error[:, :, None] * self.p["out"]
        g_in = np.zeros_like(inputs)
        for way in "fb":
            w, u = self.p[way + "w"], self.p[way + "u"]
            half = g_out[:, :, HIDDEN * (way == "b") : HIDDEN * (1 + (way == "b"))]
            gh = gc = np.zeros((len(pages), HIDDEN), np.float32)
            for t, h, c, i, f, o, gate, tanh, m in reversed(memo[way]):
                gh = gh + half[:, t]
                d = gc + gh * o * (1 - tanh * tanh)
                z = np.concatenate([d * gate * i * (1 - i), d * c * f * (1 - f), gh * tanh * o * (1 - o), d * i * (1 - gate * gate)], 1) * m
                g[way + "w"] += inputs[:, t].T @ z
                g[way + "u"] += h.T @ z
                g[way + "b"] += z.sum(axis=0)
                g_in[:, t] += z @ w.T
                gh, gc = np.where(m, z @ u.T, gh), np.where(m, d * f, gc)
        g_in *= 1 - inputs * inputs
        for k, (flat, weight, starts, dense) in enumerate(pages):
            if len(dense):
                own = g_in[k, : len(dense)]
                g["dense"] += dense.T @ own
                np.add.at(g["table"], flat, np.repeat(own, np.diff(starts), axis=0) * weight[:, None])
        return g


def train(pages: list[str], seed: int = 5) -> Labeller | None:
    """Fit on pages whose markup states labels; every page is shown as it is and with its names hidden. None without labels of both kinds."""
    rng = np.random.default_rng(seed)
    examples = []
    for html in pages:
        blocks = blocks_of(html)
        y = np.array([stated(b) for b in blocks])
        if len(blocks) <= MOST_BLOCKS and (y >= 0).any():
            examples += [(features(blocks, hide), y) for hide in (False, True)]
    if {0, 1} - {int(v) for _, y in examples for v in y}:
        return None  # labels of one kind only would make it say always the same
    normal = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
    p = {"table": normal(TAG_BUCKETS + WORD_BUCKETS, HIDDEN), "dense": normal(6, HIDDEN), "out": normal(2 * HIDDEN), "base": np.zeros(1, np.float32)}
    for way in "fb":
        p |= {way + "w": normal(HIDDEN, 4 * HIDDEN), way + "u": normal(HIDDEN, 4 * HIDDEN), way + "b": np.zeros(4 * HIDDEN, np.float32)}
        p[way + "b"][HIDDEN : 2 * HIDDEN] = 1
    model = Labeller(p)
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), 16):
            batch = [examples[i] for i in order[at : at + 16]]
            inputs = [x for x, _ in batch]
            logits, mask, memo = model.read(inputs)
            y = np.full(mask.shape, -1)
            for k, (_, own) in enumerate(batch):
                y[k, : len(own)] = own
            known = y >= 0
            error = np.where(known, 1 / (1 + np.exp(-logits)) - (y == 1), 0).astype(np.float32) / max(known.sum(), 1)
            step += 1
            for k, g in model.gradients(inputs, memo, error).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _texts(pages: list[str], model: Labeller | None) -> list[str]:
    blocks = [blocks_of(html) for html in pages]
    kept: list[list[str]] = [[] for _ in pages]
    # Pages of like length side by side waste no positions; a page of any length is read whole.
    order = sorted((i for i in range(len(pages)) if blocks[i]), key=lambda i: len(blocks[i]))
    at = 0
    while at < len(order):
        width = max(1, min(_TOGETHER, 40_000 // max(len(blocks[order[min(at + _TOGETHER, len(order)) - 1]]), 1)))
        part = order[at : at + width]
        at += width
        if model is None:
            labels = [np.array([stated(b) != 0 for b in blocks[i]]) for i in part]
        else:
            logits, _, _ = model.read([features(blocks[i]) for i in part])
            labels = [(logits[k, : len(blocks[i])] > 0) & np.array([stated(b) != 0 for b in blocks[i]]) for k, i in enumerate(part)]
        for i, yes in zip(part, labels, strict=True):
            kept[i] = [b.text for b, y in zip(blocks[i], yes, strict=True) if y]
    return ["\n\n".join(k) for k in kept]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    chosen = pages.select("page_id").filter("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)
    sample = pages.select("page_id", "html").join(chosen, "page_id", "left_semi").filter(F.length("html") <= MOST_HTML)
    model = train([r["html"] for r in sample.orderBy("page_id", "html").limit(SAMPLE_PAGES).collect()])
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                texts = _texts([h or "" for h in part.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
