"""Documents that hold passages of a benchmark, changed words allowed.

Spaced seeds: a mask over a dozen neighbouring words looks at eight of them and
ignores the others. Hashes of every window of the documents and of the items
under each mask are joined; a changed word destroys only the windows in which
the mask looks at it. Every hit gives a diagonal, on which item and document
are then compared word by word: a stretch in which equal words outweigh unequal
ones must hold enough equal ones.

Words are lower-cased runs of letters, digits and non-ASCII characters, so
punctuation and layout don't count. Document windows meet a filter of fixed
size made from the items' hashes before they become rows, so what is shuffled
grows with the hits, not with the corpus. An item that half of the documents
hold is one key of a join that Spark splits.

An item shorter than the masks has masks of its own length, which together
ignore every set of words that may be changed. Defined cases: items of fewer
than ``LEAST`` words, null or blank texts and items match nothing; repeated items or documents give
the result of one; ids may be repeated with other texts, which are then
compared one by one; null ids match nothing; empty tables give an empty
result. Other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, settled
from . import bytehash
from .bitmaps import Filter, key_filter, mixed_id

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MASKS = ("110110101101", "11101100111", "101101110011", "111001011011")
SPAN = max(map(len, MASKS))
ENOUGH = 13  # equal words that make a passage, or
SHARE = 0.75  # this share of an item's words, if that is fewer
LEAST = 3  # words of an item; fewer are no passage
PENALTY = 2  # equal words that outweigh one unequal word

_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _tokens(texts: bytehash.Texts) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = texts.words(_APART)
    return bytehash.Prefix(texts.data).hash(start, end), first


def _seeds(words: np.ndarray, offsets: tuple[int, ...], salt: int) -> np.ndarray:
    """The hash under one mask of the window at every word; windows past the end are left out."""
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, salt, np.uint64)
    for k in offsets:
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return bytehash.mix(total)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over a whole item of n words that find it with as many words changed as may differ.

    With t of them, the places fall into t + 2 classes in turn and each mask
    ignores t classes, so one mask ignores all that are changed.
    """
    classes = (t := n - ceil(SHARE * n)) + 2
    return [tuple(i for i in range(n) if i % classes not in ignored) for ignored in combinations(range(classes), t)]


def _shapes(short: list[int]) -> list[tuple[tuple[int, ...], int, int]]:
    """(offsets, salt, words) of every mask; ``words`` is the length of the items that it is for, 0 for all that it fits in."""
    masks = [(tuple(i for i, c in enumerate(m) if c == "1"), k + 1, 0) for k, m in enumerate(MASKS)]
    return masks + [(offsets, 1000 * n + k, n) for n in short for k, offsets in enumerate(short_masks(n))]


def _rows(table: DataFrame, shapes: list, wanted: Filter | None = None) -> DataFrame:
    """(h, id, at): window hashes by text and word position. A short item is sought as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, _, texts in bytehash.texts_of(pc.utf8_lower(batch.column(1))):
                words, first = _tokens(texts)
                length = np.diff(first)
                ends = np.repeat(first[1:], length)
                begins = np.repeat(first[:-1], length)
                for offsets, salt, n in shapes:
                    h = _seeds(words, offsets, salt)
                    at = np.arange(len(h))
                    keep = at + offsets[-1] < ends[: len(h)]
                    if wanted is not None:
                        keep &= wanted.holds(h)
                    elif n:  # items of this length only, at their start
                        keep &= (ends - begins)[: len(h)] == n
                        keep &= begins[: len(h)] == at
                    at = np.flatnonzero(keep)
                    if len(at):
                        row = np.searchsorted(first, at, "right") - 1
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h[at].view(np.int64)), ids.take(pa.array(row + a)), pa.array(at - first[row])],
                            names=["h", "id", "at"],
                        )

    return table.select("id", "text").mapInArrow(run, "h long, id long, at long")


def _token_arrays(table: DataFrame, ids: Filter | None = None) -> DataFrame:
    """(id, tokens): the word hashes of each text, if its id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if ids is not None:
                batch = batch.filter(pa.array(ids.holds(mixed_id(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)))))
            for a, z, texts in bytehash.texts_of(pc.utf8_lower(batch.column(1))):
                words, first = _tokens(texts)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(words.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), lists], names=["id", "tokens"])

    return table.select("id", "text").mapInArrow(run, "id long, tokens array<long>")


def passage(same: np.ndarray, need: int) -> tuple[int, int, int] | None:
    """(equal words, start, end) of the stretch of a diagonal with most equal words, if they are enough.

    Stretches begin at an equal word and go on while their equal words outweigh
    the unequal ones. Each ends where its balance is best or, if it has not
    enough equal words by then, at its last equal word.
    """
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    balance = score - np.minimum.accumulate(score)
    inside = np.concatenate([balance > 0, [False]])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(~inside[1:] & inside[:-1])
    best = None
    for a, z in zip(starts, ends, strict=True):
        for cut in (a + int(balance[a : z + 1].argmax()), a + int(np.flatnonzero(same[a:z])[-1]) + 1):
            n = int(same[a:cut].sum())
            if n >= need:
                if best is None or n > best[0]:
                    best = n, int(a), cut
                break
    return best


def _aligned(pairs: DataFrame) -> DataFrame:
    """Compare item tokens x with the document's y on one diagonal; keep passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, equal, start, end = [], [], [], []
            xs, ys = batch.column("x"), batch.column("y")
            for i, (skip, base) in enumerate(zip(batch.column("skip").to_pylist(), batch.column("base").to_pylist(), strict=True)):
                x, y = xs[i].values.to_numpy(), ys[i].values.to_numpy()
                need = min(ENOUGH, int(np.ceil(SHARE * len(x))))
                x = x[skip : skip + len(y)]
                same = x == y[: len(x)]
                if same.sum() < need:
                    continue
                if (found := passage(same, need)) is not None:
                    kept.append(i)
                    equal.append(found[0])
                    start.append(base + found[1])
                    end.append(base + found[2])
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(rows), batch.column("item").take(rows), *[pa.array(c, pa.int64()) for c in (equal, start, end)]],
                names=["id", "item", "n_equal", "first_word", "end_word"],
            )

    return pairs.mapInArrow(run, "id long, item long, n_equal long, first_word long, end_word long")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_equal, first_word, end_word): the best passage of each item in each document that holds one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").filter("id is not null")
    item_tokens = materialize(_token_arrays(items).filter(F.size("tokens") >= LEAST), "leak-items")
    lengths = item_tokens.select(F.size("tokens").alias("n")).filter(f"n >= {LEAST} and n < {SPAN}").distinct().collect()  # fewer than SPAN rows
    shapes = _shapes(sorted(row["n"] for row in lengths))
    seeds = materialize(_rows(items, shapes), "leak-seeds")
    hits = _rows(docs, shapes, key_filter(seeds, "h"))
    diagonals = (
        hits.join(seeds.select("h", F.col("id").alias("item"), F.col("at").alias("item_at")).distinct(), "h")
        .select("id", "item", (F.col("at") - F.col("item_at")).alias("base"))
        .distinct()
    )
    diagonals = materialize(diagonals, "leak-diagonals")
    wanted = key_filter(diagonals.select(F.col("id").bitwiseXOR(F.shiftrightunsigned("id", 26)).alias("key")), "key")
    x = item_tokens.select(F.col("id").alias("item"), F.col("tokens").alias("x")).distinct()
    narrow = diagonals.join(x.select("item", F.size("x").alias("n")).groupBy("item").agg(F.max("n").alias("n")), "item")
    cut = narrow.join(_token_arrays(docs, wanted), "id").select(
        "id",
        "item",
        F.greatest("base", F.lit(0)).alias("base"),
        F.greatest(-F.col("base"), F.lit(0)).alias("skip"),
        F.slice("tokens", (F.greatest("base", F.lit(0)) + 1).cast("int"), (F.col("n") - F.greatest(-F.col("base"), F.lit(0))).cast("int")).alias("y"),
    )
    found = _aligned(cut.join(x, "item").select("id", "item", "base", "skip", "x", "y"))
    best = found.groupBy("id", "item").agg(F.max(F.struct("n_equal", (-F.col("first_word")).alias("early"), "first_word", "end_word")).alias("m"))
    return best.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "m.n_equal", "m.first_word", "m.end_word")


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark."""
    bad = settled(lambda: leaks(docs, benchmark).select(F.col("doc_id").alias("_id")).distinct(), "leak-verdicts")
    return docs.join(bad, F.col("doc_id") == F.col("_id"), "left_anti")
