"""Remove every byte that a repeated string of 200 bytes covers.

A depth-limited radix sort of the suffixes: only their first 200 bytes count,
and they are told apart by most-significant-digit passes in which a group that
has become a single suffix drops out, and a group known to be equal to its end
is finished. What is left over at the last digit is compared window by window.

Sorting every suffix would shuffle each text a hundred times over, so suffixes
move in cells of neighbours. Every window is assigned to the smallest of its
100-byte strings by hash: equal windows choose the same one, at the same
offset. A cell holds the neighbouring windows of one choice and has two digits:

* ``core``, the bytes that all its windows share: cells with different cores
  have no window in common;
* ``full``, all bytes of all its windows: cells with equal ones have all
  windows in common, and these are repeated.

Cells whose core recurs with another full digit are cut into narrower ones, one
representative for each pair of digits, until a cell is a window. Equal texts
are one text throughout. What is shuffled is one narrow row per cell whose core
may recur; the positions come from rescanning the texts, never from shuffling
them. Groups are only ever counted (smallest and largest member), so a passage
that a third of the corpus holds is combined within tasks first.

Strings are known by 64-bit hashes. Defined cases: a null text is empty; texts
under 200 bytes lose nothing; repeated rows repeat each other and are removed,
ids may be repeated with other texts; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import bytehash
from .bitmaps import BITS, Filter, key_filter, mixed_id

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 200
_WIDTHS = (101, 10, 1)  # windows in a cell, by pass; the first is LENGTH - _CHOSEN + 1
_CHOSEN = 100

_CELL = "core long, full long, cell long, text long, start long, end long"


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            total = bytehash.mix(np.asarray(total + np.asarray(p).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return total


class _Scan:
    """Text keys and cells of one run of texts."""

    def __init__(self, texts: bytehash.Texts):
        self.texts, self.prefix = texts, bytehash.Prefix(texts.data)
        starts = texts.starts
        self.keys = _mixed(self.prefix.hash(starts[:-1], starts[1:]), np.diff(starts))

    def choices(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, chosen, first, last): runs of neighbouring windows of the wanted texts that choose the same string."""
        starts = self.texts.starts
        grams = self.prefix.windows(_CHOSEN)
        n = len(self.texts.data) - LENGTH + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 4
        low = np.uint64(32)
        keyed = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
        chosen = (_sliding_minimum(keyed, _WIDTHS[0]) & np.uint64((1 << 32) - 1)).astype(np.int64)
        text = np.repeat(np.arange(len(self.texts)), np.diff(starts))[:n]
        at = np.flatnonzero((np.arange(n) + LENGTH <= starts[1:][text]) & wanted[text])
        if not len(at):
            return (np.zeros(0, np.int64),) * 4
        chosen = chosen[at]
        new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)]))
        last = np.concatenate([new[1:], [len(at)]]) - 1
        return text[at[new]], chosen[new], at[new], at[last]

    def cells(self, wanted: np.ndarray, turn: int, parents: Filter | None) -> dict[str, np.ndarray]:
        """The cells of one pass whose parent cell may be open."""
        text, chosen, first, last = self.choices(wanted)
        width = _WIDTHS[turn]
        low, high = (chosen - last) // width, (chosen - first) // width
        reps = high - low + 1
        index = np.repeat(np.arange(len(text)), reps)
        part = low[index] + np.arange(len(index)) - np.repeat(np.cumsum(reps) - reps, reps)
        text, chosen, first, last = text[index], chosen[index], first[index], last[index]
        inside = chosen - self.texts.starts[text]
        if parents is not None:
            wider = _mixed(self.keys[text], inside, part * width // _WIDTHS[turn - 1], turn - 1)
            keep = parents.holds(wider)
            text, chosen, first, last, part, inside = (x[keep] for x in (text, chosen, first, last, part, inside))
        a = np.maximum(first, chosen - (part * width + width - 1))
        z = np.minimum(last, chosen - part * width)
        shared = chosen - part * width
        begin = self.texts.starts[text]
        return {
            "core": _mixed(self.prefix.hash(shared, shared - width + 1 + LENGTH), part, turn),
            "full": _mixed(self.prefix.hash(a, z + LENGTH), chosen - a, chosen - z),
            "cell": _mixed(self.keys[text], inside, part, turn),
            "text": self.keys[text],
            "start": (a - begin).astype(np.uint64),
            "end": (z + LENGTH - begin).astype(np.uint64),
        }


def _scans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, _Scan]]:
    for batch in batches:
        for a, z, texts in bytehash.texts_of(batch.column(1)):
            yield batch, a, z, _Scan(texts)


def _digests(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, z, scan in _scans(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, z - a), pa.array(scan.keys.view(np.int64)), pa.array(np.diff(scan.texts.starts).astype(np.int64))],
                names=["id", "text", "n_bytes"],
            )

    return docs.mapInArrow(run, "id long, text long, n_bytes long")


def _heads(batch: pa.RecordBatch, a: int, z: int, ids: Filter) -> np.ndarray:
    """Whether each row may be the one that stands for its text; rows without an id may."""
    column = batch.column(0).slice(a, z - a)
    return ids.holds(mixed_id(column.fill_null(0).to_numpy(zero_copy_only=False))) | column.is_null().to_numpy(zero_copy_only=False)


def _cells(docs: DataFrame, turn: int, ids: Filter, texts: Filter, parents: Filter | None, recurring: Filter | None) -> DataFrame:
    """Cells of one pass, of rows and texts that the first filters hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, z, scan in _scans(batches):
            wanted = _heads(batch, a, z, ids) & texts.holds(scan.keys)
            if wanted.any():
                cells = scan.cells(wanted, turn, parents)
                keep = recurring.holds(cells["core"]) if recurring is not None else slice(None)
                yield pa.RecordBatch.from_pydict({k: pa.array(v[keep].view(np.int64)) for k, v in cells.items()})

    return docs.mapInArrow(run, _CELL)


def _positions(docs: DataFrame, ids: Filter) -> DataFrame:
    """(at): the filter position of every core of the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, z, scan in _scans(batches):
            core = scan.cells(_heads(batch, a, z, ids), 0, None)["core"]
            yield pa.RecordBatch.from_arrays([pa.array((core & np.uint64((1 << BITS) - 1)).astype(np.int32))], names=["at"])

    return docs.mapInArrow(run, "at int")


def _removed(docs: DataFrame, spans: DataFrame, touched: Filter) -> DataFrame:
    """The result rows: a text without spans travels as its digest, the others meet their spans as texts."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, z, scan in _scans(batches):
            hit = touched.holds(scan.keys)
            starts, data = scan.texts.starts, scan.texts.data
            sha = [None if h else hashlib.sha256(data[s:e]).hexdigest() for h, s, e in zip(hit, starts[:-1], starts[1:], strict=True)]
            content = batch.column(1).take(pa.array(np.arange(a, z), pa.int64(), mask=~hit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, z - a), pa.array(scan.keys.view(np.int64)), pa.array(np.diff(starts).astype(np.int64)), pa.array(sha, pa.string()), content],
                names=["id", "key", "n_bytes", "sha", "content"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, sha = [], [], []
            for known, text, spans in zip(batch.column("sha").to_pylist(), batch.column("content"), batch.column("spans"), strict=True):
                if known is not None:
                    removed.append(0)
                    runs.append(0)
                    sha.append(known)
                    continue
                text = (text.as_py() or "").encode()
                gone = np.zeros(len(text) + 2, np.int32)
                if spans.is_valid:
                    flat = spans.values.flatten()
                    np.add.at(gone, flat[0].to_numpy() + 1, 1)
                    np.add.at(gone, flat[1].to_numpy() + 1, -1)
                covered = np.cumsum(gone) > 0  # covered[i + 1]: byte i goes
                removed.append(int(covered.sum()))
                runs.append(int((covered[1:] & ~covered[:-1]).sum()))
                sha.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~covered[1 : len(text) + 1]]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())],
                names=["id", "n_bytes", "n_removed", "n_spans", "sha"],
            )

    scanned = docs.mapInArrow(plain, "id long, key long, n_bytes long, sha string, content string")
    met = scanned.join(spans, F.col("key") == F.col("text"), "left").select("id", "n_bytes", "sha", "content", "spans")
    return met.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, sha string")


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("content"))
    texts = materialize(_digests(docs), "repeats-digests").filter(F.col("n_bytes") >= LENGTH)
    copies = texts.groupBy("text", "n_bytes").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    spans = copies.select("text", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))

    # One document stands for each text, and is scanned; that the filter lets some copies pass changes nothing.
    heads = texts.groupBy("text").agg(F.min("id").alias("id")).select(F.col("id").bitwiseXOR(F.shiftrightunsigned("id", BITS)).alias("key"))
    ids = key_filter(heads.filter("key is not null"), "key")
    counted = _positions(docs, ids).groupBy("at").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    recurring, parents = key_filter(counted, "at"), None
    wanted = key_filter(texts, "text")
    for turn in range(len(_WIDTHS)):
        cells = materialize(_cells(docs, turn, ids, wanted, parents, recurring), "repeats-cells")
        digits = cells.groupBy("core", "full").agg(F.min("cell").alias("first"), F.max("cell").alias("last"))
        digits = materialize(digits, "repeats-digits")
        equal = digits.filter("first <> last").select("core", "full")
        spans = spans.union(cells.join(equal, ["core", "full"], "left_semi").select("text", "start", "end"))
        if turn + 1 < len(_WIDTHS):
            several = digits.groupBy("core").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("core")
            still = materialize(digits.join(several, "core", "left_semi").select("first"), "repeats-open")
            owners = cells.join(still, F.col("cell") == F.col("first"), "left_semi").select("text")
            recurring, parents, wanted = None, key_filter(still, "first"), key_filter(owners, "text")
    spans = materialize(spans.groupBy("text").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "repeats-spans")
    found = _removed(docs, spans, key_filter(spans, "text"))
    return found.select(F.col("id").alias(id), "n_bytes", "n_removed", "n_spans", F.col("sha").alias("kept_sha256"))
