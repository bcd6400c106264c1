"""Alignment of two tokenizers' tokens over the same bytes, and how often ids are linked in the whole corpus.

Tokenizer A is a byte-level BPE file, B a SentencePiece model that puts a blank
before each text. Both cover the bytes of a blank and the text. Groups are the
least stretches that both end at: all tokens of A and B are sorted by start,
the running maximum of their ends is taken, and a group breaks where a start
reaches it. Within groups, overlaps are expanded into links; ``end`` links are
those whose tokens end together, ``overlap`` links are all.

No token of either side crosses from a visible character to a blank after it,
so texts are cut there into units, and each distinct unit of a block of texts
is encoded and aligned once. A block is one row: its documents, the units in
each, and its distinct linked pairs. Pairs are counted over all blocks, joined
back to the blocks they occur in, and each block sums up its documents. A
frequent pair thus has one row per block, however often it is linked.

Defined cases: null and empty texts, and texts that either tokenizer doesn't
give back byte for byte (U+2581 in a text, say), have no tokens: zeros and an
empty string; strings of special tokens are plain text; repeated rows count and
are returned each; an empty table gives an empty result; ids may be of any type
and null; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 4 << 20  # of text in a block
_CACHED = 60_000  # units that a worker remembers
_AT_ONCE = 4_000  # units that are encoded at one time
_LOW = (1 << 32) - 1
_BLANK = "▁"
_MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


def default_tokenizers() -> tuple[str, str]:
    """The files of A and B."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: visible Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def align(starts: np.ndarray, ends: np.ndarray, n_a: int) -> np.ndarray:
    """The group of each token: the first ``n_a`` are A's in order, then B's; both cover the same bytes."""
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.concatenate([[True], starts[order][1:] >= reached[:-1]]) if len(order) else np.zeros(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group


def overlaps(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (A token, B token) whose ranges overlap, by A."""
    first = np.searchsorted(ends_b, starts_a, "right")
    n = np.searchsorted(starts_b, ends_a, "left") - first
    a = np.repeat(np.arange(len(starts_a)), n)
    return a, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def unit_cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin: at each text, and at each blank after a character that is surely visible.

    Visible are ASCII but for controls, and characters whose lead byte has no white space among its characters.
    """
    back = lambda k: np.concatenate([np.zeros(k, np.uint8), data[:-k]]) if len(data) >= k else np.zeros(len(data), np.uint8)
    one, two, three, four = back(1), back(2), back(3), back(4)
    tail = one >= 0x80
    visible = (one > 0x20) & (one < 0x7F)
    visible |= tail & (two >= 0xC3) & (two <= 0xDF)
    visible |= tail & (two >= 0x80) & (two < 0xC0) & ((three >= 0xE4) & (three <= 0xEF) | (three == 0xE0))
    visible |= tail & (two >= 0x80) & (two < 0xC0) & (three >= 0x80) & (three < 0xC0) & (four >= 0xF0)
    cut = (data == 0x20) & visible
    cut[starts[:-1][starts[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


class Tokenizers:
    """Both tokenizers in a worker, and all units that it remembers."""

    def __init__(self, a: str, b: bytes, links: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.links = Tokenizer.from_str(a), links
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        of_char, names = byte_characters(), {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [
            bytes(map(of_char.__getitem__, t)) if all(c in of_char for c in t) else t.encode()
            for t in (names.get(i, "") for i in range(max(names) + 1))
        ]
        self.bytes_b = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(_BLANK, " ").encode()
            for i in range(self.b.get_piece_size())
        ]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.blank = [self.b.piece_to_id(_BLANK)]
        self.spelt = [f"{i}{mark}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for mark in ",|;"]
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.text: list[str] = []  # a unit's groups
        self.pairs: list[np.ndarray] = []  # a unit's links
        self.counts = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, and 1 if the unit does not come back

    def find(self, units: list[bytes]) -> np.ndarray:
        """The number of each unit; new ones are encoded and aligned."""
        new = [u for u in units if u not in self.index]
        self.index.update(zip(new, range(len(self.text), len(self.text) + len(new))))
        for i in range(0, len(new), _AT_ONCE):
            self._add(new[i : i + _AT_ONCE])
        return np.array([self.index[u] for u in units], np.int64)

    def _add(self, units: list[bytes]) -> None:
        texts = [u.decode() for u in units]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = [ids if len(t) > 1 else self.blank for t, ids in zip(texts, self.b.encode([t[1:] for t in texts], num_threads=1), strict=True)]
        broken = np.array([
            b"".join(map(self.bytes_a.__getitem__, x)) != u or b"".join(map(self.bytes_b.__getitem__, y)) != u
            for u, x, y in zip(units, a, b, strict=True)
        ])
        for i in np.flatnonzero(broken):
            a[i], b[i] = [], []
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        flat_a, flat_b = (np.array([i for x in side for i in x], np.int64) for side in (a, b))
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        starts_a, starts_b = ends_a - self.size_a[flat_a], ends_b - self.size_b[flat_b]
        group = align(np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b]), len(flat_a))
        of_a, of_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        last_groups = np.unique(group[: len(flat_a)], return_index=True)[1]
        n_groups = np.bincount(of_a[last_groups], minlength=len(units))

        left, right = overlaps(starts_a, ends_a, starts_b, ends_b)
        if self.links == "end":
            together = ends_a[left] == ends_b[right]
            left, right = left[together], right[together]
        n_links = np.bincount(of_a[left], minlength=len(units))
        linked, bounds = flat_a[left] << 32 | flat_b[right], [0, *np.cumsum(n_links).tolist()]
        self.pairs += [linked[x:z] for x, z in zip(bounds, bounds[1:])]

        ids, side = np.concatenate([flat_a, flat_b]), np.repeat([0, 1], [len(flat_a), len(flat_b)])
        order = np.lexsort((side, group))  # stable: tokens of a side stay in order
        ids, side, group, unit = ids[order], side[order], group[order], np.concatenate([of_a, of_b])[order]
        mark = np.zeros(len(ids), np.int64)
        mark[:-1] = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
        codes = (ids * 3 + mark).tolist()
        cuts = np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
        self.text += ["".join(map(self.spelt.__getitem__, codes[x:z])).rstrip(",;|") for x, z in zip(cuts, cuts[1:])]
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links, broken], axis=1)])


def _units(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(units of all texts, encoded by their distinct values; where each text's units end). Null and empty texts have none."""
    some = pc.greater(pc.binary_length(texts).fill_null(0), 0)
    joined = pc.if_else(some, pc.binary_join_element_wise(" ", texts.fill_null(""), ""), "").cast(pa.large_binary())
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets - offsets[0]
    cuts = unit_cuts(data, starts)
    bounds = pa.py_buffer(np.append(cuts, len(data)).astype(np.int64).tobytes())
    units = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, bounds, pa.py_buffer(data)])
    return units.dictionary_encode(), np.searchsorted(cuts, starts[1:])


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[ends], prepend=0)


def blocks(docs: DataFrame, a: str, b: bytes, links: str) -> DataFrame:
    """One row per block of the rows (id, text): columns of its documents, its linked pairs with their counts, and which units its documents hold."""
    files = docs.sparkSession.sparkContext.broadcast((a, b))  # tokenizer files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        both = Tokenizers(*files.value, links)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
            row = 0
            while row < batch.num_rows:
                end = max(int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + BLOCK_BYTES, "right")), row + 1)
                yield _block(batch.slice(row, end - row), both, number)
                row, number = end, number + 1
        both.clear()
        del both
        gc.collect()  # the worker lives on

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(
        run,
        f"block long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
        "groups_sha256 array<string>, units binary, pairs array<long>, times array<long>",
    )


def _block(rows: pa.RecordBatch, both: Tokenizers, number: int) -> pa.RecordBatch:
    units, ends = _units(rows.column("text"))
    if len(both.text) > _CACHED:
        both.clear()
    known = both.find(units.dictionary.to_pylist())
    local = units.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    here = known[local]
    broken = _per_text(both.counts[here, 4], ends) > 0
    if broken.any():  # these texts have no units
        sizes = np.diff(ends, prepend=0)
        kept = np.repeat(~broken, sizes)
        local, here, ends = local[kept], here[kept], np.cumsum(np.where(broken, 0, sizes))
    counts = [_per_text(both.counts[here, k], ends) for k in range(4)]
    texts, at, digests = both.text, here.tolist(), []
    for x, z in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        digests.append(hashlib.sha256(";".join(map(texts.__getitem__, at[x:z])).encode()).hexdigest() if z > x else "")

    used, times_used = np.unique(here, return_counts=True)
    linked = [both.pairs[i] for i in used.tolist()]
    sizes = np.array([len(x) for x in linked], np.int64)
    pairs, place = np.unique(np.concatenate([*linked, np.zeros(0, np.int64)]), return_inverse=True)
    times = np.bincount(place, np.repeat(times_used, sizes), len(pairs)).astype(np.int64)
    unit = np.searchsorted(used, here)
    parts = [ends, unit, np.cumsum(sizes), place]
    payload = np.concatenate([[len(x) for x in parts], *parts]).astype(np.int32).tobytes()

    def nested(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    columns = [pa.array([number]), nested(rows.column("id")), *(nested(pa.array(c)) for c in counts), nested(pa.array(digests, pa.string()))]
    columns += [pa.array([pa.compress(payload, "zstd", asbytes=True) + len(payload).to_bytes(8, "little")]), nested(pa.array(pairs)), nested(pa.array(times))]
    return pa.RecordBatch.from_arrays(columns, names=["block", "ids", *_MEASURES, "groups_sha256", "units", "pairs", "times"])


def _unpacked(units: bytes) -> list[np.ndarray]:
    data = np.frombuffer(pa.decompress(units[:-8], int.from_bytes(units[-8:], "little"), "zstd", asbytes=True), np.int32)
    return np.split(data[4:], np.cumsum(data[:3]))


def pair_counts(occurring: DataFrame) -> DataFrame:
    """(pair, count, is_best) of the rows (block, place, pair, times): links in the corpus, and whether no other A id has more with this B id."""
    counts = materialize(occurring.groupBy("pair").agg(F.sum("times").alias("count")), "alignment-counts")
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(_LOW)))
    best = counts.groupBy("b").agg(F.max("count").alias("most"))  # as many rows as B's vocabulary at most
    return counts.join(F.broadcast(best), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("is_best"))


def digest(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, links: str = "end", id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    if links not in ("end", "overlap"):
        raise ValueError(f"links must be end or overlap, not {links}")
    default_a, default_b = default_tokenizers()
    with open(a_file or default_a, encoding="utf-8") as file:
        a = json.dumps(json.load(file))
    with open(b_file or default_b, "rb") as file:
        b = file.read()
    stored = materialize(blocks(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), a, b, links), "alignment")
    occurring = stored.select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "x")).select("block", "place", "x.pairs", "x.times")
    occurring = occurring.withColumnRenamed("pairs", "pair")
    valued = occurring.join(pair_counts(occurring), "pair").groupBy("block").agg(
        F.collect_list(F.struct("place", "count", "is_best")).alias("links")  # a block's pairs, bounded by its text
    )
    joined = stored.drop("pairs", "times").join(valued, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                of_block = {name: row.column(name).flatten() for name in ("ids", *_MEASURES, "groups_sha256", "links")}
                links = of_block["links"]
                place = links.field("place").to_numpy(zero_copy_only=False)
                ends, unit, pair_ends, pair = _unpacked(row.column("units")[0].as_py())
                sums = []
                for name in ("is_best", "count"):
                    values = np.zeros(len(links), np.int64)
                    values[place] = links.field(name).to_numpy(zero_copy_only=False)
                    sums.append(pa.array(_per_text(_per_text(values[pair], pair_ends)[unit], ends)))
                columns = [of_block["ids"], *(of_block[m] for m in _MEASURES), *sums, of_block["groups_sha256"]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *_MEASURES, "n_best", "count_sum", "groups_sha256"])

    kind = stored.schema["ids"].dataType.elementType.simpleString()
    measures = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"
    return joined.mapInArrow(run, f"id {kind}, {measures}, groups_sha256 string").withColumnRenamed("id", id)
