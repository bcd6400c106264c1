"""SentencePiece encoding over a relational lattice, and decoding.

Texts are cut where no piece can cross, between two characters that no piece has
side by side, into parts: words or less, which repeat far more often than words
do. Documents are dealt into blocks of some megabytes; each distinct part of the
corpus is encoded once, and goes to the blocks that have it:

1. explode every substring of a part up to the longest piece,
2. equi-join them to the piece table (a model file, so of bounded size),
3. group the edges by part,
4. fold them with a higher-order aggregate into the best path.

The fold depends on the model. For a unigram model it is Viterbi: the best sum
of scores up to each position. A BPE model, as the given one is, defines its
result by merges and the best sum of scores would be a different one; its fold
keeps the set of boundaries and in each step removes the one inside the best
edge that spans exactly two parts; where one look at each edge in their order
provably does the same, that is all. Both give what the library gives.

The parts' boundaries then meet the block's documents. Documents are shuffled
once, compressed, and both the search for parts and the last step read that
shuffle; parts go back to their blocks compressed as well. A block's parts are
bounded by its share of the text, and one of more than 60 characters is merged
by a helper inside the task.

Defined cases: a null or empty text has no pieces; characters outside the model
become bytes, or the unknown piece in a model without bytes; U+2581 decodes as
a blank, everything else round-trips; repeated rows each get their own row; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.once import with_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONGEST = 60  # characters of a part whose boundaries fit one long
BLOCK_CHARS = 16_000_000  # of a block of documents: the more, the fewer parts are dealt to several
TASK_CHARS = 8_000_000  # of text whose distinct parts go to one task of the lattice
SLICE_BYTES = 500_000  # of text that a task cuts at once
_HELD = 64_000_000  # bytes of parts, about, that a task holds before it passes them on
_PACKED = 50_000  # parts that a task packs at once
_AGAIN = 1 << 62  # beyond the boundaries of a part
_BLANK = "▁"


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@dataclass
class Model:
    """The piece table of a model file, on the driver."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]  # pieces that stand for their own text
    bytes_from: int | None  # id of <0x00>
    unknown: int
    merges: bool  # BPE; else unigram

    def table(self) -> list[tuple[str, int, int, float]]:
        """(piece, id, rank, score): rank orders scores, best first, equal scores alike."""
        ranks = {s: r for r, s in enumerate(sorted({s for s, n in zip(self.scores, self.normal, strict=True) if n}, reverse=True))}
        return [(p, i, ranks[s], s) for i, (p, s, n) in enumerate(zip(self.pieces, self.scores, self.normal, strict=True)) if n]

    def pairs(self) -> frozenset[str]:
        """Neighbouring characters of some piece; between any others no piece lies, so what merges on one side never depends on the other."""
        return frozenset(a + z for p, n in zip(self.pieces, self.normal, strict=True) if n for a, z in pairwise(p))


def read_model(path: str, merges: bool = True) -> Model:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in ids]
    return Model(
        [sp.id_to_piece(i) for i in ids],
        [sp.get_score(i) for i in ids],
        [not s for s in special],
        next((i for i in ids if sp.is_byte(i)), None),
        sp.unk_id(),
        merges,
    )


def _packed(docs: DataFrame) -> DataFrame:
    """(block, payload): the rows of each block in each batch as one compressed Arrow stream, which halves what is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("block").to_numpy()
            rows = batch.drop_columns(["block"])
            found = {int(b): _to_bytes(rows.take(pa.array((numbers == b).nonzero()[0]))) for b in set(numbers.tolist())}
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], names=["block", "payload"])

    return docs.mapInArrow(run, "block long, payload binary")


def _to_bytes(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _from_bytes(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


class Cutter:
    """Cuts texts where no piece can cross, all texts of a slice at once."""

    def __init__(self, pairs: frozenset[str]):
        chars = sorted({c for pair in pairs for c in pair})
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in chars]] = range(1, len(chars) + 1)
        self.near = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, z in pairs:
            self.near[self.kind[ord(a)], self.kind[ord(z)]] = True

    def parts(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        """(the parts of all texts, the number of the first part of each text and of the end)."""
        given = [_BLANK + t.replace(" ", _BLANK) if t else "" for t in texts]
        codes, data, at = _characters("".join(given))
        begins = np.cumsum([0, *map(len, given)])
        first = np.ones(len(codes), bool)
        kinds = self.kind[codes]
        first[1:] = ~self.near[kinds[:-1], kinds[1:]]
        first[begins[begins < len(codes)]] = True
        starts = np.flatnonzero(first)
        return _strings(data, at, starts), np.searchsorted(starts, begins)


def _characters(text: str) -> tuple[np.ndarray, bytes, np.ndarray]:
    """(code points, UTF-8, the byte that each character begins at, and the end)."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), out=at[1:])
    return codes, text.encode(), at


def _strings(data: bytes, at: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The stretches of ``data`` that begin at the characters ``starts``."""
    offsets = np.append(at[starts], at[-1]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))


def _slices(payload: bytes) -> Iterator[pa.RecordBatch]:
    """The rows of a payload, some million characters at a time."""
    rows = _from_bytes(payload).combine_chunks()
    ends = np.cumsum(pc.binary_length(rows.column("text")).to_numpy())
    start = 0
    while start < len(rows):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES)))
        yield rows.slice(start, end - start).to_batches()[0]
        start = end


def _parts_of_blocks(packed: DataFrame, pairs: frozenset[str], merges: bool) -> DataFrame:
    """(block, word): the parts that the lattice takes, once for each block unless they outgrow what a task may hold. Rows come by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(pairs)
        current, found, held = None, [], 0

        def rows() -> pa.RecordBatch:
            words = pa.concat_arrays(found).unique()
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), current, np.int64)), words], names=["block", "word"])

        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                if block != current:
                    if found:
                        yield rows()
                    current, held = block, 0
                for some in _slices(payload.as_py()):
                    words = cutter.parts(some.column("text").to_pylist())[0].unique()
                    length = pc.utf8_length(words)
                    found.append(words.filter(pc.and_(pc.greater_equal(length, 2 if merges else 1), pc.less_equal(length, LONGEST))))
                    held += found[-1].nbytes
                    if held > _HELD:
                        found[:] = [pa.concat_arrays(found).unique()]
                        if (held := found[0].nbytes) > _HELD // 2:
                            yield rows()  # parts that come again are equal rows
                            held = 0
        if found:
            yield rows()

    return packed.sortWithinPartitions("block").mapInArrow(run, "block long, word string")


def _packed_parts(parts: DataFrame) -> DataFrame:
    """(block, payload): (block, word, bits) as one compressed Arrow stream for each block and some ten thousand rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by([("block", "ascending"), ("word", "ascending")]).combine_chunks()
            blocks, starts = np.unique(table.column("block").to_numpy(), return_index=True)
            words = table.drop_columns(["block"])
            payloads = [_to_bytes(words.slice(a, z - a).to_batches()[0]) for a, z in pairwise([*starts.tolist(), len(words)])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(payloads, pa.binary())], names=["block", "payload"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= _PACKED:
                yield rows()
        if held:
            yield rows()

    return parts.mapInArrow(run, "block long, payload binary")


def _lattice(words: DataFrame, pieces: DataFrame, merges: bool) -> DataFrame:
    """Each of the distinct ``words`` with the edges of its lattice, best rank first, then leftmost.

    Merges start from single characters and only need longer edges, as longs
    while rows are sorted by word and as structs afterwards; Viterbi needs all,
    with their scores.
    """
    longest = pieces.agg(F.max(F.length("piece"))).scalar()
    n = F.length("word")
    shortest = 2 if merges else 1
    spans = words.select("*", F.explode(F.sequence(F.lit(0), n - shortest)).alias("start"))
    spans = spans.select("*", F.explode(F.sequence(F.lit(shortest), F.least(longest, n - F.col("start")))).alias("length"))
    spans = spans.withColumn("piece", F.substring(F.col("word"), F.col("start") + 1, F.col("length")))
    left = lambda value, by: F.shiftleft(value.cast("long"), by)
    key = left(F.col("rank"), 32).bitwiseOR(left(F.col("start"), 26)).bitwiseOR(left(F.col("start") + F.col("length"), 20))
    known = spans.join(F.broadcast(pieces), "piece").groupBy("word")
    if not merges:
        edge = F.struct("start", (F.col("start") + F.col("length")).alias("end"), "score")
        return known.agg(F.collect_list(edge).alias("edges")).select("word", n.alias("n"), "edges")
    keys = known.agg(F.array_sort(F.collect_list(key)).alias("keys"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)

    def edge(k: Column) -> Column:
        start = F.shiftright(k, 26).bitwiseAND(63).cast("int")
        end = F.shiftright(k, 20).bitwiseAND(63).cast("int")
        return F.struct(
            bit(start).bitwiseOR(bit(end)).alias("ends"), (bit(end) - bit(start + 1)).alias("inner")
        )

    return keys.select("word", n.alias("n"), F.transform("keys", edge).alias("edges"))


def _every(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(2).cast("long"), n) - 1


def _merged_in_order(edges: Column, n: Column) -> Column:
    """The same as ``_merged`` from one look at each edge, or a number with the bit _AGAIN.

    An edge that has lost an end never gets it back. So if every edge, when its
    turn comes, spans two parts or has lost an end, none is passed over that
    could be merged later. One that spans more than two parts might be.
    """

    def step(left: Column, e: Column) -> Column:
        spanned = F.bit_count(left.bitwiseAND(e["inner"]))
        merged = F.when(spanned == 1, left.bitwiseAND(F.bitwise_not(e["inner"]))).when(spanned > 1, left.bitwiseOR(F.lit(_AGAIN)))
        return F.coalesce(F.when(left.bitwiseAND(e["ends"]) == e["ends"], merged), left)

    return F.aggregate(edges, _every(n), step)


def _merged(edges: Column, n: Column) -> Column:
    """The boundaries that are left when the best edge over two parts is merged again and again, as bits."""

    def step(left: Column, _: Column) -> Column:
        spans_two = lambda e: (left.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(left.bitwiseAND(e["inner"])) == 1)
        best = F.get(F.filter(edges, spans_two), 0)["inner"]
        return F.coalesce(left.bitwiseAND(F.bitwise_not(best)), left)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), _every(n), step)


def _best_path(edges: Column, n: Column, lowest: float) -> Column:
    """Viterbi over positions: the boundaries of the best sum of scores, as bits. Characters without a piece score lowest."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("bits")))

    def step(states: Column, end: Column) -> Column:
        def extended(begin: Column, score: Column) -> Column:
            before = F.get(states, begin)
            bits = before["bits"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), end))
            return F.struct((before["score"] + score).alias("score"), bits.alias("bits"))

        arriving = F.transform(F.filter(edges, lambda e: e["end"] == end), lambda e: extended(e["start"], e["score"]))
        alone = F.when(~F.exists(edges, lambda e: (e["end"] == end) & (e["start"] == end - 1)), F.array(extended(end - 1, F.lit(lowest))))
        none = F.array().cast("array<struct<score:double,bits:bigint>>")
        return F.array_append(states, F.array_max(F.concat(arriving, F.coalesce(alone, none))))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda states: F.get(states, n)["bits"])


def _parts(word: str, bits: int) -> list[str]:
    """A word cut at its boundaries."""
    at = [i for i in range(len(word) + 1) if bits >> i & 1]
    return [word[a:z] for a, z in zip(at, at[1:])]


def merge_long(word: str, rank: dict[str, tuple[int, int]]) -> list[str]:
    """The parts of one long word by the same merges, with a heap."""
    part, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(rank[p][0], i, p) for i, p in enumerate(map("".join, zip(word, word[1:]))) if p in rank]
    heapify(heap)
    while heap:
        _, i, text = heappop(heap)
        j = after[i] if part[i] else len(word)
        if j >= len(word) or part[i] + part[j] != text:
            continue
        part[i], part[j], after[i] = text, "", after[j]
        if after[i] < len(word):
            before[after[i]] = i
        for a, z in ((before[i], i), (i, after[i])):
            if a >= 0 and z < len(word) and (p := part[a] + part[z]) in rank:
                heappush(heap, (rank[p][0], a, p))
    return [p for p in part if p]


def encode(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(id, n_pieces, ids) for every row; with ``decoded`` also the text that its ids stand for, as ``decode`` gives it."""
    spark: SparkSession = docs.sparkSession
    pieces = spark.createDataFrame(model.table(), "piece string, id int, rank int, score double")
    pairs = model.pairs()
    docs = docs.select(F.col(id).alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = chars // BLOCK_CHARS + 1
    docs = docs.withColumn("block", F.pmod(F.xxhash64("row_id", "text"), F.lit(n_blocks)))
    packed = _packed(docs).repartition(max(2 * n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block")

    words = _parts_of_blocks(packed, pairs, model.merges).repartition(chars // TASK_CHARS + 1, "word")
    # The filter keeps the block, so that this and the join below read one and the same shuffle.
    distinct = words.groupBy("word").agg(F.min("block").alias("block")).filter("block >= 0").select("word")
    edges = with_once(_lattice(distinct, pieces, model.merges), word_edges=F.col("edges"))
    lowest = min(model.scores) - 10.0
    if model.merges:
        edges = with_once(edges, in_order=_merged_in_order(F.col("word_edges"), F.col("n")))
        settled = F.col("in_order").bitwiseAND(F.lit(_AGAIN)) == 0
        bits = F.when(settled, F.col("in_order")).otherwise(_merged(F.col("word_edges"), F.col("n")))
    else:
        bits = _best_path(F.col("word_edges"), F.col("n"), lowest)
    encoded = words.join(edges.select("word", bits.alias("bits")).hint("shuffle_hash"), "word").select("block", "word", "bits")
    merges, first_byte, unknown = model.merges, model.bytes_from, model.unknown
    table = {p: (r if merges else s, i) for p, i, r, s in model.table()}

    def ids_of(parts: list[str]) -> bytes:
        ids: list[int] = []
        for part in parts:
            if part in table:
                ids.append(table[part][1])
            else:
                ids += [unknown] if first_byte is None else [b + first_byte for b in part.encode()]
        return array("i", ids).tobytes()

    def ids_of_part(part: str, bits: int | None) -> bytes:
        """A part without bits has no edges or is too long for the lattice."""
        return ids_of(_parts(part, bits) if bits is not None else merge_long(part, table) if merges else long_path(part, table, lowest))

    def ids_of_part(part: str, bits: int | None) -> bytes:
        """A part without bits has no edges or is too long for the lattice."""
        return ids_of(_parts(part, bits) if bits is not None else merge_long(part, table) if merges else long_path(part, table, lowest))

    names, numbers = pa.array(table, pa.string()), np.array([i for _, i in table.values()], np.int32)
    spelt_by = pa.array(_spelling(model), pa.large_binary()) if decoded else None
    kind = docs.schema["row_id"].dataType.simpleString()
    schema = f"row_id {kind}, n_pieces long, ids array<int>" + ", decoded string" * decoded

    class Spelling:
        """The ids of a block's parts, from their boundaries."""

        def __init__(self, words: pa.Array, bits: np.ndarray):
            self.words, self.apart, some = words, {}, []
            for start in range(0, len(words), 50_000):
                some.append(self._ids_of_words(words[start : start + 50_000], bits[start : start + 50_000]))
            self.ids, self.sizes = (np.concatenate([np.zeros(0, np.int32), *found]) for found in (zip(*some) if some else ((), ())))
            self.begins = np.cumsum(self.sizes, dtype=np.int64) - self.sizes

        def _ids_of_words(self, words: pa.Array, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(the ids of all words, how many each has); words with a token that is no piece are set apart."""
            _, data, at = _characters("".join(words.to_pylist()))
            sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
            begins = np.cumsum(sizes) - sizes
            inside = np.arange(len(at) - 1) - np.repeat(begins, sizes)
            starts = np.flatnonzero(np.repeat(bits, sizes) >> inside & 1)
            found = pc.index_in(_strings(data, at, starts), value_set=names)
            unknown = np.unique(np.searchsorted(begins, starts[found.is_null().to_numpy(zero_copy_only=False)], "right") - 1)
            self.apart |= {w: ids_of_part(w, int(b)) for w, b in zip(words.take(pa.array(unknown)).to_pylist(), bits[unknown], strict=True)}
            return numbers[found.fill_null(0).to_numpy()], np.diff(np.searchsorted(starts, begins), append=len(starts)).astype(np.int32)

        def ids_of(self, parts: pa.Array, ends: np.ndarray) -> pa.ListArray:
            """The ids of every text; ``ends`` are the numbers of its first part and of the end."""
            coded = parts.dictionary_encode()
            place = pc.index_in(coded.dictionary, value_set=self.words).fill_null(-1).to_numpy()
            begins, sizes = (np.where(place < 0, 0, x[place] if len(x) else 0).astype(np.int64) for x in (self.begins, self.sizes))
            others = place < 0
            if self.apart:
                others |= pc.is_in(coded.dictionary, value_set=pa.array(self.apart, pa.string())).to_numpy(zero_copy_only=False)
            more, end = [], len(self.ids)
            for at in np.flatnonzero(others).tolist():
                part = coded.dictionary[at].as_py()
                found = self.apart.get(part)
                if found is None:
                    found = ids_of_part(part, None)
                    if len(part) <= LONGEST:
                        self.apart[part] = found
                more.append(found)
                begins[at], sizes[at] = end, len(found) // 4
                end += len(found) // 4
            values = np.concatenate([self.ids, np.frombuffer(b"".join(more), np.int32)])
            codes = coded.indices.to_numpy()
            counts = sizes[codes]
            total = np.append(0, np.cumsum(counts))
            wanted = np.arange(total[-1]) + np.repeat(begins[codes] - total[:-1], counts)
            return pa.ListArray.from_arrays(pa.array(total[ends], pa.int32()), pa.array(values[wanted], pa.int32()))

    def run(documents: pa.Table, parts: pa.Table) -> pa.Table:
        """The rows of a block from its compressed documents and parts."""
        cutter, tables = Cutter(pairs), [_from_bytes(x.as_py()) for x in parts.column("payload")]
        given = pa.concat_tables(tables).combine_chunks() if tables else pa.table({"word": pa.array([], pa.string()), "bits": pa.array([], pa.int64())})
        spelling = Spelling(pa.concat_arrays(given.column("word").chunks) if len(given) else pa.array([], pa.string()), given.column("bits").to_numpy())
        del tables, given
        made = []
        for payload in documents.column("payload"):
            for rows in _slices(payload.as_py()):
                ids = spelling.ids_of(*cutter.parts(rows.column("text").to_pylist()))
                columns = [rows.column("row_id"), pc.list_value_length(ids).cast(pa.int64()), ids]
                if decoded:
                    columns.append(_texts_of(ids, spelt_by))
                made.append(pa.RecordBatch.from_arrays(columns, names=["row_id", "n_pieces", "ids", "decoded"][: len(columns)]))
        return pa.Table.from_batches(made)

    found = packed.groupBy("block").cogroup(_packed_parts(encoded).groupBy("block")).applyInArrow(run, schema)
    return found.withColumnRenamed("row_id", id)


def long_path(word: str, pieces: dict[str, tuple[float, int]], unknown_score: float) -> list[str]:
    """Viterbi for one long word of a unigram model."""
    longest = max(map(len, pieces), default=1)
    best: list[tuple[float, int]] = [(0.0, -1)]
    for end in range(1, len(word) + 1):
        options = [
            (best[a][0] + (pieces[p][0] if (p := word[a:end]) in pieces else unknown_score), a)
            for a in range(max(0, end - longest), end)
            if end - a == 1 or word[a:end] in pieces
        ]
        best.append(max(options))
    parts, end = [], len(word)
    while end:
        start = best[end][1]
        parts.append(word[start:end])
        end = start
    return parts[::-1]


def _spelling(model: Model) -> list[bytes]:
    """What each id stands for."""
    return [
        p.replace(_BLANK, " ").encode() if normal
        else bytes([i - model.bytes_from]) if model.bytes_from is not None and 0 <= i - model.bytes_from < 256
        else b""
        for i, (p, normal) in enumerate(zip(model.pieces, model.normal, strict=True))
    ]


def _texts_of(ids: pa.ListArray, spelt: pa.Array) -> pa.Array:
    """``spelt``: what each id stands for, as large binary."""
    joined = spelt.take(ids.values)
    _, offsets, data = joined.buffers()
    at = np.frombuffer(offsets, np.int64)[joined.offset :][ids.offsets.to_numpy()].tolist()
    view = memoryview(data) if data else b""
    return pa.array([bytes(view[a:z]).decode(errors="replace").removeprefix(" ") for a, z in pairwise(at)], pa.string())


def decode(encoded: DataFrame, model: Model, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids added; bytes that are no UTF-8 become U+FFFD."""
    spelt = pa.array(_spelling(model), pa.large_binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _texts_of(batch.column(ids), spelt)], names=[*batch.schema.names, text])

    return encoded.mapInArrow(run, encoded.withColumn(text, F.lit("")).schema)
