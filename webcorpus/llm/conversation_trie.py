"""A prefix trie over conversations, by adaptive radix trees over turn ids.

A turn's id is sixteen bytes of a digest of its role and text, and a
conversation's key is the ids of its turns, big end first, one after the other.
Tasks put keys into radix trees whose nodes grow from 4 over 16 and 48 to 256
children and whose runs of single children are one edge. A node of the trie is
a byte depth that is a whole number of turns; only those leave the task, with
what their members add up to. Nodes of different tasks meet by an identity: the
exclusive or of a 128-bit hash of each turn's id and place, which is known for
any stretch of a long conversation without the turns before it in the task.

Nothing is held whole for one conversation or one node:

1. Turns are dealt by ranges of (conversation, turn, id), which splits a long
   conversation over tasks, and packed into stretches of ``STRETCH`` turns. How
   many turns came before a task is summed over the tasks' own borders.
2. A first round of radix trees counts each node's members and finds the
   smallest, its owner. What a conversation owns is the end of its path.
3. All sums over a subtree are then sums over its members: a leaf counts once,
   for its owner, and a member that isn't a node's owner saves the bytes from
   that node down to where its own part begins. A second round of radix trees
   adds these up over the shared parts of the paths.
4. Members that end at a node are listed in chunks of neighbouring ids and
   digested as a stream.

``digest`` first rebuilds each conversation c: the first h turns of conversation
c - c % 5, then its own after its first h, with h = crc32(c) % 9.

Defined cases: rows without conv_id are left out; a null turn comes first; turns
of one number go by their id, repeated rows are turns each; null role or text is
empty; a conversation that is left without turns is a member of the root alone;
an empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import bytehash
from ..session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRETCH = 1024  # turns in a row of a long conversation
HEAD = 8  # turns that a conversation may take from another
_ID = 16  # bytes of a turn's id
_AT_ONCE = 16 << 20  # bytes of keys in one radix tree
_MEMBERS = 4096  # ids in a chunk of those that end at a node
_NODE = ["hi", "lo"]


# --- conversations as stretches of turns -----------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, id, size: one narrow row per turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(content, 256), 1, 2 * _ID)).alias("id"),
        F.octet_length(text).cast("long").alias("size"),
    )


def stretches(rows: DataFrame) -> DataFrame:
    """conv, pos, ids, sizes, last: runs of turns from place ``pos`` of a conversation on."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        conv, start, ids, sizes = None, 0, bytearray(), []

        def rows_of(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64())]
            columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["part", "conv", "start", "last", "ids", "sizes"])

        for batch in batches:
            found = []
            if not batch.num_rows:
                continue
            convs = batch.column("conv").to_numpy()
            all_ids, all_sizes = b"".join(batch.column("id").to_pylist()), batch.column("size").to_pylist()
            borders = [0, *(np.flatnonzero(convs[1:] != convs[:-1]) + 1).tolist(), len(convs)]
            for a, z in zip(borders, borders[1:]):
                if convs[a] != conv:
                    if conv is not None:
                        found.append((part, conv, start, True, bytes(ids), sizes))
                    conv, start, ids, sizes = int(convs[a]), 0, bytearray(), []
                for x in range(a, z, STRETCH):
                    ids += all_ids[x * _ID : min(x + STRETCH, z) * _ID]
                    sizes += all_sizes[x : min(x + STRETCH, z)]
                    while len(sizes) > STRETCH:
                        found.append((part, conv, start, False, bytes(ids[: STRETCH * _ID]), sizes[:STRETCH]))
                        start, ids, sizes = start + STRETCH, ids[STRETCH * _ID :], sizes[STRETCH:]
            if found:
                yield rows_of(found)
        if conv is not None:
            yield rows_of([(part, conv, start, True, bytes(ids), sizes)])

    order = ["conv", "turn", "id"]  # a null turn comes first
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    packed = materialize(placed.mapInArrow(pack, "part int, conv long, start long, last boolean, ids binary, sizes array<long>"), "trie-stretches")
    borders = _borders(packed)
    if borders:
        before = rows.sparkSession.createDataFrame(borders, "part int, conv long, before long, ends boolean")
        packed = packed.join(F.broadcast(before), ["part", "conv"], "left")  # two rows per task at most
    else:
        packed = packed.withColumns({"before": F.lit(0), "ends": F.lit(True)})
    pos = F.col("start") + F.coalesce("before", F.lit(0))
    return packed.select("conv", pos.alias("pos"), "ids", "sizes", (F.col("last") & F.coalesce("ends", F.lit(True))).alias("last"))


def _borders(packed: DataFrame) -> list[tuple]:
    """(part, conversation, turns before this part, whether it ends here) where a conversation is in several parts.

    Parts are ranges, so it is the last of one and the first of the next:
    there are fewer than parts.
    """
    ranges = sorted(packed.groupBy("part").agg(F.min("conv"), F.max("conv")).collect())
    crossing = sorted({a[2] for a, b in zip(ranges, ranges[1:]) if a[2] == b[1]})
    if not crossing:
        return []
    wanted = F.broadcast(packed.sparkSession.createDataFrame([(c,) for c in crossing], "conv long"))
    sizes = packed.join(wanted, "conv").groupBy("conv", "part").agg(F.sum(F.size("sizes"))).collect()
    found, total = [], {}
    for conv, part, n in sorted(sizes):
        found.append([part, conv, total.get(conv, 0), True])
        if conv in total:
            found[-2][3] = False
        total[conv] = total.get(conv, 0) + n
    return [tuple(x) for x in found]


# --- turns to hashes of prefixes -------------------------------------------------------------------------------------


def _lanes(ids: bytes | np.ndarray, places: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each turn's id and place."""
    lanes = np.frombuffer(ids, ">u8").astype(np.uint64).reshape(-1, 2)
    at = bytehash.mix(places.astype(np.uint64) + np.uint64(1))
    return np.stack([bytehash.mix(lanes[:, 0] ^ at), bytehash.mix(lanes[:, 1] + at)], axis=1)


def _crc(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary"))


def rebuilt(own: DataFrame) -> DataFrame:
    """The stretches of rebuilt conversations: conv, depth (turns before), ids, sizes, last, and their hash and bytes."""
    heads = own.filter((F.col("conv") % 5 == 0) & (F.col("pos") < HEAD)).groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.substring("ids", 1, HEAD * _ID).alias("ids"), F.slice("sizes", 1, HEAD).alias("sizes")))).alias("head")
    )  # eight stretches at most
    asked = own.withColumns({"base": F.col("conv") - F.col("conv") % 5, "h": (_crc(F.col("conv")) % 9).cast("int")})
    return asked.join(heads, "base", "left").select("conv", "pos", "ids", "sizes", "last", "h", "head").mapInArrow(_with_heads, _PIECE)


def as_they_are(own: DataFrame) -> DataFrame:
    """The same of conversations as given."""
    nothing = F.lit(None).cast("array<struct<pos:bigint,ids:binary,sizes:array<bigint>>>")
    return own.select("conv", "pos", "ids", "sizes", "last", F.lit(0).alias("h"), nothing.alias("head")).mapInArrow(_with_heads, _PIECE)


_PIECE = "conv long, depth long, ids binary, sizes array<long>, last boolean, x_hi long, x_lo long, bytes long"


def _with_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c) for c in ("conv", "pos", "ids", "sizes", "last", "h", "head")]
        found = []
        for conv, pos, ids, sizes, last, h, head in zip(*(c.to_pylist() for c in columns), strict=True):
            head = head or []
            head_ids = b"".join(p["ids"] for p in head)[: h * _ID]
            head_sizes = [s for p in head for s in p["sizes"]][:h]
            cut = max(h - pos, 0)
            ids, sizes, depth = ids[cut * _ID :], sizes[cut:], pos + cut - h + len(head_sizes)
            if pos == 0:
                ids, sizes, depth = head_ids + ids, head_sizes + sizes, 0
            if not sizes and not last:
                continue
            found.append((conv, depth, ids, sizes, last))
        if not found:
            continue
        conv, depth, ids, sizes, last = zip(*found, strict=True)
        n = np.array([len(s) for s in sizes], np.int64)
        ends = np.cumsum(n)
        places = np.arange(n.sum()) - np.repeat(ends - n, n) + np.repeat(np.array(depth, np.int64), n)
        ways = np.zeros((n.sum() + 1, 2), np.uint64)
        ways[1:] = np.bitwise_xor.accumulate(_lanes(b"".join(ids), places), axis=0)
        whole = (ways[ends] ^ ways[ends - n]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(ids, pa.binary()), pa.array(sizes, pa.list_(pa.int64())),
                pa.array(last, pa.bool_()), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array([sum(s) for s in sizes], pa.int64()),
            ],
            names=["conv", "depth", "ids", "sizes", "last", "x_hi", "x_lo", "bytes"],
        )


def with_prefixes(pieces: DataFrame) -> DataFrame:
    """``pieces``, written, with the hash and the bytes of the turns before each: hi, lo, before."""
    whole = (F.col("depth") == 0) & F.col("last")
    zero = F.lit(0).cast("long")
    alone = pieces.filter(whole).withColumns({"hi": zero, "lo": zero, "before": zero})
    earlier = Window.partitionBy("conv").orderBy("depth", "last").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(f(c).over(earlier), zero).alias(n) for f, c, n in ((F.bit_xor, "x_hi", "hi"), (F.bit_xor, "x_lo", "lo"), (F.sum, "bytes", "before"))]
    long = pieces.filter(~whole)
    narrow = materialize(long.select("conv", "depth", "last", *sums), "trie-prefixes")  # one row per STRETCH turns
    return alone.unionByName(long.join(narrow, ["conv", "depth", "last"]))


# --- radix trees -----------------------------------------------------------------------------------------------------


class Children:
    """Children by byte, in a layout that grows: two arrays of 4 or 16, an index of 256 into 48, an array of 256."""

    __slots__ = ("keys", "nodes", "room")

    def __init__(self) -> None:
        self.room, self.keys, self.nodes = 4, bytearray(), []

    def get(self, byte: int) -> RadixNode | None:
        if self.room <= 16:
            at = self.keys.find(byte)
            return self.nodes[at] if at >= 0 else None
        if self.room == 48:
            at = self.keys[byte]
            return self.nodes[at] if at < 48 else None
        return self.nodes[byte]

    def put(self, byte: int, node: RadixNode) -> None:
        """Add or replace."""
        if self.room <= 16:
            at = self.keys.find(byte)
            if at >= 0:
                self.nodes[at] = node
                return
            if len(self.nodes) == self.room:
                self._grow()
                self.put(byte, node)
                return
            self.keys.append(byte)
            self.nodes.append(node)
        elif self.room == 48:
            at = self.keys[byte]
            if at < 48:
                self.nodes[at] = node
            elif len(self.nodes) == 48:
                self._grow()
                self.put(byte, node)
            else:
                self.keys[byte] = len(self.nodes)
                self.nodes.append(node)
        else:
            self.nodes[byte] = node

    def _grow(self) -> None:
        if self.room == 4:
            self.room = 16
        elif self.room == 16:
            index = bytearray([255]) * 256
            for at, byte in enumerate(self.keys):
                index[byte] = at
            self.room, self.keys = 48, index
        else:
            nodes: list[RadixNode | None] = [None] * 256
            for byte, at in enumerate(self.keys):
                if at < 48:
                    nodes[byte] = self.nodes[at]
            self.room, self.keys, self.nodes = 256, bytearray(), nodes

    def __iter__(self) -> Iterator[RadixNode]:
        return (n for n in self.nodes if n is not None)


class RadixNode:
    """The end of an edge: ``end`` bytes of key number ``key`` lead here. ``sums``: of the keys that end here, later of all below."""

    __slots__ = ("key", "end", "children", "sums")

    def __init__(self, key: int, end: int, sums: tuple | None = None):
        self.key, self.end, self.sums, self.children = key, end, sums, None


def _common(a: bytes, b: bytes, start: int, end: int) -> int:
    """Where two keys first differ between start and end, at most the shorter one's length."""
    end = min(end, len(a), len(b))
    x, y = a[start:end], b[start:end]
    if x == y:
        return end
    return start + len(x) - (((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) >> 3)


class RadixTree:
    """Keys of any length with values (count, smallest, first sum, second sum) that add up."""

    def __init__(self) -> None:
        self.keys: list[bytes] = [b""]
        self.root = RadixNode(0, 0)

    def insert(self, key: bytes, value: tuple) -> int:
        """The key's number."""
        number = len(self.keys)
        self.keys.append(key)
        node, above, size = self.root, None, len(key)
        depth = 0
        while True:
            if node.end > depth:
                at = _common(self.keys[node.key], key, depth, node.end)
                if at < node.end:  # the edge splits
                    fork = RadixNode(node.key, at)
                    fork.children = Children()
                    fork.children.put(self.keys[node.key][at], node)
                    above.children.put(self.keys[node.key][depth], fork)
                    node = fork
            depth = node.end
            if size == depth:
                node.sums = _added(node.sums, value)
                return number
            if node.children is None:
                node.children = Children()
            below = node.children.get(key[depth])
            if below is None:
                node.children.put(key[depth], RadixNode(number, size, value))
                return number
            above, node = node, below

    def edges(self) -> Iterator[tuple[int, int, int, tuple]]:
        """(key number, bytes above, bytes at its end, sums of all keys through it), from the bottom up."""
        stack: list[tuple[RadixNode, int, bool]] = [(self.root, 0, False)]
        while stack:
            node, start, seen = stack.pop()
            if node.children is not None and not seen:
                stack.append((node, start, True))
                stack.extend((child, node.end, False) for child in node.children)
                continue
            for child in node.children or ():
                node.sums = _added(node.sums, child.sums)
            if node.sums is not None:
                yield node.key, start, node.end, node.sums


def _added(a: tuple | None, b: tuple) -> tuple:
    return b if a is None else (a[0] + b[0], a[1] if a[1] < b[1] else b[1], a[2] + b[2], a[3] + b[3])


def tree_nodes(pieces: DataFrame, shared_only: bool) -> DataFrame:
    """What each task's radix trees know of each trie node.

    ``pieces``: conv, depth, ids, sizes, hi, lo, before. Each key starts with the
    hash of the turns before it, so that stretches from one place of the trie
    meet. With ``shared_only``, keys end before the depth ``own`` and add up
    ``leaf`` and ``shared``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            names = ["conv", "depth", "ids", "sizes", "hi", "lo", "before"] + (["own", "leaf", "shared"] if shared_only else [])
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if shared_only:
                    n = min(len(row[3]), row[7] - 1 - row[1])
                    if n < 0 or not n and row[1]:
                        continue
                    row = (*row[:2], row[2][: n * _ID], row[3][:n], *row[4:])
                held.append(row)
                size += len(row[2]) + 100
                if size > _AT_ONCE:
                    yield _grown(held)
                    held, size = [], 0
        if held:
            yield _grown(held)

    return pieces.mapInArrow(run, "hi long, lo long, up_hi long, up_lo long, depth long, size long, path_bytes long, n long, conv long, leaves long, shared long")


def _grown(held: list[tuple]) -> pa.RecordBatch:
    """The nodes of one radix tree over the held pieces."""
    tree = RadixTree()
    for row in held:
        weights = row[8:] if len(row) > 7 else (0, 0)
        tree.insert(row[4].to_bytes(8, signed=True) + row[5].to_bytes(8, signed=True) + row[2], (1, row[0], *weights))
    edges = [e for e in tree.edges() if e[2] >= _ID]
    piece = np.array([e[0] for e in edges], np.int64) - 1
    # Turns whose ends lie on the edge; 0 is the place before the piece, a node of its own only at the root.
    low = np.array([e[1] for e in edges], np.int64) // _ID
    high = np.array([e[2] for e in edges], np.int64) // _ID - 1
    depth0 = np.array([row[1] for row in held], np.int64)
    low += (low == 0) & (depth0[piece] > 0)
    n = np.maximum(high - low + 1, 0)
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    piece = np.repeat(piece, n)

    sizes = [len(row[3]) for row in held]
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    total = int(ends[-1])
    places = np.arange(total) - np.repeat(firsts - depth0, sizes)
    ways = np.zeros((total + 1, 2), np.uint64)
    ways[1:] = np.bitwise_xor.accumulate(_lanes(b"".join(row[2] for row in held), places), axis=0)
    text = np.zeros(total + 1, np.int64)
    text[1:] = [s for row in held for s in row[3]]
    paths = np.cumsum(text)
    before = np.array([[row[4], row[5]] for row in held], np.int64).view(np.uint64)
    base_bytes = np.array([row[6] for row in held], np.int64)

    def way(turn: np.ndarray) -> np.ndarray:
        return (ways[firsts[piece] + turn] ^ ways[firsts[piece]] ^ before[piece]).view(np.int64)

    here, above = way(turn), way(np.maximum(turn - 1, 0))
    depth = depth0[piece] + turn
    root = depth == 0
    sums = np.array([e[3] for e in edges], np.int64).reshape(-1, 4)[np.repeat(np.arange(len(edges)), n)]
    columns = [
        pa.array(here[:, 0]), pa.array(here[:, 1]), pa.array(above[:, 0], mask=root), pa.array(above[:, 1], mask=root), pa.array(depth),
        pa.array(np.where(root, 0, text[firsts[piece] + turn])), pa.array(paths[firsts[piece] + turn] - paths[firsts[piece]] + base_bytes[piece]),
        *(pa.array(sums[:, k]) for k in range(4)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "up_hi", "up_lo", "depth", "size", "path_bytes", "n", "conv", "leaves", "shared"])


# --- the trie --------------------------------------------------------------------------------------------------------


def end_digests(ends: DataFrame) -> DataFrame:
    """hi, lo, ends_sha256 of the rows (hi, lo, conv): the ids in order, streamed chunk by chunk."""
    chunk = F.floor(F.col("conv") / _MEMBERS).alias("chunk")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy(*_NODE, chunk).agg(listed.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            found = []
            for hi, lo, ids in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ids")), strict=True):
                if (hi, lo) == node:
                    state.update(b",")
                else:
                    if node:
                        found.append((*node, state.hexdigest()))
                    node, state = (hi, lo), hashlib.sha256()
                state.update(ids.encode())
            if found:
                yield pa.RecordBatch.from_pylist([dict(zip(("hi", "lo", "ends_sha256"), f)) for f in found])
        if node:
            yield pa.RecordBatch.from_pylist([{"hi": node[0], "lo": node[1], "ends_sha256": state.hexdigest()}])

    ordered = chunks.repartition(*_NODE).sortWithinPartitions(*_NODE, "chunk")
    return ordered.mapInArrow(run, "hi long, lo long, ends_sha256 string")


def trie(pieces: DataFrame) -> DataFrame:
    """The nodes of the trie over written ``pieces`` of conversations."""
    placed = with_prefixes(pieces)
    counted = materialize(
        tree_nodes(placed, shared_only=False).groupBy(*_NODE).agg(
            *(F.min(c).alias(c) for c in ("up_hi", "up_lo", "depth", "size", "path_bytes", "conv")), F.sum("n").alias("n_convs")
        ),
        "trie-counted",
    )
    children = counted.filter("depth > 0").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(counted.join(children, _NODE, "left").fillna(0, ["n_children"]), "trie-nodes")

    # What a conversation owns begins at depth own, below a node of another.
    owners = nodes.groupBy("conv").agg(
        F.min("depth").alias("own"),
        F.max((F.col("n_children") == 0).cast("long")).alias("leaf"),
        F.min_by(F.struct("up_hi", "up_lo", (F.col("path_bytes") - F.col("size")).alias("shared")), "depth").alias("up"),
    ).select("conv", "own", "leaf", F.col("up.up_hi").alias("hi"), F.col("up.up_lo").alias("lo"), F.col("up.shared").alias("shared"))
    owners = materialize(owners, "trie-owners")
    ends = placed.filter("last").select(
        "conv", F.col("hi").bitwiseXOR(F.col("x_hi")).alias("hi"), F.col("lo").bitwiseXOR(F.col("x_lo")).alias("lo"),
        (F.col("depth") + F.size("sizes")).alias("n_turns"), (F.col("before") + F.col("bytes")).alias("path_bytes"),
    )
    parts = ends.join(owners.select("conv", "own", "leaf", "shared"), "conv", "left").select(
        "conv", F.coalesce("own", F.col("n_turns") + 1).alias("own"), F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("shared", "path_bytes").alias("shared")
    )
    below = tree_nodes(placed.join(parts, "conv"), shared_only=True).groupBy(*_NODE).agg(F.sum("leaves").alias("leaves"), F.sum("shared").alias("shared"))

    root = nodes.filter("depth = 0").select("conv").scalar()  # one row, or none in an empty trie
    first = owners.filter("own <= 1").select("conv", "own", "leaf", F.when(F.col("own") == 1, root).alias("parent"))
    later = owners.filter("own > 1").join(nodes.select(*_NODE, F.col("conv").alias("parent")), _NODE).select("conv", "own", "leaf", "parent")
    joined = (
        nodes.join(below, _NODE, "left").join(end_digests(ends.select("conv", *_NODE)), _NODE, "left").join(first.unionByName(later), "conv")
    )
    return joined.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("own"), F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        (F.coalesce("leaves", F.lit(0)) + F.col("leaf")).alias("n_leaves"),
        (F.coalesce(F.col("shared"), F.lit(0)) - (F.col("n_convs") - 1) * (F.col("path_bytes") - F.col("size"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def digest(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node.

    With ``rebuild`` of rebuilt conversations, else of those given.
    """
    own = stretches(turns(conversations))
    return trie(materialize((rebuilt if rebuild else as_they_are)(own), "trie-pieces"))
