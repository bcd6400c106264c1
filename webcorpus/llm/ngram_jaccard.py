"""Documents whose sets of word n-grams have a Jaccard similarity of 0.75 or more.

A size-aware join. With ``c(a, b)`` the least overlap of two linked sets of
sizes a and b:

* **Light sets** (few shingles) enumerate their subsets of size ``c``. Two sets
  with a common subset are linked by that alone, so a bucket of any size gives
  one link per member, to its smallest member, and nothing is compared.
* **Heavy sets** meet in inverted lists. Only the first shingles of a set in a
  global order are listed: among them linked sets share at least ``k``. The
  order puts shingles that recur after those that don't, and shingles of long
  lists last, so that most lists have one member and are dropped, and lines
  which a large part of the corpus shares are hardly ever listed. Within these
  classes it is the order of the hashes.

The boundary is the largest size whose subsets cost less than its lists.

A list is scanned from both ends. First each member meets only the list's
leader, a number of comparisons in proportion to the list; what they link are
components, and what they may link are clusters, which then take in the sets
that share enough of their lists. Within a cluster, tiles of different
components are compared as matrices; across clusters, sets that share as many
listed shingles as linked sets must. The components are those of all
pairs, though a group of copies emits no more rows than it has members and
tiles. Equal sets are one set throughout.

Shingles are known by 64-bit hashes. Filters of fixed size (``bitmaps``) keep
shingles that occur once from being listed. For the order all shingles of all
sets are counted, three bytes for each in the shuffle.

Defined cases: a null or blank text has no shingles and no links; a text of
fewer than n words has its whole sequence as its only shingle; rows with the
same id are one node, each with its own number of shingles; a null id is
linked with nothing and its component is null; an empty table gives an empty
result. Ids are integers. Columns of the input other than id and text are not
read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, settled
from . import bytehash
from .bitmaps import BITS, Filter, key_filter, mixed_id
from .components import components, merged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE = 5
PERCENT = 75
LONG_LIST = 24  # shingles of more sets come later in the order than others that recur,
LONGER = 4  # and those of so many times more sets later again, and so on
SCAN_COST = 16  # comparisons and rows that a listed shingle costs, for the boundary
STAR_ROUNDS = 2
GATHER_ROUNDS = 2
_LOW_BITS = 20  # of the 32 that tell shingles apart when they are counted; the others are the bucket
_COUNTED = 2_000_000  # shingles that a task counts before it passes them on
_FEW_BITS = 22  # of a filter of shingles in a hundred sets or more
TILE = 128  # sets compared at once with as many others


def least_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """The smallest overlap with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def partner_sizes(n: int, percent: int = PERCENT) -> range:
    return range(max(1, -(-percent * n // 100)), 100 * n // percent + 1)


def shared_at_least(n):
    """k: linked sets share as many listed shingles as the smaller k of the two."""
    return np.clip(n // 16, 1, 4)


def listed(n, percent: int = PERCENT):
    """How many shingles of a set of size n are listed."""
    return n - (percent * n + 99) // 100 + shared_at_least(n)


def boundary(percent: int = PERCENT) -> int:
    """The largest size for which enumerating subsets costs less than scanning lists."""
    n = 1
    while sum(comb(n + 1, least_overlap(n + 1, b, percent)) for b in partner_sizes(n + 1, percent) if least_overlap(n + 1, b, percent) <= n + 1) <= SCAN_COST * int(listed(n + 1, percent)):
        n += 1
    return n


def shingle_sets(texts: bytehash.Texts, size: int, wanted: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each wanted text."""
    texts = texts.lower_ascii()
    start, end, first = texts.words()
    words = bytehash.Prefix(texts.data).hash(start, end)
    windows = bytehash.window_hashes(words, size)
    found = []
    for i in np.flatnonzero(wanted):
        a, z = first[i], first[i + 1]
        if z - a >= size:
            found.append(np.unique(windows[a : z - size + 1]))
        else:
            found.append(bytehash.window_hashes(words[a:z], int(z - a)) if z > a else np.zeros(0, np.uint64))
    return found


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _lists_of(column: pa.Array) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [values[a:z] for a, z in zip(offsets[:-1], offsets[1:], strict=True)]


def _sets(docs: DataFrame, size: int, percent: int, shape: str, ids: Filter | None = None, order: list[Filter] | None = None) -> DataFrame:
    """(id, n, k1, k2, tokens) of each row: its set's size, fingerprint and, by ``shape``, listed shingles, all or none.

    Of light sets all are listed. With ``ids`` only rows whose id it holds; shingles come the later in the order, the more
    of the filters in ``order`` hold them.
    """

    limit = boundary(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id = batch.column(0)
            numbers = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
            for a, z, texts in bytehash.texts_of(batch.column(1)):
                wanted = np.ones(z - a, bool) if ids is None else ids.holds(mixed_id(numbers[a:z]))
                if not wanted.any():
                    continue
                sets = shingle_sets(texts, size, wanted)
                k1 = np.array([bytehash.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                k2 = np.array([bytehash.mix(~s).sum(dtype=np.uint64) for s in sets], np.uint64)
                n = np.array([len(s) for s in sets], np.int64)
                if shape == "none":
                    sets = [s[:0] for s in sets]
                if shape == "listed":
                    if order:
                        sets = [_ordered(s, order) for s in sets]
                    sets = [s[: listed(len(s), percent)] if len(s) > limit else s for s in sets]
                rows = pa.array(np.flatnonzero(wanted) + a)
                yield pa.RecordBatch.from_arrays(
                    [doc_id.take(rows), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), _list_array(sets)],
                    names=["id", "n", "k1", "k2", "tokens"],
                )

    return docs.select("id", "text").mapInArrow(run, "id long, n long, k1 long, k2 long, tokens array<long>")


def _id_filter(rows: DataFrame) -> Filter:
    return key_filter(rows.select(F.col("id").bitwiseXOR(F.shiftrightunsigned("id", BITS)).alias("key")), "key")


def _packed_counts(tokens: np.ndarray) -> pa.RecordBatch:
    """(bucket, low, more): the low 32 bits of shingles, three bytes each; those that come again have their further times in ``more``."""
    at, n = np.unique(tokens.astype(np.uint32), return_counts=True)
    low = at & np.uint32((1 << _LOW_BITS) - 1)
    three = np.ascontiguousarray(low.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
    more = np.stack([low, n - 1], axis=1).astype(np.uint32)
    cuts = np.searchsorted(at >> np.uint32(_LOW_BITS), np.arange((1 << 32 - _LOW_BITS) + 1))
    buckets = np.flatnonzero(np.diff(cuts))
    spans = [slice(cuts[i], cuts[i + 1]) for i in buckets]
    columns = [[three[x].tobytes() for x in spans], [(m := more[x])[m[:, 1] > 0].tobytes() for x in spans]]
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "low", "more"])


def _recurring(packed: DataFrame) -> DataFrame:
    """(at, c): low 32 bits that several shingles have and how many; all shingles are counted, a bucket of values at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, np.zeros(1 << _LOW_BITS, np.int64)

        def found() -> pa.RecordBatch:
            at = np.flatnonzero(counts > 1)
            return pa.RecordBatch.from_arrays([pa.array(at + (int(current) << _LOW_BITS)), pa.array(counts[at])], names=["at", "c"])

        for batch in batches:
            for bucket, low, more in zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "more")), strict=True):
                if bucket != current:
                    if current is not None:
                        yield found()
                    current = bucket
                    counts[:] = 0
                three = np.frombuffer(low, np.uint8).reshape(-1, 3).astype(np.uint32)
                counts[three[:, 0] | three[:, 1] << np.uint32(8) | three[:, 2] << np.uint32(16)] += 1
                at, n = np.frombuffer(more, np.uint32).reshape(-1, 2).T
                counts[at] += n
        if current is not None:
            yield found()

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "at long, c long")


_PACKED = "bucket int, low binary, more binary"


def _shingle_counts(docs: DataFrame, size: int, ids: Filter) -> DataFrame:
    """In how many of the sets whose id the filter holds each shingle is, by its low 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            numbers = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for a, z, texts in bytehash.texts_of(batch.column(1)):
                held += shingle_sets(texts, size, ids.holds(mixed_id(numbers[a:z])))
                n = sum(map(len, held))
                if n > _COUNTED:
                    yield _packed_counts(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield _packed_counts(np.concatenate(held))

    return _recurring(docs.select("id", "text").mapInArrow(run, _PACKED))


def _listed_counts(sets: DataFrame) -> DataFrame:
    """In how many of the sets each shingle is listed, by its low 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _packed_counts(batch.column("tokens").flatten().to_numpy(zero_copy_only=False).view(np.uint64))

    return _recurring(sets.select("tokens").mapInArrow(run, _PACKED))


def _order(counts: DataFrame) -> list[Filter]:
    """Filters of the shingles that recur, and of those in ever more sets, each within the one before.

    Listing the others first leaves few lists, and has a group of copies listed
    by its own shingles before those that other groups have too.
    """
    frequent = materialize(counts, "jaccard-frequent")
    most = frequent.agg(F.max("c")).first()[0] or 0
    order, least = [key_filter(frequent, "at")], LONG_LIST
    while least < most:
        order.append(key_filter(frequent.filter(F.col("c") > least), "at", BITS if least == LONG_LIST else _FEW_BITS))
        least *= LONGER
    return order


def _ordered(tokens: np.ndarray, order: list[Filter]) -> np.ndarray:
    """Sorted shingles by how many of the nested filters hold them."""
    level, inside = np.zeros(len(tokens), np.int8), np.arange(len(tokens))
    for f in order:
        inside = inside[f.holds(tokens[inside])]
        if not len(inside):
            break
        level[inside] += 1
    return tokens[np.argsort(level, kind="stable")]


def _to_list(sets: DataFrame, percent: int, limit: int) -> DataFrame:
    """Sets that may have heavy partners; light ones among them, which come whole, cut to their listed shingles."""
    n = F.col("n")
    cut = n - F.ceil(n * percent / 100) + _k("n")
    return sets.filter(100 * n >= percent * (limit + 1)).withColumn(
        "tokens", F.when(n <= limit, F.slice("tokens", 1, cut.cast("int"))).otherwise(F.col("tokens"))
    )


def _members(sets: DataFrame, recurring: Filter) -> DataFrame:
    """(h, id, n) for every listed shingle that may occur in two sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            values = tokens.values.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(batch)), np.diff(tokens.offsets.to_numpy()))
            values = values[tokens.offsets.to_numpy()[0] :][: len(row)]
            keep = recurring.holds(values)
            row = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(values[keep]), batch.column("id").take(row), batch.column("n").take(row)], names=["h", "id", "n"])

    return sets.select("id", "n", "tokens").mapInArrow(run, "h long, id long, n long")


def _subset_links(light: DataFrame, percent: int, limit: int) -> DataFrame:
    """Links (a, b) between light sets with a common subset of the size that their sizes call for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for doc, n, tokens in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), _lists_of(batch.column("tokens")), strict=True):
                for b in partner_sizes(n, percent):
                    need = least_overlap(n, b, percent)
                    if b > limit or need > min(n, b):
                        continue
                    for chosen in combinations(bytehash.mix(tokens), need):
                        rows.append((min(n, b), max(n, b), np.array(chosen).sum(dtype=np.uint64).astype(np.int64), doc, n))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["lo", "hi", "subset", "id", "n"])

    parts = light.mapInArrow(run, "lo long, hi long, subset long, id long, n long")
    bucket = ["lo", "hi", "subset"]
    parts = materialize(parts, "jaccard-subsets")
    # Members of the larger size are linked through one of the smaller size: among themselves they may share too little.
    leaders = parts.filter("n = lo").groupBy(*bucket).agg(F.min("id").alias("a"))
    return parts.join(merged(leaders), bucket).filter("id <> a").select("a", F.col("id").alias("b"))


def _verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the written ``pairs`` (a, b) whose sets are similar, from the texts."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = _id_filter(ends)
    sets = materialize(_sets(docs, size, percent, "all", ids=wanted).select("id", "tokens"), "jaccard-sets")
    wanted.release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_lists_of(batch.column("x")), _lists_of(batch.column("y")), strict=True):
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(merged(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))), "b").join(
        merged(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"))), "a"
    )
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _split_lists(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (h, id, n, component) of the lists that still hold two components."""
    if labels is not None:
        members = members.join(merged(labels), "id", "left").withColumn("component", F.coalesce("component", "id"))
    else:
        members = members.withColumn("component", F.col("id"))
    open_lists = members.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    return members.join(merged(open_lists.select("h")), "h", "left_semi")


def _size_fits(a: str, b: str, percent: int):
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (F.greatest(a, b) > boundary(percent))


def _k(n: str):
    return F.least(F.greatest(F.floor(F.col(n) / 16), F.lit(1)), F.lit(4))


def _shared_enough(a: str, b: str, percent: int):
    """How many listed shingles two linked sets of sizes a and b share at least.

    Up to the end of the shorter-reaching list, all common shingles are listed
    in both; past it, that set has no more left than it doesn't list.
    """
    overlap = F.ceil(percent * (F.col(a) + F.col(b)) / (100 + percent))
    unlisted = [F.ceil(F.col(n) * percent / 100) - _k(n) for n in (a, b)]
    return F.greatest(F.lit(1), overlap - F.greatest(*unlisted))


def _star_pairs(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each set the leader that it shares most lists with, out of one leader per list."""
    rank = F.xxhash64("id", F.lit(turn)) if turn else F.col("id")
    leader = lists.groupBy("h").agg(F.min(F.struct(rank.alias("rank"), "id", "n", "component")).alias("lead"))
    met = (
        lists.join(merged(leader), "h")
        .filter("lead.component <> component")
        .select("id", "n", F.col("lead.id").alias("other"), F.col("lead.n").alias("other_n"))
        .filter(_size_fits("n", "other_n", percent))
        .groupBy("id", "other")
        .agg(F.count(F.lit(1)).alias("shared"), F.min(_shared_enough("n", "other_n", percent)).alias("enough"))
        .filter("2 * shared >= enough")  # other leaders may hold the rest
    )
    best = met.groupBy("id").agg(F.max_by("other", F.struct("shared", "other")).alias("other"))
    return best.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _gathered(lists: DataFrame, clusters: DataFrame) -> DataFrame:
    """The clusters (id, component) after small ones have gone over to larger ones that may hold partners of theirs.

    A list's leading cluster has the most members there. A set that shares
    fewer lists with a cluster than linked sets do has no link to any of its
    members. Of two clusters that may have links the smaller goes over to the
    larger, and on to where that goes itself; so a group of copies is one
    cluster, however unlike its members are, and is compared by tiles. What
    does not meet here is found by the join across clusters.
    """
    parts = lists.groupBy("h", "component").agg(F.count(F.lit(1)).alias("c"))
    leading = parts.groupBy("h").agg(F.max(F.struct("c", "component")).alias("lead"))
    met = lists.join(merged(leading), "h").filter("component <> lead.component").groupBy("id", "n", "component", F.col("lead.component").alias("lead"))
    edges = met.agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= _k("n")).select("component", "lead").distinct()
    every = clusters.unionByName(edges.select(F.explode(F.array("component", "lead")).alias("id")).distinct().withColumn("component", F.col("id")))
    every = materialize(every.groupBy("id").agg(F.min("component").alias("component")), "jaccard-clusters")
    sizes = every.groupBy("component").agg(F.struct(F.count(F.lit(1)), "component").alias("size"))
    both = edges.join(merged(sizes), "component").join(merged(sizes.select(F.col("component").alias("lead"), F.col("size").alias("lead_size"))), "lead")
    ends = F.array_sort(F.array("size", "lead_size"))
    over = materialize(both.groupBy(ends[0]["component"].alias("component")).agg(F.max(ends[1]).alias("to")).select("component", F.col("to.component").alias("to")), "jaccard-over")
    further = over.join(merged(over.select(F.col("component").alias("to"), F.col("to").alias("further"))), "to", "left")
    moved = further.select("component", F.coalesce("further", "to").alias("to"))
    return materialize(every.join(merged(moved), "component", "left").select("id", F.coalesce("to", "component").alias("component")), "jaccard-clusters")


def _open_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Every pair that shares as many lists as linked sets must and lies in two components."""
    parts = lists.groupBy("h", "component").agg(F.count(F.lit(1)).alias("members")).drop("members")
    meets = parts.select("h", F.col("component").alias("c1")).join(merged(parts.select("h", F.col("component").alias("c2"))), "h").filter("c1 < c2")
    x = lists.select("h", F.col("component").alias("c1"), F.col("id").alias("x"), F.col("n").alias("nx"))
    y = lists.select("h", F.col("component").alias("c2"), F.col("id").alias("y"), F.col("n").alias("ny"))
    return (
        meets.join(merged(x), ["h", "c1"])
        .join(merged(y), ["h", "c2"])
        .filter(_size_fits("nx", "ny", percent))
        .groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"), F.min(_shared_enough("nx", "ny", percent)).alias("enough"))
        .filter("shared >= enough")
        .select("a", "b")
    )


def _cluster_links(docs: DataFrame, labels: DataFrame, clusters: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components of one cluster, one for each two components and pair of tiles.

    A cluster's sets are dealt into tiles of some hundred, those of a large
    component into tiles of their own. Tiles meet tiles, but not those of their
    own component, and two tiles are compared in one product of matrices: what
    is shuffled and emitted are sets and links, never pairs.
    """
    nodes = clusters.withColumnRenamed("component", "cluster").join(merged(labels), "id", "left").withColumn("component", F.coalesce("component", "id"))
    nodes = materialize(nodes, "jaccard-clusters")
    several = nodes.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    nodes = nodes.join(merged(several.select("cluster")), "cluster", "left_semi")
    large = nodes.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= TILE).drop("c")
    nodes = nodes.join(merged(large.withColumn("own", F.col("component"))), ["cluster", "component"], "left")
    sizes = nodes.groupBy("cluster", "own").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("chunks"))
    dealt = nodes.alias("x").join(merged(sizes.alias("y")), (F.col("x.cluster") == F.col("y.cluster")) & F.col("x.own").eqNullSafe(F.col("y.own")))
    tile = F.xxhash64("x.cluster", "x.own", F.pmod(F.xxhash64("id"), F.col("chunks")))
    dealt = materialize(dealt.select("id", "component", "x.cluster", "x.own", tile.alias("tile")), "jaccard-tiles")
    tiles = dealt.select("cluster", "own", "tile").distinct()
    meets = tiles.alias("x").join(merged(tiles.alias("y")), "cluster").filter("x.tile <= y.tile and (x.own is null or y.own is null or x.own <> y.own)")
    meets = meets.select(F.xxhash64("x.tile", "y.tile").alias("meeting"), F.explode(F.array_distinct(F.array("x.tile", "y.tile"))).alias("tile"))
    wanted = _id_filter(dealt)
    sets = materialize(_sets(docs, size, percent, "all", ids=wanted).select("id", "tokens"), "jaccard-sets")
    wanted.release()
    rows = meets.join(merged(dealt.select("tile", "id", "component")), "tile").join(merged(sets), "id").select("meeting", "id", "component", "tokens")

    def compare(rows: pa.Table) -> pa.Table:
        ids, component = (rows.column(c).to_numpy() for c in ("id", "component"))
        lists = _lists_of(rows.column("tokens").combine_chunks())
        sizes = np.array([len(x) for x in lists])
        _, column, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        place = np.cumsum(count > 1) - 1  # shingles of one set don't matter
        row = np.repeat(np.arange(len(lists)), sizes)
        shared = count[column] > 1
        row, column = row[shared], place[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(lists), len(lists)), np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, z = np.searchsorted(column, (start, start + 4096))
            held = np.zeros((len(lists), 4096), np.float32)
            held[row[a:z], column[a:z] - start] = 1
            common += held @ held.T
        linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        x, y = np.nonzero(np.triu(linked & (component[:, None] != component[None, :]), 1))
        if len(x):
            between = np.sort(np.stack([component[x], component[y]]), axis=0)
            _, one = np.unique(between, axis=1, return_index=True)
            x, y = x[one], y[one]
        return pa.table({"a": pa.array(ids[x], pa.int64()), "b": pa.array(ids[y], pa.int64())})

    return rows.groupBy("meeting").applyInArrow(compare, "a long, b long")


def link(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``."""
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    limit = boundary(percent)
    keys = ["k1", "k2", "n"]
    every = materialize(_sets(docs, size, percent, "none").drop("tokens"), "jaccard-digests")
    nodes = every.filter("n > 0 and id is not null")
    # One node per distinct set: the smallest id that has it. Only these are listed, but for a few that the filter lets pass.
    heads = materialize(nodes.groupBy(*keys).agg(F.min("id").alias("id")), "jaccard-heads")
    copies = nodes.withColumnRenamed("id", "b").join(merged(heads.withColumnRenamed("id", "a")), keys).filter("a <> b").select("a", "b")
    once = _id_filter(heads)
    order = _order(_shingle_counts(docs, size, once))
    sets = materialize(
        _sets(docs, size, percent, "listed", ids=once, order=order).filter("n > 0 and id is not null").select("id", "n", "tokens"),
        "jaccard-listed",
    )
    for used in (once, *order):
        used.release()
    heavy = _to_list(sets, percent, limit)
    recurring = key_filter(_listed_counts(heavy), "at")
    lists = materialize(_split_lists(_members(heavy, recurring), None), "jaccard-lists")
    recurring.release()

    light = sets.filter(F.col("n") <= limit).select("id", "n", "tokens")
    links = materialize(_subset_links(light, percent, limit), "jaccard-links")
    labels, near = None, links
    for turn in range(STAR_ROUNDS):
        if labels is not None:
            lists = materialize(_split_lists(lists.drop("component"), labels), "jaccard-lists")  # a list within one component stays so
        pairs = materialize(_star_pairs(lists, turn, percent), "jaccard-pairs")
        near = near.union(pairs)
        links = materialize(links.union(_verified(docs, pairs, size, percent)), "jaccard-links")
        labels = components(links)
    clusters, members = components(near), lists.drop("component")
    for _ in range(GATHER_ROUNDS):
        clusters = _gathered(materialize(_split_lists(members, clusters), "jaccard-lists"), clusters)
    pairs = materialize(_open_pairs(materialize(_split_lists(members, clusters), "jaccard-lists"), percent), "jaccard-pairs")
    links = links.union(_verified(docs, pairs, size, percent)).union(_cluster_links(docs, labels, clusters, size, percent))
    reached = components(links.union(copies))
    return (
        every.select("id", "n")
        .join(merged(reached), "id", "left")
        .select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group: one of each group of linked texts, that of the smallest id.

    A text goes by its own set: where an id has several texts, or none, each
    text is a node of its own and only texts of the group go. Equal rows of one
    such id stay once.
    """
    several = materialize(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 or doc_id is null").select("doc_id"), "jaccard-several")
    if several.isEmpty():
        drop = settled(lambda: link(docs.select("doc_id", "text")).filter("doc_id <> component_id").select(F.col("doc_id").alias("_node")), "jaccard-decisions")
        return docs.join(drop, F.col("doc_id") == F.col("_node"), "left_anti")
    several = several.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_several"))
    own = F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(1 << 62)) - F.lit((1 << 62) + (1 << 61))  # below any id in use
    marked = docs.join(several, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("_node", F.when(F.col("_several"), own).otherwise(F.col("doc_id").cast("long")))
    groups = settled(lambda: link(marked.select("_node", "text"), id="_node").select("_node", "component_id").distinct(), "jaccard-groups")
    places = marked.select("doc_id", "_node").distinct().join(groups, "_node")
    first = places.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_node")).alias("first"))
    drop = materialize(groups.select("_node").join(first.select(F.col("first._node").alias("_node")), "_node", "left_anti"), "jaccard-decisions")
    kept = marked.join(drop, "_node", "left_anti")
    once = kept.filter("_several").dropDuplicates(["doc_id", "_node"]).unionByName(kept.filter("_several is null"))
    return once.select(*docs.columns)
