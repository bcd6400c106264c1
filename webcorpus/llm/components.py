"""Connected components of a graph whose hubs may hold any share of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..session import materialize


def merged(table: DataFrame) -> DataFrame:
    """``table`` as the side of a join that is merged, though it may be small.

    Broadcast, it would be gathered by the driver and kept there until both its
    garbage and Spark's are collected: for the dozens of joins of a run of
    rounds that adds up, however few rows they have.
    """
    return table.hint("merge")


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    nearest = _nearest(both).select("u", F.least("m", "u").alias("m"))
    return both.join(merged(nearest), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these. Edges run from larger to smaller."""
    nearest = _nearest(edges)
    moved = edges.join(merged(nearest), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(nearest.select("u", F.col("m").alias("v")))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, with their number and checksum, taken while they are written."""
    seen = Observation()
    written = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sum")), "components")
    return written, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): the smallest id that its links reach.

    Stars are contracted in turns until nothing moves, a number of rounds that
    grows with the logarithm of the longest path. Smallest neighbours are
    aggregates; a hub meets its edges in a join that Spark splits if it is
    skewed. Each round is a written table.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, state = _written(edges)
    while state[0]:
        edges, found = _written(_small_star(_large_star(edges)).distinct())
        if found == state:
            break
        state = found
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)
