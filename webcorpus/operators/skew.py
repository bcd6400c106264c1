"""Joins of many rows to a table when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..session import materialize

_MOST_HOT = 4096  # hot keys that are told apart, at most
_TRACKED = 16  # keys that the sketch tracks for each that it reports


def lookup_join(rows: DataFrame, table: DataFrame, on: list[str], spread_by: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined to ``table`` (inner or left), hot keys split over many tasks.

    ``rows`` is evaluated once: it is written down, and a sketch of its most
    frequent keys is taken on the way. A key with more rows than a partition
    has on average is hot. Its rows are salted by a hash of ``spread_by`` into
    as many parts as partitions that they would fill, and the table's rows of
    that key are repeated once per part; every other key joins as usual. There
    are fewer hot keys, and fewer repeats in all, than twice the partitions.
    """
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reported = min(2 * partitions, _MOST_HOT)
    key, seen = F.xxhash64(*on), Observation()
    sketch = F.expr(f"approx_top_k(_hash, {reported}, {reported * _TRACKED})")
    counted = rows.withColumn("_hash", key).observe(seen, F.count(F.lit(1)).alias("n"), sketch.alias("top"))
    stored = materialize(counted, "lookup-rows")
    hot = hot_keys(seen.get["top"], seen.get["n"], partitions)
    if not hot:
        return stored.drop("_hash").join(table, on, how)
    parts = F.broadcast(spark.createDataFrame(hot, "_hash long, _parts int"))  # fewer rows than two for each partition
    salted = stored.join(parts, "_hash", "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.coalesce("_parts", F.lit(1))).cast("int"))
    repeated = table.withColumn("_hash", key).join(parts, "_hash", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    )
    return salted.drop("_parts", "_hash").join(repeated.drop("_parts", "_hash"), [*on, "_salt"], how).drop("_salt")


def hot_keys(top: list, total: int, partitions: int) -> list[tuple[int, int]]:
    """(key, parts) of the keys that fill more than one partition, by the sketch's (item, count)."""
    return [(item, parts) for item, count in top if (parts := -(-count * partitions // total)) > 1]
