"""Running totals and row numbers that never sort a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def digest_chunk(col: Column) -> Column:
    """4096 even, ordered slices of an MD5-ordered key."""
    return F.substring(F.md5(col), 1, 3)


def running_total(
    rows: DataFrame,
    keys: list[str],
    chunk: Column,
    order: list[Column | str],
    name: str,
    weight: Column | None = None,
) -> DataFrame:
    """Add ``name``: the sum of ``weight`` (default 1) up to and including this row, per key.

    ``chunk`` must not decrease along ``order``. Rows are summed within a chunk
    and each chunk starts from the total of the chunks before it, so a key
    holding any share of the rows is spread over as many tasks as it has
    chunks. Keys and chunks must not be NULL.
    """
    rows = rows.withColumn("_chunk", chunk).withColumn("_weight", (weight if weight is not None else F.lit(1)).cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    within = (
        Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    starts = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.sum("_weight").alias("_sum"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    )
    return (
        rows.join(starts, [*keys, "_chunk"])
        .withColumn(name, F.col("_start") + F.sum("_weight").over(within))
        .drop("_chunk", "_weight", "_start")
    )
