"""Columns computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions stay where they are.

    The optimizer copies the expression of an ordinary column into every filter
    it pushes below it, and a chain of pattern matches soon outgrows what code
    generation accepts. Columns that leave a generator are plain inputs to all
    that follows.
    """
    return df.select("*", F.inline(F.array(F.struct(*[col.alias(name) for name, col in columns.items()]))))
