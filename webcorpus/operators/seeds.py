"""Seed URLs: validity, duplicates, liveness."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.urls import is_valid_url, with_default_scheme


def split_seeds(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, rejects) of a seed list: trimmed, blanks dropped, repeats kept."""
    trimmed = lines.withColumn("url", F.btrim("url", F.lit(" \t\r\n\x0b\x0c"))).filter("url <> ''")
    valid = is_valid_url(F.col("url"))
    return trimmed.filter(valid), trimmed.filter(~valid)


def candidate_seeds(lines: DataFrame) -> DataFrame:
    """A candidate list without blanks and comments, each URL once, where it first stood."""
    return (
        lines.withColumn("url", F.btrim("url", F.lit(" \t\r\n\x0b\x0c")))
        .filter("url <> '' AND NOT startswith(url, '#')")
        .groupBy("url")
        .agg(F.min("seed_id").alias("seed_id"), F.count("*").alias("copies"))
    )


def live_seeds(seeds: DataFrame, probes: DataFrame) -> DataFrame:
    """Seeds whose probe answered below 400, to HEAD or else to GET. The seed stays as written."""
    answered = probes.filter("head_status < 400 OR get_status < 400").select(F.col("url").alias("_probe"))
    return seeds.join(answered, with_default_scheme(F.col("url")) == F.col("_probe"), "left_semi")
