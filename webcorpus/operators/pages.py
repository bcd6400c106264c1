"""Archived pages: canonical copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.once import with_once
from ..functions.urls import normalize_url
from ..session import materialize


def canonical_ids(pages: DataFrame) -> DataFrame:
    """One row per normalised URL: the first page of it and the number of copies."""
    return (
        with_once(pages.select("page_id", "url"), norm=normalize_url(F.col("url")))
        .groupBy("norm")
        .agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))
    )


def normalized_urls(pages: DataFrame) -> DataFrame:
    """page_id, normalised url, NULL for a URL that does not parse, and whether the page has content."""
    narrow = pages.select("page_id", F.col("url").alias("_url"), F.coalesce(F.length("html") > 0, F.lit(False)).alias("has_html"))
    return with_once(narrow, url=normalize_url(F.col("_url"))).drop("_url")


def later_copies(urls: DataFrame) -> DataFrame:
    """Ids of pages that are not the first of their URL.

    The side joined has one row per repeated URL; where one URL holds most
    pages, adaptive execution splits that URL's rows over several tasks.
    """
    first = urls.groupBy("url").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return urls.join(first, "url").filter("page_id <> first_id").select("page_id")


def without(pages: DataFrame, excluded: DataFrame) -> DataFrame:
    """Pages with ``url`` normalised and the ids in ``excluded`` left out.

    The wide HTML meets just a list of ids. Callers write that list down first,
    so that Spark knows its size and broadcasts it when that allows.
    """
    kept = pages.join(excluded, "page_id", "left_anti").withColumnRenamed("url", "_url")
    return with_once(kept, url=normalize_url(F.col("_url"))).filter("url IS NOT NULL").drop("_url")


def canonical_pages(pages: DataFrame) -> DataFrame:
    """Pages with ``url`` normalised, later copies of a URL left out."""
    return without(pages, materialize(later_copies(normalized_urls(pages)), "later-copies"))
