"""Links of parsed pages: explode, resolve to page or file, keep the unvisited ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.once import with_once
from ..functions.urls import is_downloadable, is_same_domain, normalize_url


def explode_links(parsed: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row per link found, in document order per producer (a, src, css)."""
    return parsed.select(*keep, F.inline("links"))


def classify_links(links: DataFrame, base: str = "base_url") -> DataFrame:
    """Same-domain links with their target ``norm`` and ``kind`` (page or file).

    Anchors are normalised and are a page or a file; ``src`` and CSS references
    keep their query and count only when they are files.
    """
    anchor = F.col("source") == "a"
    near = with_once(
        links.filter(is_same_domain(F.col("resolved"), F.col(base))),
        norm=F.when(anchor, normalize_url(F.col("resolved"))).otherwise(F.col("resolved")),
    ).filter(F.col("norm").isNotNull())
    kind = F.when(is_downloadable(F.col("norm")), "file").otherwise("page")
    return with_once(near, kind=kind).filter(anchor | (F.col("kind") == "file"))


def unvisited(links: DataFrame, visited: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First discovery of every target that has not been visited.

    Repeats collapse before the shuffle, so a target every page links to costs
    one row per map task.
    """
    first = links.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first")).select(*keys, "_first.*")
    return first.join(visited.select(*keys), keys, "left_anti")
