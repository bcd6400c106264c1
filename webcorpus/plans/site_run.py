"""A whole run over all seeds: crawl, convert, name and list files, count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.once import with_once
from ..functions.paths import markdown_dir, markdown_name
from ..operators.files import distinct_files, file_sections, name_files, page_files
from ..operators.report import site_stats
from ..operators.robots import robots_policies, with_robots
from ..schemas import FILES
from ..session import materialize
from .crawl import crawl, crawl_pages, fetchable_pages, link_graph, parse_archive


@dataclass
class SiteRun:
    """Tables a run leaves behind."""

    crawl: DataFrame
    markdown: DataFrame
    files: DataFrame
    stats: DataFrame
    sections: Callable[[], DataFrame]  # built when asked for: its steps are written down as they go


def settle_paths(markdown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, lost) when several pages have one output path: the last one written stays.

    ``markdown``: page_id, site, url, fifo_rank, dir, filename and more. Who
    stays is settled on these columns and written down; the rest of a row, its
    text above all, is moved once, by its own key, and only where it is kept.
    ``lost`` has the narrow columns.
    """
    narrow = [c for c in ("site", "page_id", "url", "fifo_rank", "dir", "filename") if c in markdown.columns]
    last = markdown.groupBy("dir", "filename").agg(F.max(F.struct("fifo_rank", "site", "page_id")).alias("last"))
    winners = materialize(last.select("last.site", "last.page_id"), "winners")
    return markdown.join(winners, ["site", "page_id"], "left_semi"), markdown.select(*narrow).join(winners, ["site", "page_id"], "left_anti")


def run_sites(
    seeds: DataFrame,
    pages: DataFrame,
    robots: DataFrame | None = None,
    content_types: DataFrame | None = None,
    output_dir: str = "corpus",
    max_pages_per_site: int = 100,
    download_files: bool = True,
    match: str = "text",
    fetches: DataFrame | None = None,
) -> SiteRun:
    """Crawl the archive ``pages`` from ``seeds`` (url) and lay the result out as a corpus.

    ``robots``: origin, fetch_status, body. ``content_types``: file_url,
    content_type of files whose URL shows no extension. ``match`` says which
    files a page lists: ``text`` goes by URLs found in texts (see
    ``page_files``), ``links`` by what the page links to. ``fetches``: page_id,
    started, ended in seconds, from which the statistics get durations.
    """
    if match not in ("text", "links"):
        raise ValueError(f"match must be text or links, not {match}")
    if seeds.isEmpty():
        raise ValueError("no URLs to process")
    spark = seeds.sparkSession
    policies = None if robots is None else materialize(robots_policies(robots), "robots")
    fetchable = fetchable_pages(pages, policies, seeds)
    if max_pages_per_site > 0:
        crawled, parsed = crawl_pages(seeds, fetchable, max_pages_per_site)
        _, file_links = link_graph(parsed)
    else:
        parsed = materialize(parse_archive(fetchable), "parsed")
        graph, file_links = link_graph(parsed)
        crawled = crawl(seeds, graph, 0)

    markdown = with_once(
        crawled.join(parsed.select("page_id", "title", "markdown"), "page_id"),
        dir=markdown_dir(F.col("url"), output_dir),
        filename=markdown_name(F.col("url")),
    )
    if download_files:
        links = crawled.join(file_links, "page_id").select("site", F.col("file_url").alias("norm"), F.lit("file").alias("kind"))
        files = materialize(distinct_files(links), "file-links")
        if policies is not None:
            files = with_robots(files, policies, "file_url", "site").filter("allowed").drop("allowed")
        if content_types is not None:
            files = files.join(content_types, "file_url", "left")
        else:
            files = files.withColumn("content_type", F.lit(None).cast("string"))
        files = materialize(name_files(files, output_dir), "files")
    else:
        files = spark.createDataFrame([], FILES).withColumns(
            {name: F.lit(None).cast("string") for name in ("dir", "filename", "local_path")}
        )
    stats = site_stats(
        seeds.select(F.col("url").alias("site")),
        markdown.select("site", F.col("markdown").isNotNull().alias("converted")),
        files,
        None if fetches is None else crawled.select("site", "page_id").join(fetches, "page_id"),
    )

    def sections() -> DataFrame:
        placed = materialize(
            markdown.filter("markdown IS NOT NULL").select("site", "page_id", F.col("url").alias("page_url")), "placed"
        )
        if match == "links":
            pairs = placed.join(file_links, "page_id").select("site", "page_id", "file_url").distinct()
        else:
            pairs = page_files(placed.join(parsed.select("page_id", "anchors"), "page_id"), files, fetchable)
        return file_sections(pairs, placed, files, output_dir)

    return SiteRun(crawled, markdown, files, stats, sections)
