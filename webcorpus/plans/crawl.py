"""Bounded breadth-first crawl of an archive, all sites at once, one level per step."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from ..functions.once import with_once
from ..functions.urls import is_downloadable, is_same_domain, is_valid_url, normalize_url, url_netloc
from ..operators.files import with_anchors
from ..operators.html import parse_pages
from ..operators.links import classify_links, explode_links, unvisited
from ..operators.pages import later_copies, normalized_urls, without
from ..operators.robots import with_robots
from ..schemas import CRAWL
from ..session import materialize, scratch_path

_PARENTS = 1024  # parents per slice of a level's queue
_REACHED = "site string, url string, page_id long, slice long, n long, site_start long, level int"


def fetchable_pages(pages: DataFrame, policies: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """Pages a crawl could fetch: one per canonical URL, allowed by robots, with content.

    With ``seeds`` (url) pages of hosts that no seed names are left out before
    anything is parsed: links never leave a seed's host.

    Which pages to leave out is settled on ids and URLs alone and written down;
    the HTML is read once, by whoever uses the result.
    """
    if seeds is not None:
        hosts = seeds.select(url_netloc(normalize_url(F.col("url"))).alias("_host")).distinct()
        hosted = with_once(pages, _host=url_netloc(normalize_url(F.col("url"))))
        pages = hosted.join(materialize(hosts, "seed-hosts"), "_host", "left_semi").select(*pages.columns)
    urls = materialize(normalized_urls(pages), "urls")
    excluded = later_copies(urls.filter("has_html"))  # an empty first copy doesn't hide a later one with content
    if policies is not None:
        excluded = excluded.unionByName(with_robots(urls, policies, spread_by="page_id").filter("NOT allowed").select("page_id"))
    return without(pages, materialize(excluded, "excluded")).filter("html <> ''")


def parse_archive(fetchable: DataFrame) -> DataFrame:
    """The one pass over the HTML: page_id, url, anchors, title, markdown, links."""
    return parse_pages(with_anchors(fetchable), keep=("page_id", "url", "anchors"))


def link_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per page with the array of its page links, one row per file link).

    A page's links are resolved to targets inside its own row, so the graph
    needs no shuffle.
    """
    near = F.filter("links", lambda link: (link["source"] == "a") & is_same_domain(link["resolved"], F.col("url")))
    targets = F.transform(
        near, lambda link: F.struct(link["pos"].alias("pos"), normalize_url(link["resolved"]).alias("target"))
    )
    pages = parsed.select(
        "page_id",
        "url",
        F.filter(targets, lambda t: t["target"].isNotNull() & ~is_downloadable(t["target"])).alias("targets"),
    )
    links = classify_links(explode_links(parsed, ("page_id", "url")), base="url")
    files = links.filter("kind = 'file'").select("page_id", F.col("norm").alias("file_url"))
    return pages, files


def crawl(seeds: DataFrame, graph: DataFrame, max_pages: int = 100, buckets: int | None = None) -> DataFrame:
    """Pages reached from each seed: site, url, depth, fifo_rank, page_id.

    ``seeds``: url; a seed that is not a valid URL reaches nothing. ``graph``
    is what ``link_graph`` gives: one row per fetchable page with its page
    links. ``fifo_rank`` counts a site's successful pages in breadth-first
    order (parents in order, links in document order, first discovery wins);
    with ``max_pages`` > 0 only ranks up to it are kept. Failed fetches do not
    count and yield no links.

    The state between levels is one table of the pages reached so far, bucketed
    by (site, url); each level is one job that appends its pages to it. The
    graph is bucketed by URL. A level therefore moves its own new rows only:
    neither the graph nor the reached pages are shuffled again, however deep a
    crawl is. Buckets are as many as shuffle partitions, so that what a level
    shuffles meets them as it is. Reached pages carry their number within a
    slice of parents and where their site's numbers began; ranks follow from
    the sizes of the slices, so a level needs nothing but the level before it.
    A lost executor costs no recomputation of earlier levels.
    """
    state = _Crawl(seeds.sparkSession, buckets)
    try:
        state.store_graph(graph.select("url", "page_id", "targets"))
        state.run(seeds, lambda depth: state.stored, max_pages)
    finally:
        state.drop()
    return state.pages(max_pages)


def crawl_pages(seeds: DataFrame, fetchable: DataFrame, max_pages: int, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the same crawl, the parsed pages): a capped crawl that parses the pages it reaches and no others.

    ``fetchable``: page_id, url, html, as ``fetchable_pages`` gives them. Each
    level picks its pages out of the archive by their ids, parses and writes
    them, and the next level follows their links. The archive's HTML is read
    once for each level, which is cheap next to parsing, and never shuffled as
    long as a level's ids can be broadcast; a crawl without a cap rather parses
    all pages once (``parse_archive``).
    """
    spark = seeds.sparkSession
    state = _Crawl(spark, buckets)
    parsed = f"{state.root}/parsed"
    schema = parse_archive(fetchable).schema

    def parse_level(depth: int) -> DataFrame:
        level = _ranked(spark.table(state.reached).filter(F.col("level") == depth), ["site"])
        ids = level.filter(F.col("fifo_rank") <= max_pages).select("page_id").distinct()
        if depth:
            ids = ids.join(spark.read.schema(schema).parquet(parsed).select("page_id"), "page_id", "left_anti")
        wanted = fetchable.join(materialize(ids, "level-pages"), "page_id", "left_semi")
        parse_archive(wanted).write.mode("append").parquet(parsed)
        return link_graph(spark.read.schema(schema).parquet(parsed))[0]

    try:
        state.store_graph(fetchable.select("url", "page_id"))
        state.run(seeds, parse_level, max_pages)
    finally:
        state.drop()
    pages = state.pages(max_pages)
    return pages, spark.read.schema(schema).parquet(parsed) if state.depth else spark.createDataFrame([], schema)


class _Crawl:
    """The tables of one crawl and its loop over levels."""

    def __init__(self, spark: SparkSession, buckets: int | None):
        self.spark, self.root = spark, scratch_path(spark, "crawl")
        self.width = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = uuid.uuid4().hex
        self.graph, self.reached = f"crawl_graph_{name}", f"crawl_reached_{name}"
        self.depth = 0

    def store_graph(self, graph: DataFrame) -> None:
        placed = graph.repartition(self.width, "url").write.bucketBy(self.width, "url").sortBy("url")
        placed.option("path", f"{self.root}/graph").saveAsTable(self.graph)
        self.stored = self.spark.table(self.graph)

    def run(self, seeds: DataFrame, links_of: Callable[[int], DataFrame], max_pages: int) -> None:
        """``links_of``: a table with the links (url, targets) of the pages of a level."""
        zero = F.lit(0).cast("long")
        queue = (
            seeds.filter(is_valid_url(F.col("url")))
            .select(F.col("url").alias("site"), normalize_url(F.col("url")).alias("url")).distinct()
            .select("site", "url", zero.alias("parent_rank"), F.lit(0).alias("pos"), zero.alias("site_start"))
        )
        while _append_level(queue, self.stored, self.reached, f"{self.root}/reached", self.depth, self.width):
            queue = next_queue(self.spark.table(self.reached), links_of(self.depth), self.depth, max_pages)
            self.depth += 1

    def drop(self) -> None:
        for table in (self.graph, self.reached):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")  # external: only the catalog entry goes

    def pages(self, max_pages: int) -> DataFrame:
        if not self.depth:
            return self.spark.createDataFrame([], CRAWL)
        reached = _ranked(self.spark.read.schema(_REACHED).parquet(f"{self.root}/reached"), ["level", "site"])
        if max_pages > 0:
            reached = reached.filter(F.col("fifo_rank") <= max_pages)
        return reached.select("site", "url", F.col("level").alias("depth"), "fifo_rank", "page_id")


def _append_level(queue: DataFrame, graph: DataFrame, table: str, path: str, depth: int, width: int) -> int:
    """Add the queue's pages that can be fetched to the reached ones; how many they are."""
    slice_of = ["site", "slice"]
    hits = queue.join(graph.select("url", "page_id"), "url").withColumn("slice", F.floor(F.col("parent_rank") / _PARENTS))
    numbered = hits.withColumn("n", F.row_number().over(Window.partitionBy(*slice_of).orderBy("parent_rank", "pos")))
    found = Observation()
    (
        numbered.select("site", "url", "page_id", "slice", F.col("n").cast("long").alias("n"), "site_start", F.lit(depth).alias("level"))
        .observe(found, F.count(F.lit(1)).alias("pages"))
        .repartition(width, "site", "url")
        .write.mode("append").partitionBy("level").bucketBy(width, "site", "url").option("path", path).saveAsTable(table)
    )
    return found.get["pages"]


def _ranked(reached: DataFrame, keys: list[str]) -> DataFrame:
    """Reached pages with fifo_rank, and next_start: their site's pages up to and with this level."""
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = reached.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("_n"), F.min("site_start").alias("_start"))
    starts = sizes.select(
        *keys, "slice",
        (F.col("_start") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_before"),
        (F.col("_start") + F.sum("_n").over(Window.partitionBy(*keys))).alias("next_start"),
    )
    return reached.join(starts, [*keys, "slice"]).withColumn("fifo_rank", F.col("_before") + F.col("n"))


def next_queue(reached: DataFrame, graph: DataFrame, depth: int, max_pages: int) -> DataFrame:
    """What the pages of level ``depth`` link to and no level has reached; sites at their cap are done."""
    level = _ranked(reached.filter(F.col("level") == depth), ["site"])
    if max_pages > 0:
        level = level.filter(F.col("next_start") < max_pages)
    links = (
        level.join(graph.select("url", "targets"), "url")
        .select("site", F.col("fifo_rank").alias("parent_rank"), F.col("next_start").alias("site_start"), F.inline("targets"))
        .withColumnRenamed("target", "url")
    )
    return unvisited(links, reached, ["site", "url"], ["parent_rank", "pos", "site_start"])
