"""The queries of the engine over the test tables, one per operator or small group of operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.once import with_once
from ..functions.paths import (
    base_name,
    duration_text,
    extension_label,
    files_dir,
    markdown_dir,
    markdown_name,
    relative_path,
)
from ..functions.urls import is_downloadable, is_valid_url, normalize_url, url_netloc, url_path, url_scheme
from ..operators import files as file_ops, html, links, logs, pages as page_ops, report, robots, runs, seeds, uploads
from ..session import materialize, scratch_path
from ..sinks.tables import append_attempts, append_ledger, append_live_seeds, export_tree
from ..sources.tables import read_failures, read_inventory, read_ledger, read_log, read_runs, read_seed_list
from ..streaming import follow
from . import analysis, crawl as crawling, site_run
from .delivery_run import deliver
from .derived import table

OUT = "corpus"
GENERATED = "2025-01-01 00:00:00"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


# -- URLs ---------------------------------------------------------------------


@query
def url_normalize(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        url_scheme(url).alias("scheme"),
        url_netloc(url).alias("netloc"),
        url_path(url).alias("path"),
        normalize_url(url).alias("norm"),
    )


@query
def url_validate(spark, sf_dir):
    urls = (
        table(spark, sf_dir, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), "url")
        .unionByName(
            table(spark, sf_dir, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.col("source").alias("url"))
        )
    )
    return urls.select("origin", "id", "url", is_valid_url(F.col("url")).alias("valid"))


@query
def url_canonical(spark, sf_dir):
    return page_ops.canonical_ids(table(spark, sf_dir, "pages"))


@query
def url_download(spark, sf_dir):
    return table(spark, sf_dir, "file_urls").select("page_id", "file_url", is_downloadable(F.col("file_url")).alias("is_file"))


# -- HTML and links -----------------------------------------------------------


def _parsed(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("base_url", normalize_url(F.col("url")))
    return html.parse_pages(pages, keep=("page_id", "base_url"), url="base_url")


def _links(spark, sf_dir):
    return links.explode_links(_parsed(spark, sf_dir), ("page_id", "base_url"))


@query
def link_extract(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "source", F.col("pos").cast("long").alias("pos"), "raw")


@query
def link_resolve(spark, sf_dir):
    return links.classify_links(_links(spark, sf_dir)).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "resolved", "norm", "kind"
    )


@query
def link_frontier(spark, sf_dir):
    found = links.classify_links(_links(spark, sf_dir)).filter("kind = 'page'").select(
        url_netloc(F.col("base_url")).alias("site"), F.col("norm").alias("url"), "page_id", F.col("pos").cast("long").alias("pos")
    )
    visited = page_ops.canonical_ids(table(spark, sf_dir, "pages")).select(
        url_netloc(F.col("norm")).alias("site"), F.col("norm").alias("url")
    )
    return links.unvisited(found, visited, ["site", "url"], ["page_id", "pos"])


@query
def markdown_convert(spark, sf_dir):
    return _parsed(spark, sf_dir).select("page_id", "title", "markdown")


@query
def robots_filter(spark, sf_dir):
    policies = robots.robots_policies(table(spark, sf_dir, "robots"))
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    return robots.with_robots(urls, policies, spread_by="page_id").select("page_id", "url", "allowed")


# -- Crawl --------------------------------------------------------------------


def _crawl_web(spark, sf_dir, max_pages):
    parsed = crawling.parse_archive(crawling.fetchable_pages(table(spark, sf_dir, "web")))
    graph, _ = crawling.link_graph(parsed)
    return crawling.crawl(table(spark, sf_dir, "web_seeds"), graph, max_pages)


@query
def crawl_bfs(spark, sf_dir):
    return _crawl_web(spark, sf_dir, 10)


@query
def crawl_uncapped(spark, sf_dir):
    return _crawl_web(spark, sf_dir, 0)


@query
def site_stats(spark, sf_dir):
    run = site_run.run_sites(
        table(spark, sf_dir, "web_seeds"), table(spark, sf_dir, "web"), table(spark, sf_dir, "web_robots"),
        output_dir=OUT, max_pages_per_site=10, fetches=table(spark, sf_dir, "web_fetches"),
    )
    return run.stats


# -- Output paths and files ---------------------------------------------------


def _markdown_paths(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", url_netloc(url).alias("site"), "url",
        markdown_dir(url, OUT).alias("dir"), markdown_name(url).alias("filename"),
    )


@query
def page_paths(spark, sf_dir):
    return _markdown_paths(spark, sf_dir).select("page_id", "dir", "filename")


@query
def link_paths(spark, sf_dir):
    """Where the targets of all links would be written; their names use many Latin letters with marks."""
    target = F.col("norm")
    return (
        links.classify_links(_links(spark, sf_dir)).select("norm").distinct()
        .select(F.col("norm").alias("url"), markdown_dir(target, OUT).alias("dir"), markdown_name(target).alias("filename"))
    )


@query
def path_collisions(spark, sf_dir):
    paths = _markdown_paths(spark, sf_dir).withColumn("fifo_rank", F.col("page_id"))
    kept, lost = site_run.settle_paths(paths)
    return kept.withColumn("kept", F.lit(True)).unionByName(lost.withColumn("kept", F.lit(False))).select(
        "page_id", "dir", "filename", "kept"
    )


def _named_files(spark, sf_dir):
    files = table(spark, sf_dir, "file_urls").filter(is_downloadable(F.col("file_url")))
    return file_ops.name_files(files.select("site", "file_url", "content_type").distinct(), OUT)


@query
def file_names(spark, sf_dir):
    return _named_files(spark, sf_dir).select("site", "file_url", files_dir(F.col("file_url"), OUT).alias("dir"), "filename", "local_path")


@query
def page_files(spark, sf_dir):
    pages = table(spark, sf_dir, "mentions")
    files = _named_files(spark, sf_dir)
    pairs = file_ops.page_files(file_ops.with_anchors(pages, "page_url"), files, pages)
    return file_ops.file_sections(pairs, pages.drop("html"), files, OUT, part_size=20).select(
        "page_id", "page_url", "part", "n_files", "section"
    )


@query
def page_file_links(spark, sf_dir):
    pages = table(spark, sf_dir, "mentions")
    files = _named_files(spark, sf_dir)
    places = with_once(pages.select("page_id", "page_url"), md_dir=markdown_dir(F.col("page_url"), OUT))
    return (
        file_ops.page_files(file_ops.with_anchors(pages, "page_url"), files, pages)
        .join(files.select("site", "file_url", "local_path"), ["site", "file_url"])
        .join(places, "page_id")
        .select("page_id", "file_url", base_name(F.col("local_path")).alias("name"), relative_path(F.col("local_path"), F.col("md_dir")).alias("rel_path"))
    )


# -- Seeds --------------------------------------------------------------------


@query
def seed_scan(spark, sf_dir):
    good, bad = seeds.split_seeds(table(spark, sf_dir, "seed_lines"))
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


@query
def seed_dedup(spark, sf_dir):
    return seeds.candidate_seeds(table(spark, sf_dir, "seed_lines"))


@query
def seed_liveness(spark, sf_dir):
    return seeds.live_seeds(table(spark, sf_dir, "candidates"), table(spark, sf_dir, "probes"))


# -- Inventory, delivery and ledger -------------------------------------------


@query
def inventory_ext(spark, sf_dir):
    counted = report.extension_histogram(table(spark, sf_dir, "inventory"))
    total = table(spark, sf_dir, "inventory").agg(F.count("*").alias("files")).select(
        F.lit("(total)").alias("ext"), "files", F.lit(None).cast("string").alias("label")
    )
    return counted.unionByName(total)


@query
def upload_classify(spark, sf_dir):
    return uploads.classify_files(table(spark, sf_dir, "inventory").select("file_path")).withColumn(
        "label", extension_label(F.col("ext"))
    )


@query
def upload_select(spark, sf_dir):
    return uploads.select_new(table(spark, sf_dir, "inventory"), table(spark, sf_dir, "ledger"))


def _attempts(spark, sf_dir):
    return uploads.type_outcomes(table(spark, sf_dir, "responses")).drop("doc_id")


@query
def upload_attempts(spark, sf_dir):
    return _attempts(spark, sf_dir).drop("ts")


@query
def upload_outcomes(spark, sf_dir):
    planned = uploads.classify_files(table(spark, sf_dir, "inventory"))
    sent = _attempts(spark, sf_dir).select("run_id", "file_path", "status", "reason")
    return uploads.outcome_counts(sent.unionByName(uploads.skipped_attempts(planned, run_id="r1")))


@query
def ledger_merge(spark, sf_dir):
    ledger = table(spark, sf_dir, "ledger")
    added = uploads.merge_ledger(ledger, _attempts(spark, sf_dir)).select(
        "file_path", F.date_format("first_uploaded_at", "yyyy-MM-dd").alias("first_day")
    )
    return ledger.withColumn("first_day", F.lit(None).cast("string")).unionByName(added)


@query
def ledger_validate(spark, sf_dir):
    return uploads.dangling_entries(table(spark, sf_dir, "ledger"), table(spark, sf_dir, "present"))


@query
def retry_candidates(spark, sf_dir):
    return uploads.retry_candidates(_attempts(spark, sf_dir), table(spark, sf_dir, "present"))


# -- Logs ---------------------------------------------------------------------


def _event_lines(events: DataFrame) -> DataFrame:
    """Events as the log lines they stand for."""
    head = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    return events.select("event_id", F.concat(head, F.lit(" - INFO - "), F.col("message")).alias("value"))


def _event_log(spark, sf_dir):
    return logs.parse_log(_event_lines(table(spark, sf_dir, "event_log")))


def _shown(log: DataFrame) -> DataFrame:
    return log.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "level", "kind", "reason", "file_path")


@query
def log_parse(spark, sf_dir):
    return _shown(_event_log(spark, sf_dir))


@query
def log_success(spark, sf_dir):
    return logs.distinct_paths(_event_log(spark, sf_dir), "success", ["event_id"]).select(
        "file_path", F.col("first.event_id").alias("first_line"), "lines"
    )


@query
def log_tail(spark, sf_dir):
    return logs.tail(_event_log(spark, sf_dir), ["ts", "event_id"], 10).select("event_id", "message")


def _analysis(spark, sf_dir):
    """The documents over a run's log and its retry's, one log and one list of failures each."""
    log, failures = table(spark, sf_dir, "run_log"), table(spark, sf_dir, "failures")
    each = lambda df: [df.filter(F.col("source") == i).drop("source") for i in (0, 1)]
    return analysis.analyse(
        each(log), each(failures), table(spark, sf_dir, "present"), GENERATED, OUT, ("r.csv", "s.json", "a.txt", "b.txt")
    )


@query
def run_log_parse(spark, sf_dir):
    log = logs.parse_log(table(spark, sf_dir, "run_log"))
    return log.select("source", F.col("line_no"), "kind", "reason", "file_path", "file_size", "upload_duration")


@query
def failure_reasons(spark, sf_dir):
    return report.failure_reasons(table(spark, sf_dir, "failures"))


@query
def upload_rate(spark, sf_dir):
    return report.success_rate(_attempts(spark, sf_dir))


@query
def upload_report(spark, sf_dir):
    return _analysis(spark, sf_dir)["report"]


@query
def upload_summary(spark, sf_dir):
    return _analysis(spark, sf_dir)["summary"]


@query
def upload_stats(spark, sf_dir):
    return _analysis(spark, sf_dir)["stats"]


# -- Runs ---------------------------------------------------------------------


@query
def runs_list(spark, sf_dir):
    latest = runs.latest_status(table(spark, sf_dir, "run_events"), F.struct("ts", "event_id"))
    return runs.newest_first(latest).select(
        "job_id", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"), "status", "events"
    )


@query
def duration_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", duration_text(F.col("value") * 60).alias("duration"))


# -- Written and read again ---------------------------------------------------


@query
def seeds_round_trip(spark, sf_dir):
    path = scratch_path(spark, "live-seeds")
    append_live_seeds(seed_liveness(spark, sf_dir), path)
    return read_seed_list(spark, path).select("url")


@query
def ledger_round_trip(spark, sf_dir):
    """Two runs: each appends what the ledger, as read from storage, does not hold yet."""
    path = scratch_path(spark, "ledger")
    append_ledger(table(spark, sf_dir, "ledger").withColumn("first_uploaded_at", F.lit(None).cast("timestamp")), path)
    append_ledger(uploads.merge_ledger(read_ledger(spark, path), _attempts(spark, sf_dir)), path)
    return read_ledger(spark, path).select("file_path", F.date_format("first_uploaded_at", "yyyy-MM-dd").alias("first_day"))


@query
def attempts_round_trip(spark, sf_dir):
    path = scratch_path(spark, "attempts")
    attempts = _attempts(spark, sf_dir)
    append_attempts(attempts, path)
    return spark.read.schema(attempts.schema).parquet(path).drop("ts")


@query
def log_round_trip(spark, sf_dir):
    """Lines written as a folder of text files of unlike size, and read in order."""
    path = scratch_path(spark, "log")
    lines = table(spark, sf_dir, "run_log").repartitionByRange(4, "source", "line_no", "value").sortWithinPartitions("source", "line_no", "value")
    lines.select("value").write.text(path)
    return read_log(spark, path)


@query
def failures_round_trip(spark, sf_dir):
    path = scratch_path(spark, "failures")
    table(spark, sf_dir, "failures").drop("source", "line_no").write.json(path)
    return read_failures(spark, path).groupBy("file_path", "reason", "response", "file_size").agg(F.count("*").alias("n"))


@query
def runs_round_trip(spark, sf_dir):
    """A JSON document per run."""
    path = scratch_path(spark, "runs")
    events = table(spark, sf_dir, "run_events").groupBy("job_id").agg(
        F.date_format(F.min_by("ts", "event_id"), "yyyy-MM-dd").alias("start_time"), F.max_by("status", "event_id").alias("status")
    )
    document = F.to_json(F.struct(*events.columns))
    export_tree(events.select(F.lit("runs").alias("dir"), F.concat("job_id", F.lit(".json")).alias("filename"), F.lit(0).alias("part"), document.alias("text")), path)
    return read_runs(spark, f"{path}/runs").select("job_id", "start_time", "status")


@query
def tree_round_trip(spark, sf_dir):
    """Pages as a tree of files, each of two parts, listed and read again."""
    path = scratch_path(spark, "tree")
    paths = _markdown_paths(spark, sf_dir).withColumn("fifo_rank", F.col("page_id"))
    html = table(spark, sf_dir, "pages").select("page_id", "html").filter("html <> ''")
    kept, _ = site_run.settle_paths(paths.join(html, "page_id"))
    texts = F.array(F.concat("url", F.lit("\n")), F.col("html"))
    export_tree(kept.select("dir", "filename", F.posexplode(texts).alias("part", "text")), path)
    root = re.sub("^file:/+", "/", path) + "/"
    listed = read_inventory(spark, path, below=root)
    read = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"), F.lit(root)).alias("file_path"), F.md5("value").alias("content")
    )
    return listed.join(read, "file_path")


@query
def inventory_diff(spark, sf_dir):
    """Two listings, each written as a table; the later one lacks files, has others and other sizes."""
    root = scratch_path(spark, "listings")
    later = table(spark, sf_dir, "present").select("file_path", F.when(F.col("size") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    added = table(spark, sf_dir, "ledger").filter("file_path LIKE 'corpus/gone/%'").select("file_path", F.lit(1).alias("size"))
    table(spark, sf_dir, "inventory").select("file_path", "size").write.parquet(f"{root}/version=1")
    later.unionByName(added).write.parquet(f"{root}/version=2")
    return uploads.inventory_diff(spark.read.parquet(f"{root}/version=1"), spark.read.parquet(f"{root}/version=2"))


# -- Streams ------------------------------------------------------------------


def _stream(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _streamed_log(spark, sf_dir):
    from .derived import DERIVED

    return logs.parse_log(_event_lines(spark.sql(DERIVED["event_log"], events=_stream(spark, sf_dir, "events"))))


@query
def stream_log(spark, sf_dir):
    """Log files that a query follows in two runs: the second reads what has come since."""
    root = scratch_path(spark, "stream-log")
    lines = _event_lines(table(spark, sf_dir, "event_log")).select(F.col("event_id"), F.concat("value", F.lit("\t"), F.col("event_id")).alias("value"))
    followed = follow.tail_lines(spark, f"{root}/in").select(
        F.substring_index("value", "\t", -1).cast("long").alias("event_id"), F.substring_index("value", "\t", 1).alias("value")
    )
    for late in (False, True):
        lines.filter((F.col("event_id") % 3 == 0) == F.lit(late)).select("value").write.mode("append").text(f"{root}/in")
        follow.write_stream(_shown(logs.parse_log(followed)), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


@query
def stream_counts(spark, sf_dir):
    root = scratch_path(spark, "stream-counts")
    counts = follow.running_counts(_streamed_log(spark, sf_dir), "1 day")
    follow.write_stream(counts, f"{root}/out", f"{root}/state", "complete")
    return spark.read.parquet(f"{root}/out")


def _delivered(spark, sf_dir):
    """The folders of attempts and ledger after a stream of three batches, the second of them done again."""
    root = scratch_path(spark, "stream-select")
    ledger, attempts = f"{root}/ledger", f"{root}/attempts"
    append_ledger(table(spark, sf_dir, "ledger").withColumn("first_uploaded_at", F.lit(None).cast("timestamp")), ledger)
    files = table(spark, sf_dir, "inventory").select("file_path", "size")
    files.repartitionByRange(3, "file_path").write.parquet(f"{root}/in")
    arriving = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    when = F.lit("2025-01-03 00:00:00").cast("timestamp")

    def send(chosen: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        return chosen.select(
            F.lit("s").alias("run_id"), when.alias("ts"), "file_path", F.lit(200).alias("http_status"), none.alias("response"), none.alias("error"),
            "size", F.lit(0.0).alias("started"), F.lit(1.0).alias("ended"),
        )

    follow.stream_delivery(arriving, send, ledger, attempts, "s", when, f"{root}/state")
    again = materialize(spark.read.parquet(f"{attempts}/batch=s-1").select("file_path", F.col("file_size").alias("size")), "again")
    deliver(again, send, ledger, attempts, "s", when, "1")
    return attempts, ledger


@query
def stream_select(spark, sf_dir):
    attempts, _ = _delivered(spark, sf_dir)
    sent = spark.read.parquet(attempts).filter("status = 'success'").select("file_path")
    return uploads.classify_files(sent).select("file_path", "ext", "mime")


@query
def stream_ledger(spark, sf_dir):
    _, ledger = _delivered(spark, sf_dir)
    return read_ledger(spark, ledger).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
