"""Statistics and reports: per site, per extension, per outcome."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fixed import DELIVERABLE_LABELS, IMAGE_LABELS, REPORT_COLUMNS, REPORT_SKIPPED, REPORT_STATUS, SUMMARY
from ..functions.paths import extension_bucket, extension_label
from .uploads import failure_details, failure_reasons


def busy_seconds(fetches: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """(site, busy): seconds of each slice of time in which at least one fetch of the site ran.

    ``fetches``: site, started, ended in seconds. The union of a site's
    intervals is taken slice by slice, so a site with any share of the fetches
    is dealt by time; the sum of its rows is its busy time.
    """
    slices = F.sequence(F.floor(F.col("started") / slice_seconds), F.floor(F.col("ended") / slice_seconds))
    cut = fetches.filter("ended >= started").select("site", "started", "ended", F.explode(slices).alias("slice")).select(
        "site", "slice",
        F.greatest("started", F.col("slice") * slice_seconds).alias("started"),
        F.least("ended", (F.col("slice") + 1) * slice_seconds).alias("ended"),
    )
    earlier = Window.partitionBy("site", "slice").orderBy("started", "ended").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("ended") - F.greatest("started", F.coalesce(F.max("ended").over(earlier), F.col("started")))
    return cut.select("site", "slice", F.greatest(new, F.lit(0.0)).alias("busy")).groupBy("site", "slice").agg(F.sum("busy").alias("busy")).drop("slice")


def site_stats(seeds: DataFrame, pages: DataFrame, files: DataFrame, fetches: DataFrame | None = None) -> DataFrame:
    """Per site, and in total (``is_total`` = 1): websites, pages scraped and converted, files, and durations.

    ``pages``: site, converted (boolean). A site without pages has zeros.
    ``fetches`` (site, started, ended in seconds) gives duration_seconds, from
    the first start to the last end, and busy_seconds, with at least one fetch
    running; in total, busy_seconds is summed over the sites. Every input is
    counted per site before anything is joined.
    """
    rows = seeds.select("site", F.lit(1).alias("websites"))
    for more in (
        pages.select("site", F.lit(1).alias("scraped"), F.col("converted").cast("int").alias("converted")),
        files.select("site", F.lit(1).alias("downloaded")),
        *([] if fetches is None else [fetches.select("site", "started", "ended"), busy_seconds(fetches)]),
    ):
        rows = rows.unionByName(more, allowMissingColumns=True)
    counts = {"websites": "websites_processed", "scraped": "pages_scraped", "converted": "pages_converted", "downloaded": "files_downloaded"}
    aggregates = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in counts.items()]
    if fetches is not None:
        aggregates += [
            F.coalesce(F.max("ended") - F.min("started"), F.lit(0.0)).alias("duration_seconds"),
            F.coalesce(F.sum("busy"), F.lit(0.0)).alias("busy_seconds"),
        ]
    return rows.rollup("site").agg(F.grouping_id().cast("int").alias("is_total"), *aggregates)


def extension_histogram(inventory: DataFrame) -> DataFrame:
    ext = extension_bucket(F.col("file_path"))
    return (
        inventory.groupBy(ext.alias("ext"))
        .agg(F.count("*").alias("files"))
        .withColumn("label", extension_label(F.col("ext")))
    )


def success_rate(attempted: DataFrame) -> DataFrame:
    """One row: distinct successes, all failures, and the rate in percent (NULL when nothing was attempted)."""
    counts = attempted.agg(
        F.count_distinct(F.when(F.col("status") == "success", F.col("file_path"))).alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    total = F.col("succeeded") + F.col("failed")
    return counts.withColumn("rate", F.round(100 * F.try_divide("succeeded", total), 2))


def analysed(log: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """Successes and skips of a parsed log once each, in order of first appearance, and every failure line."""
    out = {}
    for kind in ("success", "skipped"):
        out[kind] = (
            log.filter(F.col("kind") == kind)
            .groupBy("file_path")
            .agg(F.min(F.struct(*order, "file_size", "upload_duration")).alias("first"))
            .select("file_path", "first.*")
        )
    out["failed"] = log.filter("kind = 'failed'").select("file_path", *order)
    return out


def report_rows(log: DataFrame, failures: DataFrame, inventory: DataFrame, order: list[str]) -> DataFrame:
    """The report: successes, then skips, then failures with their details.

    ``failures`` carries the ``order`` columns too. Sizes come from the
    inventory, 0 for a file that is gone.
    """
    parts = analysed(log, order)
    sizes = inventory.select("file_path", "size")

    def section(number, rows, status, *values):
        kinds = ("string", "string", "string", "string", "long", "double")
        values = (F.col("file_path"), F.lit(REPORT_STATUS[status]), *values)
        return rows.select(F.lit(number).alias("section"), *order, *[v.cast(k).alias(c) for v, k, c in zip(values, kinds, REPORT_COLUMNS, strict=True)])

    none, size, unknown = F.lit(""), F.coalesce("size", F.lit(0)), F.lit(None)
    return (
        section(1, parts["success"].join(sizes, "file_path", "left"), "success", none, none, size, F.col("upload_duration"))
        .unionByName(section(2, parts["skipped"].join(sizes, "file_path", "left"), "skipped", F.lit(REPORT_SKIPPED), none, size, unknown))
        .unionByName(section(3, failure_details(failures), "failed", F.col("reason"), F.col("response"), F.col("file_size"), unknown))
    )


def _line(section: int, ord_: Column | int, line: Column | str) -> list[Column]:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return [F.lit(section).alias("section"), as_col(ord_).cast("string").alias("ord"), as_col(line).alias("line")]


def summary_lines(
    log: DataFrame, failures: DataFrame, inventory: DataFrame, order: list[str], generated: str,
    outputs: tuple[str, str, str, str], directory: str,
) -> DataFrame:
    """The text summary as rows (section, ord, line); sorted by both it is the file.

    ``outputs`` names the CSV report, the JSON document and the two logs;
    ``directory`` is where the files lie.
    """
    parts = analysed(log, order)
    counts = (
        parts["success"].select(F.lit("s").alias("k"))
        .unionByName(parts["failed"].select(F.lit("f").alias("k")))
        .unionByName(parts["skipped"].select(F.lit("k").alias("k")))
        .agg(*[F.count_if(F.col("k") == k).alias(n) for k, n in (("s", "s"), ("f", "f"), ("k", "skip"))])
    )
    rate = F.round(100 * F.try_divide(F.col("s"), F.col("s") + F.col("f")), 2)
    head = [
        (1, 1, SUMMARY["title"]), (1, 2, SUMMARY["generated"] % generated), (1, 3, ""),
        (2, 1, SUMMARY["to_process"]), (2, 3, ""),
        (3, 1, SUMMARY["extensions"]),
        (5, 1, SUMMARY["results"]),
    ]
    tail = [
        (9, 2, ""), (9, 3, SUMMARY["details"]),
        (9, 4, SUMMARY["csv"] % outputs[0]), (9, 5, SUMMARY["json"] % outputs[1]),
        (9, 6, SUMMARY["logs"] % outputs[2:]),
    ]
    fixed = log.sparkSession.createDataFrame([(s, str(o), t) for s, o, t in head + tail], "section int, ord string, line string")
    results = counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("section"), F.lit(o).alias("ord"), text.alias("line"))
                    for s, o, text in (
                        (5, "2", F.format_string(SUMMARY["uploaded"], "s")),
                        (5, "3", F.format_string(SUMMARY["failed"], "f")),
                        (5, "4", F.format_string(SUMMARY["skipped"], "skip")),
                        (5, "5", F.format_string(SUMMARY["processed"], F.col("s") + F.col("f") + F.col("skip"))),
                        (5, "6", F.lit("")),
                        (6, "1", F.format_string(SUMMARY["rate"], rate)),
                        (6, "2", F.lit("")),
                        (9, "0", F.lit(SUMMARY["next"])),
                        (9, "1", F.when(F.col("f") > 0, SUMMARY["retry"])
                         .otherwise(SUMMARY["done"])),
                    )
                ]
            )
        ).alias("r"),
        (F.col("s") + F.col("f")).alias("n"),
    ).filter("r.section <> 6 OR n > 0").select("r.*")
    reasons = failure_reasons(failures)
    any_reason = failures.agg(F.count("*").alias("n")).filter("n > 0")
    return (
        fixed.unionByName(inventory.agg(F.count("*").alias("n")).select(*_line(2, 2, F.format_string(SUMMARY["total_files"], F.lit(directory), "n"))))
        .unionByName(extension_histogram(inventory).select(*_line(4, F.col("ext"), F.format_string(SUMMARY["extension"], "ext", "files"))))
        .unionByName(inventory.agg(F.count("*").alias("n")).select(*_line(5, "", "")))
        .unionByName(results)
        .unionByName(any_reason.select(*_line(7, 1, SUMMARY["reasons"])))
        .unionByName(reasons.select(*_line(8, F.col("reason"), F.format_string(SUMMARY["reason"], "reason", "files"))))
        .unionByName(any_reason.select(*_line(9, "", "")))
    )


def _quoted(col: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(col.alias("v"))), '(?s)^[{]"v":(.*)[}]$', 1)


def stats_lines(
    log: DataFrame, failures: DataFrame, inventory: DataFrame, order: list[str], generated: str
) -> DataFrame:
    """The statistics document as rows (section, ord, line); sorted by both, the lines are one JSON object.

    A line per file keeps the document's lists out of any single row. Every
    element after the first of its list starts with a comma; the first is found
    with a scalar subquery.
    """
    parts = analysed(log, order)
    width = "%020d"

    def elements(section, rows, ord_, text):
        rows = rows.select(ord_.alias("ord"), text.alias("text"))
        first = rows.agg(F.min("ord")).scalar()
        return rows.select(*_line(section, F.col("ord"), F.concat(F.when(F.col("ord") == first, "").otherwise(","), F.col("text"))))

    place = F.concat_ws("/", *[F.format_string(width, F.col(c)) for c in order])
    histogram, details = extension_histogram(inventory), failure_details(failures)
    pair = lambda key, n: F.concat(_quoted(F.col(key)), F.lit(": "), F.col(n).cast("string"))
    labels = lambda table: json.dumps(table, ensure_ascii=False)
    punctuation = [
        (10, '{"file_counts": {"extension_counts": {'),
        (14, f'"supported_extensions": {labels(DELIVERABLE_LABELS)}, "skip_extensions": {labels(IMAGE_LABELS)},'),
        (15, '"successful_files": ['), (17, '], "failed_files": ['), (19, '], "skipped_files": ['),
        (21, '], "failure_analysis": {"reason_counts": {'), (23, '}, "detailed_failures": ['),
        (25, f']}}, "timestamp": {json.dumps(generated)}}}'),
    ]
    fixed = log.sparkSession.createDataFrame([(s, "", t) for s, t in punctuation], "section int, ord string, line string")
    total = inventory.agg(F.count("*").alias("n")).select(*_line(13, "", F.format_string('}, "total_files": %d},', "n")))
    failure = F.to_json(F.struct("file_path", "reason", "response", "file_size"))
    return (
        fixed.unionByName(total)
        .unionByName(elements(11, histogram, F.col("ext"), pair("ext", "files")))
        .unionByName(elements(16, parts["success"], place, _quoted(F.col("file_path"))))
        .unionByName(elements(18, parts["failed"], place, _quoted(F.col("file_path"))))
        .unionByName(elements(20, parts["skipped"], place, _quoted(F.col("file_path"))))
        .unionByName(elements(22, failure_reasons(failures), F.col("reason"), pair("reason", "files")))
        .unionByName(elements(24, details, place, failure))
    )
