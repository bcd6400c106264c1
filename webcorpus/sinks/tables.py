"""Writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed import REPORT_COLUMNS
from ..schemas import LEDGER
from .file_tree import FileTree


def write_markdown(markdown: DataFrame, path: str) -> None:
    """The corpus as a table, clustered by host.

    Ranges of (host, dir, filename) make the files: a large host spans several,
    small ones share one, and a filter on host skips the rest by their
    statistics. A folder per host would be millions of tiny files.
    """
    place = ["host", "dir", "filename"]
    placed = markdown.withColumn("host", F.element_at(F.split("dir", "/"), 2))
    placed.repartitionByRange(*place).sortWithinPartitions(*place).write.mode("overwrite").parquet(path)


def export_tree(parts: DataFrame, root: str) -> None:
    """The corpus as a tree of UTF-8 files under ``root``, on storage that all executors share.

    ``parts``: dir, filename, part, text. A file's parts arrive in order in one
    task and are written one at a time, so no file is held in memory. See
    ``file_tree`` for what a failed task or job leaves behind.
    """
    parts.sparkSession.dataSource.register(FileTree)
    ordered = parts.select("dir", "filename", "part", "text").repartition("dir", "filename")
    ordered.sortWithinPartitions("dir", "filename", "part").write.format("file_tree").mode("append").save(root)


def document_parts(kept: DataFrame, sections: DataFrame) -> DataFrame:
    """Markdown of kept pages and their file sections as the parts of one file each."""
    body = kept.filter("markdown IS NOT NULL").select("dir", "filename", F.lit(-1).cast("long").alias("part"), F.col("markdown").alias("text"))
    lists = sections.join(kept.select("site", "page_id", "dir", "filename"), ["site", "page_id"]).select(
        "dir", "filename", "part", F.col("section").alias("text")
    )
    return body.unionByName(lists)


def append_live_seeds(seeds: DataFrame, path: str) -> None:
    seeds.orderBy("seed_id").select("url").write.mode("append").text(path)


def append_attempts(attempts: DataFrame, path: str, batch: str | None = None) -> None:
    """Attempts, one folder per run; current failures are a query over all of them.

    A batch that is named owns its folder, so repeating it replaces its own rows only.
    """
    if batch is None:
        attempts.write.mode("append").partitionBy("run_id").parquet(path)
    else:
        attempts.write.mode("overwrite").partitionBy("run_id").parquet(f"{path}/batch={batch}")


def append_ledger(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Add a batch to the ledger. A batch that is named owns its folder, so repeating it replaces its own rows only."""
    rows.select(*LEDGER.names).write.mode("overwrite").parquet(f"{path}/batch={batch or uuid.uuid4().hex}")


def write_report(report: DataFrame, path: str) -> None:
    """CSV with a header, successes first, in the order of the rows' place columns."""
    places = [c for c in report.columns if c not in REPORT_COLUMNS]
    report.orderBy(*places).select(*REPORT_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Rows (section, ord, line) as text; the part files in name order are the document."""
    lines.orderBy("section", "ord").select("line").write.mode("overwrite").text(path)
