"""Analysis of delivery logs: report, summary and statistics document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.logs import parse_log, union_logs
from ..operators.report import report_rows, stats_lines, success_rate, summary_lines
from ..session import materialize

ORDER = ["source", "line_no"]


def analyse(
    logs: list[DataFrame],
    failures: list[DataFrame],
    inventory: DataFrame,
    generated: str,
    directory: str = "corpus",
    outputs: tuple[str, str, str, str] = ("upload_report.csv", "upload_stats.json", "upload_log.txt", "retry_upload_log.txt"),
) -> dict[str, DataFrame]:
    """``logs``: line_no, value, first run first; ``failures``: failure records with line_no.

    The logs are parsed once; every document is built from the parsed table.
    """
    parsed = parse_log(union_logs(*logs))
    log = materialize(parsed.select(*ORDER, "kind", "file_path", "file_size", "upload_duration"), "log")
    failed = union_logs(*failures)
    return {
        "report": report_rows(log, failed, inventory, ORDER),
        "summary": summary_lines(log, failed, inventory, ORDER, generated, outputs, directory),
        "stats": stats_lines(log, failed, inventory, ORDER, generated),
        "rate": success_rate(log.select("file_path", F.col("kind").alias("status"))),
    }
