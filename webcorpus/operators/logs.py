"""Delivery log lines: classify, extract, count, tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.once import with_once

# The line layout and the markers of each kind of message.
LINE = "(?s)^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3}) - ([A-Z]+) - (.*)$"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"
SUCCESS, FAILED, ERROR = "Successfully uploaded", "Failed to upload", "Error uploading"
SKIPPED, UNSUPPORTED = "Skipping", "Unsupported file type"

_SIZE = "(?: [(]([0-9]+) bytes[)])?"


def parse_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add ts, level, message, kind, reason, file_path, file_size and upload_duration.

    ``kind`` is success, failed, skipped or other, by the marker that the
    message begins with: a response quoting another marker doesn't change it.
    The path excludes a trailing size and time. A marker not followed
    by a path, such as the counts at the end of a run, is ``other``.
    """
    lines = with_once(lines, _head=F.array(*[F.regexp_extract(value, LINE, i) for i in (1, 2, 3)]))
    time, level, rest = (F.col("_head")[i] for i in range(3))
    lines = with_once(
        lines,
        ts=F.try_to_timestamp(F.when(time != "", time), F.lit(TIME_FORMAT)),
        level=F.nullif(level, F.lit("")),
        message=F.btrim(F.when(time == "", F.col(value)).otherwise(rest)),
    ).drop("_head")
    text = F.col("message")

    def found(case, reason, pattern, groups):
        values = [F.regexp_extract(text, pattern, i) for i in range(1, groups + 1)]
        return F.array(F.lit(case), reason, *values, *[F.lit("")] * (3 - groups))

    none = F.lit("")
    path = f"(.+?){_SIZE}"
    skip = F.lower(F.regexp_extract(text, f"^{SKIPPED} *([^:]*):", 1))
    parts = (
        F.when(text.startswith(SUCCESS), found("success", none, f"(?s)^{SUCCESS} {path}(?: in ([0-9.]+)s)?$", 3))
        .when(text.startswith(FAILED), found("failed", none, f"(?s)^{FAILED} {path}(?:[.] Status: .*)?$", 2))
        .when(text.startswith(ERROR), found("failed", none, f"(?s)^{ERROR} {path}(?:: .*)?$", 2))
        .when(text.startswith(SKIPPED), found("skipped", skip, f"(?s)^{SKIPPED}[^:]*: *(.+)$", 1))
        .when(text.startswith(UNSUPPORTED), found("skipped", F.lit("unsupported file type"), f"(?s)^{UNSUPPORTED}: *(.+)$", 1))
        .otherwise(F.array(*[none] * 5))
    )
    lines = with_once(lines, _parts=parts)
    kind, reason, file_path, size, duration = (F.nullif(F.col("_parts")[i], none) for i in range(5))
    has_path = file_path.isNotNull()
    return lines.select(
        *[c for c in lines.columns if c != "_parts"],
        F.when(has_path, kind).otherwise("other").alias("kind"),
        F.when(has_path, reason).alias("reason"),
        file_path.alias("file_path"),
        size.cast("long").alias("file_size"),
        duration.cast("double").alias("upload_duration"),
    )


def union_logs(*logs: DataFrame) -> DataFrame:
    """Lines of several logs, first log first; ``source`` keeps which one a line is from."""
    tagged = [log.withColumn("source", F.lit(i)) for i, log in enumerate(logs)]
    out = tagged[0]
    for log in tagged[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out


def distinct_paths(log: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """Each path of one kind once, with the place it was first seen."""
    return (
        log.filter(F.col("kind") == kind)
        .groupBy("file_path")
        .agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("lines"))
    )


def tail(log: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The last ``n`` lines, in file order."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)
