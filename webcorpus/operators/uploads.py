"""Delivery of files: what is new, what may be sent, what came of it, what to retry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.fixed import DELIVERABLE_MIME, IMAGE_LABELS
from ..functions.once import with_once
from ..functions.paths import extension, lookup
from ..schemas import LEDGER_DOCUMENT


def classify_files(
    files: DataFrame, deliverable: dict[str, str] = DELIVERABLE_MIME, images: tuple[str, ...] = tuple(IMAGE_LABELS)
) -> DataFrame:
    """Add ext, status (eligible or skipped), reason and mime, by extension only."""
    ext = F.col("ext")
    known = ext.isin(*deliverable)
    return with_once(files, ext=extension(F.col("file_path"))).select(
        "*",
        F.when(~ext.isin(*images) & known, "eligible").otherwise("skipped").alias("status"),
        F.when(ext.isin(*images), "image file").when(~known, "unsupported file type").alias("reason"),
        F.when(~ext.isin(*images), lookup(deliverable, ext)).alias("mime"),
    )


def inventory_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_path, change) between two listings (file_path, size): added, removed or resized. Unchanged files are left out."""
    old, new = before.select("file_path", F.col("size").alias("_old")), after.select("file_path", F.col("size").alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "resized")
    )
    return old.join(new, "file_path", "full").select("file_path", change.alias("change")).filter("change IS NOT NULL")


def select_new(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files not yet in the ledger, by exact path."""
    return files.join(ledger.select("file_path"), "file_path", "left_anti")


def type_outcomes(responses: DataFrame) -> DataFrame:
    """Responses (run_id, file_path, http_status, response, error, size, started, ended) as attempts."""
    code = F.col("http_status")
    sent = code == 200
    return responses.select(
        *[c for c in responses.columns if c not in ("http_status", "response", "error", "size", "started", "ended")],
        F.when(sent, "success").otherwise("failed").alias("status"),
        F.when(sent, None)
        .when(code.isNotNull(), F.concat(F.lit("API Error: "), code.cast("string")))
        .otherwise(F.col("error"))
        .alias("reason"),
        F.when(code.isNotNull() & ~sent, F.col("response")).alias("response"),
        F.coalesce("size", F.lit(0)).cast("long").alias("file_size"),
        F.when(sent, F.round(F.col("ended") - F.col("started"), 2)).alias("upload_duration"),
    )


def skipped_attempts(classified: DataFrame, **run) -> DataFrame:
    """Files that are never sent, as attempts of the run given by constant columns."""
    return classified.filter("status = 'skipped'").select(
        *[F.lit(value).alias(name) for name, value in run.items()], "file_path", "status", "reason"
    )


def outcome_counts(attempts: DataFrame) -> DataFrame:
    def of(status):
        return F.count_if(F.col("status") == status).alias(status)

    return attempts.groupBy("run_id").agg(of("success"), of("failed"), of("skipped"), F.count("*").alias("total"))


def merge_ledger(ledger: DataFrame, attempts: DataFrame) -> DataFrame:
    """Rows to append: successes of any run that the ledger does not hold yet."""
    first = (
        attempts.filter("status = 'success'").groupBy("file_path").agg(F.min("ts").alias("first_uploaded_at"))
    )
    return first.join(ledger.select("file_path"), "file_path", "left_anti")


def is_ledger_document(df: DataFrame) -> bool:
    """Whether a JSON document read as ``df`` has the ledger's keys and a list of files."""
    fields = {f.name: f.dataType for f in df.schema}
    return all(name in fields for name in LEDGER_DOCUMENT.names) and isinstance(
        fields["uploaded_files"], T.ArrayType
    )


def dangling_entries(ledger: DataFrame, inventory: DataFrame) -> DataFrame:
    """Ledger entries whose file is gone: reported, not dropped."""
    return ledger.join(inventory.select("file_path"), "file_path", "left_anti")


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """The last attempt of each file; repeats collapse before the shuffle."""
    rest = [c for c in attempts.columns if c not in ("file_path", "ts")]
    return (
        attempts.groupBy("file_path").agg(F.max(F.struct("ts", *rest)).alias("last")).select("file_path", "last.*")
    )


def retry_candidates(attempts: DataFrame, inventory: DataFrame) -> DataFrame:
    """Files whose last attempt failed. One that has vanished is failed for that reason, the rest are eligible."""
    failed = latest_attempts(attempts).filter("status = 'failed'")
    present = inventory.select("file_path", F.lit(True).alias("_present"))
    checked = failed.join(present, "file_path", "left")
    sendable = classify_files(
        checked.select("file_path", F.col("run_id").alias("failed_in"), F.col("reason").alias("failed_for"), "_present")
    ).filter(F.col("_present").isNull() | (F.col("status") == "eligible"))
    gone = F.col("_present").isNull()
    return sendable.select(
        "file_path",
        "failed_in",
        "failed_for",
        F.when(gone, "failed").otherwise("eligible").alias("status"),
        F.when(gone, "File no longer exists").alias("reason"),
        F.when(~gone, F.col("mime")).alias("mime"),
    )


def failure_details(failures: DataFrame) -> DataFrame:
    """Failure records with their defaults filled in."""
    return failures.select(
        *[c for c in failures.columns if c not in ("file_path", "reason", "response", "file_size")],
        F.coalesce("file_path", F.lit("Unknown file")).alias("file_path"),
        F.coalesce("reason", F.lit("Unknown reason")).alias("reason"),
        F.coalesce("response", F.lit("")).alias("response"),
        F.coalesce("file_size", F.lit(0)).cast("long").alias("file_size"),
    )


def failure_reasons(failures: DataFrame) -> DataFrame:
    return failure_details(failures).groupBy("reason").agg(F.count("*").alias("files"))
