"""Logs and deliveries as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.logs import parse_log
from ..plans.delivery_run import deliver
from .log_tail import LogTail


def tail_lines(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Lines (file, offset, value) of a log file, or of every log file in a folder, and those appended later.

    With ``last`` a first start skips all but that many lines of each file.
    """
    spark.dataSource.register(LogTail)
    lines = spark.readStream.format("log_tail").option("path", path)
    if last is not None:
        lines = lines.option("last", last)
    return lines.load()


def follow_log(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """The same lines, parsed."""
    return parse_log(tail_lines(spark, path, last))


def running_counts(log: DataFrame, delay: str) -> DataFrame:
    """Paths per kind, each path counted once per kind.

    A repeat is recognised as long as it comes within ``delay`` of the first;
    that bounds the state kept.
    """
    seen = (
        log.filter("kind <> 'other'")
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["file_path", "kind"])
    )
    return seen.groupBy("kind").agg(F.count("*").alias("files"))


def write_stream(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", every: str | None = None
) -> StreamingQuery:
    """Run a stream into a Parquet folder: over what is available now, or on and on, a batch ``every`` interval.

    Append output uses the exactly-once file sink. Complete output replaces the
    folder with the newest totals.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    if not every:
        query.awaitTermination()
    return query


def stream_delivery(
    inventory: DataFrame, send: Callable[[DataFrame], DataFrame], ledger: str, attempts: str, run_id: str, ts, checkpoint: str
) -> None:
    """Deliver the files that arrive, batch by batch: those not in the ledger and of a sendable type.

    Each batch appends to the ledger what got through, so later batches and
    other runs leave it out. A batch that is repeated after a failure replaces
    its own rows of attempts and ledger.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        deliver(batch.dropDuplicates(["file_path"]), send, ledger, attempts, run_id, ts, str(batch_id))

    (
        inventory.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(one)
        .start()
        .awaitTermination()
    )
