"""Registry of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def reconcile(runs: DataFrame, alive: DataFrame) -> DataFrame:
    """A run recorded as running whose process is gone has completed."""
    known = alive.select("job_id", F.lit(True).alias("_alive"))
    status = F.when((F.col("status") == "running") & F.col("_alive").isNull(), "completed").otherwise(F.col("status"))
    return runs.join(known, "job_id", "left").withColumn("status", status).drop("_alive")


def latest_status(events: DataFrame, order: Column | str = "ts") -> DataFrame:
    """One row per run from its events: first time seen, last status, number of events."""
    return events.groupBy("job_id").agg(
        F.min("ts").alias("start_time"), F.max_by("status", order).alias("status"), F.count("*").alias("events")
    )


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last("start_time"), "job_id")


def find_run(runs: DataFrame, job_id: str) -> DataFrame:
    return runs.filter(F.col("job_id") == job_id)


def stop_run(runs: DataFrame, job_id: str) -> DataFrame:
    """The registry after stopping a run; only a running one changes."""
    hit = (F.col("job_id") == job_id) & (F.col("status") == "running")
    return runs.withColumn("status", F.when(hit, "stopped").otherwise(F.col("status")))
