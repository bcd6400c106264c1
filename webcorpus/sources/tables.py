"""Readers. Every one returns a DataFrame with the schema of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.numbering import running_total
from ..operators.uploads import is_ledger_document
from ..schemas import FAILURES, INVENTORY, LEDGER, PAGES, RUNS


def _lines(spark: SparkSession, path: str, number: str) -> DataFrame:
    """Text lines with a number that orders them: by file name, then as in the file.

    Spark packs small files together by size and splits large ones, so the
    order of partitions is not that of files. A line's number within its
    partition orders the lines of one block, and the block's start those of a
    file; the blocks' sizes give each block its first number.
    """
    block = ["_file", "_block"]
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    sizes = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    firsts = running_total(sizes.withColumn("_all", F.lit(0)), ["_all"], F.col("_file"), block, "_end", F.col("_n"))
    placed = lines.join(firsts.select(*block, "_first", (F.col("_end") - F.col("_n")).alias("_start")), block)
    return placed.withColumn(number, F.col("_start") + F.col("_at") - F.col("_first")).drop(*block, "_at", "_first", "_start")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; nothing below it is listed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def read_seed_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line, as written: seed_id, url. See ``split_seeds`` and ``candidate_seeds``."""
    return _lines(spark, path, "seed_id").select("seed_id", F.col("value").alias("url"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value. A missing log is an empty one."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "line_no long, value string")
    return _lines(spark, path, "line_no").select("line_no", "value")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Archived pages with content."""
    return spark.read.schema(PAGES).parquet(path).filter("html IS NOT NULL AND html <> ''")


def read_inventory(spark: SparkSession, directory: str, below: str | None = None) -> DataFrame:
    """Every file under a directory: file_path, size. File contents are not read.

    ``below`` is the prefix to cut so that paths match the ledger's.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    path = F.regexp_replace("path", "^file:/+", "/")
    if below:
        path = F.when(path.startswith(below), F.substring(path, F.lit(len(below) + 1), F.length(path))).otherwise(path)
    return files.select(path.alias("file_path"), F.col("length").alias("size")).to(INVENTORY)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failure records: a JSON array, or one object per line. Missing or malformed: none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], FAILURES)
    first = spark.read.text(path).filter("trim(value) <> ''").first()
    by_line = first is not None and first["value"].strip().startswith("{") and first["value"].strip().endswith("}")
    return spark.read.schema(FAILURES).option("multiLine", not by_line).option("mode", "DROPMALFORMED").json(path)


def read_ledger_document(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's JSON document as rows. Missing, malformed or incomplete: empty."""
    empty = spark.createDataFrame([], LEDGER)
    if not _exists(spark, path):
        return empty
    document = spark.read.option("multiLine", True).json(path)
    if not is_ledger_document(document):
        return empty
    return document.select(
        F.explode("uploaded_files").alias("file_path"),
        F.try_to_timestamp("last_run_timestamp").alias("first_uploaded_at"),
    ).to(LEDGER)


def read_ledger(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """The ledger table; empty before the first run. ``without``: a batch to leave out, as one that is being repeated."""
    if not _exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(T.StructType([*LEDGER, T.StructField("batch", T.StringType())])).parquet(path)
    if without is not None:
        rows = rows.filter(F.col("batch") != without)
    return rows.select(*LEDGER.names)


def read_runs(spark: SparkSession, directory: str) -> DataFrame:
    """Every run's JSON document in a directory; malformed ones are left out."""
    runs = (
        spark.read.schema(RUNS).option("multiLine", True).option("mode", "DROPMALFORMED")
        .option("pathGlobFilter", "*.json").json(directory)
    )
    return runs.filter("status IS NOT NULL")
