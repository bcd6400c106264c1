"""Session helpers: where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_passing: ContextVar[list[str] | None] = ContextVar("_passing", default=None)  # tables written for the innermost ``settled``


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table, on storage every executor sees.

    The root is the cluster's ``spark.checkpoint.dir``. Only a local session,
    where driver and executors share one disk, may run without that setting.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        _local_root = _local_root or tempfile.mkdtemp(prefix="webcorpus-")
        root = _local_root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once and continue from the written table.

    Cuts the lineage and survives executor loss; unlike a checkpointed RDD the
    Parquet copy is still column-pruned by whatever reads it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``materialize`` for a result whose making writes tables itself: they are deleted once it is written.

    Nothing else may read what ``make`` writes.
    """
    passing: list[str] = []
    before = _passing.set(passing)
    try:
        df = make()
    finally:
        _passing.reset(before)
    result = materialize(df, name)
    for path in passing:
        _delete(df.sparkSession, path)
    return result


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)  # the file systems that Spark writes to
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
