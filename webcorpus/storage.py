"""Files on any storage that Arrow reaches: local, HDFS, S3, GCS."""

from __future__ import annotations

import re
import sys

import pyarrow.fs as pafs
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a URI or a local path."""
    if local := re.fullmatch("(?:file:/+)?(/?[^:]*)", path):
        return pafs.LocalFileSystem(), "/" + local[1].lstrip("/") if path.startswith("file:") else local[1]
    return pafs.FileSystem.from_uri(path)
