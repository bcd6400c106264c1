"""Schemas of the tables exchanged between stages."""

from pyspark.sql import types as T


_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(),
    "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    """``name type, ...``; read without a session, so that importing needs none."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in map(str.split, columns.split(", "))])


SEEDS = _struct("seed_id long, url string")
PROBES = _struct("url string, head_status int, get_status int")
ROBOTS = _struct("origin string, fetch_status int, body string")
PAGES = _struct("page_id long, url string, html string")
FILES = _struct("site string, file_url string, content_type string")
INVENTORY = _struct("file_path string, size long")
RESPONSES = _struct(
    "run_id string, ts timestamp, file_path string, http_status int, response string, error string, "
    "size long, started double, ended double"
)
ATTEMPTS = _struct(
    "run_id string, ts timestamp, file_path string, status string, reason string, response string, "
    "file_size long, upload_duration double"
)
FAILURES = _struct(
    "status string, reason string, response string, file_path string, file_size long, upload_duration double"
)
LEDGER = _struct("file_path string, first_uploaded_at timestamp")
LEDGER_DOCUMENT = _struct("version long, last_run_timestamp string, uploaded_files array<string>")
RUNS = _struct(
    "job_id string, start_time string, cmd_args array<string>, log_file string, status string, pid long"
)
RUN_EVENTS = _struct("job_id string, ts timestamp, status string")
CRAWL = _struct("site string, url string, depth int, fifo_rank long, page_id long")
