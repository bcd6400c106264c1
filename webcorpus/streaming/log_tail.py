"""A streaming source of the lines that are appended to log files.

The offset is a position in bytes for each file, so what is appended to a file
already seen is read, and a restart goes on where the last batch ended. Only
whole lines are taken: a line without its end waits for it. With the option
``last`` a query starts that many lines before the end of each file; later files
are read from their start. A file that has become shorter was replaced and is
read from its start. What a batch has of a file is split into ranges of
``_RANGE`` bytes, each line belonging to the range that it starts in.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..storage import open_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_RANGE = 32 << 20
_BLOCK = 1 << 20
_LINES = 10_000  # in a batch of rows


class LogTail(DataSource):
    """``path``: a file or a folder of files. ``last``: lines to start with, all without it."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def streamReader(self, schema) -> LogTailReader:  # noqa: N802
        return LogTailReader(self.options["path"], int(self.options["last"]) if "last" in self.options else None)


class LogTailReader(DataSourceStreamReader):
    def __init__(self, path: str, last: int | None):
        self.path, self.last = path, last
        self.known: dict[str, tuple[int, int]] = {}  # size of a file when last seen, and the end of its last whole line

    def _files(self) -> dict[str, int]:
        system, path = open_path(self.path)
        info = system.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            return {}
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(path))
        return {f.path: f.size for f in found if f.is_file and not f.base_name.startswith((".", "_"))}

    def initialOffset(self) -> dict:  # noqa: N802
        files = {} if self.last is None else {f: self._lines_before(f, n, self.last) for f, n in self._files().items()}
        return {"files": files, "initial": True}

    def latestOffset(self) -> dict:  # noqa: N802
        for file, size in self._files().items():
            if self.known.get(file, (None, 0))[0] != size:
                self.known[file] = (size, self._lines_before(file, size, 0))
        return {"files": {f: end for f, (_, end) in self.known.items()}, "initial": False}

    def _lines_before(self, file: str, size: int, lines: int) -> int:
        """The position ``lines`` whole lines before the end of the last one, reading backwards."""
        system, _ = open_path(self.path)
        with system.open_input_file(file) as data:
            ends, at = 0, size
            while at > 0:
                start = max(at - _BLOCK, 0)
                block = data.read_at(at - start, start)
                place = len(block)
                while (place := block.rfind(b"\n", 0, place)) >= 0:
                    ends += 1
                    if ends > lines:
                        return start + place + 1
                at = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = []
        for file, stop in sorted(end["files"].items()):
            begin = start["files"].get(file, 0)
            if begin > stop:  # replaced by a shorter file; or a first batch that is repeated after its start has moved
                begin = stop if start["initial"] else 0
            for a in range(begin, stop, _RANGE):
                found.append(InputPartition((file, begin, a, min(a + _RANGE, stop))))
        return found

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        file, begin, start, end = partition.value
        system, _ = open_path(self.path)
        with system.open_input_file(file) as data:
            at = start if start == begin else start - 1
            data.seek(at)
            skip, rest, lines, offsets = start > begin, b"", [], []
            while at < end:
                block = data.read(_BLOCK)
                if not block:
                    break
                *whole, rest_after = (rest + block).split(b"\n")
                for line in whole:
                    if at >= end:
                        break
                    if not skip:
                        lines.append(line.decode(errors="replace"))
                        offsets.append(at)
                    skip, at = False, at + len(line) + 1
                rest = rest_after
                if len(lines) >= _LINES:
                    yield self._batch(file, offsets, lines)
                    lines, offsets = [], []
            if lines:
                yield self._batch(file, offsets, lines)

    @staticmethod
    def _batch(file: str, offsets: list[int], lines: list[str]) -> pa.RecordBatch:
        columns = [pa.array([file] * len(lines)), pa.array(offsets, pa.int64()), pa.array(lines)]
        return pa.RecordBatch.from_arrays(columns, names=["file", "offset", "value"])

    def commit(self, end: dict) -> None:
        pass
