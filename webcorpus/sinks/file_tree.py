"""A sink that writes rows as a tree of text files, with a manifest.

Rows (dir, filename, part, text) come clustered by file and in order of part; a
file is written under a hidden name and moved to its place when it is whole, so
a task that dies leaves no partial file under a real name. Each task lists its
files in a part of the job's manifest. Commit writes ``_manifest/<job>.json``,
which names those parts; abort removes them. A file belongs to the tree when a
committed manifest lists it.
"""

from __future__ import annotations

import json
import posixpath
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..storage import open_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class FileTree(DataSource):
    """``path``: the root, on storage that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def writer(self, schema, overwrite: bool) -> FileTreeWriter:
        return FileTreeWriter(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    manifest: str | None
    files: int
    size: int


class FileTreeWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, root = open_path(self.root)
        task, listed, size, made = uuid.uuid4().hex, [], 0, set()
        target = out = hidden = None

        def settle() -> None:
            out.close()
            system.move(hidden, target)
            listed.append(target[len(root) :].lstrip("/"))

        try:
            for row in rows:
                path = posixpath.join(root, row["dir"], row["filename"])
                if path != target:
                    if out:
                        settle()
                    folder = posixpath.dirname(path)
                    if folder not in made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    target, hidden = path, posixpath.join(folder, f".{posixpath.basename(path)[:100]}.{task}")
                    out = system.open_output_stream(hidden)
                data = row["text"].encode()
                size += len(data)
                out.write(data)
            if out:
                settle()
                out = None
        finally:
            if out:
                out.close()
                system.delete_file(hidden)
        if not listed:
            return Written(None, 0, 0)
        folder = posixpath.join(root, "_manifest", self.job)
        system.create_dir(folder, recursive=True)
        manifest = posixpath.join(folder, f"{task}.txt")
        with system.open_output_stream(manifest) as lines:
            lines.write("".join(f"{name}\n" for name in listed).encode())
        return Written(posixpath.join("_manifest", self.job, f"{task}.txt"), len(listed), size)

    def commit(self, messages: list) -> None:
        system, root = open_path(self.root)
        done = [m for m in messages if m and m.manifest]
        system.create_dir(posixpath.join(root, "_manifest"), recursive=True)
        summary = {"files": sum(m.files for m in done), "bytes": sum(m.size for m in done), "parts": sorted(m.manifest for m in done)}
        hidden = posixpath.join(root, "_manifest", f".{self.job}")
        with system.open_output_stream(hidden) as out:
            out.write(json.dumps(summary).encode())
        system.move(hidden, posixpath.join(root, "_manifest", f"{self.job}.json"))

    def abort(self, messages: list) -> None:
        system, root = open_path(self.root)
        for message in messages:
            if message and message.manifest:
                system.delete_file(posixpath.join(root, message.manifest))
