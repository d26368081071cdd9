"""New files under a local folder as a stream source whose tasks read whole folders.

Spark's file source lists the files of a batch twice in the driver and counts 4 MB for
opening one, which makes a task of every few small files. Here the names of new files go,
in parts of ``PART_FILES`` files or ``PART_BYTES`` bytes, to a list in the stream's
checkpoint folder; a part is a task. A segment of the list is what one look at the folder
found; the stream's offset is the number of segments, so a retried batch reads the same files.

As in Spark's source, a file counts once, by its path; hidden and empty files are left out;
folders are followed if they are called ``<name>=<value>``. Files of any age are taken.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from hashlib import blake2b

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.io import file_batches, is_hidden

#: Files, and bytes of files, of a part. The last file may go beyond the bytes.
PART_FILES = 1000
PART_BYTES = 32 << 20
#: The list of files in the checkpoint folder.
LIST = "listed-files"


class NewFiles(DataSource):
    """(path, content); options ``root`` and ``list`` are folders on a file system that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "vulnscan_new_files"

    def schema(self) -> str:
        return "path string, content binary"

    def streamReader(self, schema: StructType) -> NewFilesReader:
        return NewFilesReader(self.options["root"], self.options["list"])


class NewFilesReader(DataSourceStreamReader):
    def __init__(self, root: str, listed: str):
        self.root, self.listed = root, listed
        self.seen: set[bytes] | None = None

    def __reduce__(self) -> tuple:
        # tasks get the reader without the names it has seen
        return NewFilesReader, (self.root, self.listed)

    def initialOffset(self) -> dict:
        return {"segments": 0}

    def latestOffset(self) -> dict:
        known = _numbered(self.listed)
        if self.seen is None:
            self.seen = {_digest(name) for segment in known for part in _numbered(segment) for name in _names(part)}
        new = _write_parts(self._new_names(), self.listed)
        if new is not None:
            os.replace(new, os.path.join(self.listed, str(len(known))))
        return {"segments": len(known) + (new is not None)}

    def _new_names(self) -> Iterator[tuple[str, int]]:
        for name, size in _walk(self.root, ""):
            digest = _digest(name)
            if digest not in self.seen:
                self.seen.add(digest)
                yield name, size

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        segments = _numbered(self.listed)[start["segments"]:end["segments"]]
        return [InputPartition(part) for segment in segments for part in _numbered(segment)]

    def read(self, partition: InputPartition) -> Iterator:
        return file_batches(os.path.join(self.root, name) for name in _names(partition.value))


def _walk(root: str, inside: str) -> Iterator[tuple[str, int]]:
    """Names, from ``root`` on, and sizes of the files in a folder of it."""
    folders = []
    with os.scandir(os.path.join(root, inside)) as entries:
        for entry in entries:
            if is_hidden(entry.name):
                continue
            if entry.is_dir():
                if "=" in entry.name:
                    folders.append(f"{inside}{entry.name}/")
                continue
            try:
                size = entry.stat().st_size
            except FileNotFoundError:  # gone since the folder was read
                continue
            yield inside + entry.name, size
    for folder in sorted(folders):
        yield from _walk(root, folder)


def _digest(name: str) -> bytes:
    return blake2b(os.fsencode(name), digest_size=16).digest()


def _numbered(folder: str) -> list[str]:
    names = sorted((n for n in os.listdir(folder) if n.isdecimal()), key=int) if os.path.isdir(folder) else []
    return [os.path.join(folder, n) for n in names]


def _names(part: str) -> list[str]:
    with open(part, encoding="ascii") as f:
        return json.load(f)


def _write_parts(names: Iterator[tuple[str, int]], listed: str) -> str | None:
    """A folder of parts, which becomes a segment by its name; None without names."""
    folder = os.path.join(listed, f"new-{uuid.uuid4().hex}")
    part: list[str] = []
    n = size = 0

    def close() -> None:
        nonlocal part, n, size
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, str(n)), "w", encoding="ascii") as f:
            json.dump(part, f)
        part, n, size = [], n + 1, 0

    for name, length in names:
        part.append(name)
        size += length
        if len(part) == PART_FILES or size >= PART_BYTES:
            close()
    if part:
        close()
    return folder if n else None
