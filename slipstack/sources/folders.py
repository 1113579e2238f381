"""Source of the files below a folder: path, size, time and the first bytes, nothing else of a file is read.

Spark's own source of whole files leaves out empty ones, which intake has to refuse with a reason, and opens
every file whose head is asked for. Here the driver only lists the folders right below the given one; tasks list
what is in them, a folder being dealt to several tasks by a hash of the names, and read a byte range of each
file that the size gate lets through.

As a stream a file belongs to the micro-batch in whose span of modification times it falls. Files younger than
``settle`` seconds wait, so that a span is complete when it is read.

Options: ``path``; ``most_bytes`` (files over it are not opened and have no head); ``head`` (bytes to read);
``slices`` (tasks per folder); ``settle``.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from slipstack import fixed
from slipstack.sources.store import opened

FORMAT = "slipstack_listing"
SCHEMA = "path string, size bigint, modified timestamp, head_hex string"
FIELDS = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("head_hex", pa.string())])
#: Bytes that tell a format.
HEAD = 12
#: Rows of an Arrow batch.
BATCH = 1000


@dataclass
class Part(InputPartition):
    """A folder below the given one (empty: itself), a share of its names and a span of times in nanoseconds."""

    folder: str
    share: int
    after: int | None
    upto: int | None


class _Folders:
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.most = int(options.get("most_bytes", fixed.MAX_DOCUMENT_BYTES))
        self.head, self.slices = int(options.get("head", HEAD)), int(options.get("slices", 4))
        self.settle = float(options.get("settle", 5))

    def parts(self, after: int | None = None, upto: int | None = None) -> list[Part]:
        system, root = opened(self.path)
        below = system.get_file_info(fs.FileSelector(root))
        # What Spark hides, it hides too: unfinished output begins with an underscore or a dot.
        names = [f.base_name for f in below if f.type == fs.FileType.Directory and f.base_name[0] not in "._"]
        return [Part(name, i, after, upto) for name in ["", *sorted(names)] for i in range(self.slices)]

    def rows(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.path)
        found = system.get_file_info(fs.FileSelector(f"{root}/{part.folder}" if part.folder else root, recursive=bool(part.folder), allow_not_found=True))
        kept = []
        for info in found:
            inside = info.path[len(root) :].lstrip("/")
            hidden = any(step[0] in "._" for step in inside.split("/"))
            mine = zlib.crc32(inside.encode()) % self.slices == part.share
            late = (part.after is not None and info.mtime_ns <= part.after) or (part.upto is not None and info.mtime_ns > part.upto)
            if info.type != fs.FileType.File or hidden or not mine or late:
                continue
            kept.append((f"{self.path}/{inside}", info.size, info.mtime, self._head(system, info)))
            if len(kept) == BATCH:
                yield self._batch(kept)
                kept = []
        if kept:
            yield self._batch(kept)

    def _head(self, system: fs.FileSystem, info: fs.FileInfo) -> str | None:
        if info.size > self.most:
            return None
        try:
            with system.open_input_file(info.path) as file:
                return file.read_at(min(self.head, info.size), 0).hex().upper()
        except FileNotFoundError:  # it went between listing and reading
            return None

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FIELDS)], schema=FIELDS)


class Reader(DataSourceReader):
    def __init__(self, folders: _Folders):
        self.folders = folders

    def partitions(self) -> list[Part]:
        return self.folders.parts()

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.folders.rows(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, folders: _Folders):
        self.folders = folders

    def initialOffset(self) -> dict:
        return {"ns": -1}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns() - int(self.folders.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.folders.parts(start["ns"], end["ns"])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.folders.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(_Folders(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(_Folders(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Listing)
