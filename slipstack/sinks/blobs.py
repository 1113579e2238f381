"""A sink of whole files: one file per row, published by commit, dropped by abort.

Rows are ``name, content``. A task writes its files into a folder of its own attempt below ``_staging``; only the
folders that the driver has confirmed are moved into place, one move per task, so a lost or doubled attempt leaves
nothing behind. As a stream sink an epoch that is replayed replaces what it has published before.

    blobs.register(spark)
    refused.select("name", "content").write.format("slipstack_files").mode("append").save(path)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

from pyarrow import RecordBatch, fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from slipstack.sources.store import opened

FORMAT = "slipstack_files"
STAGING = "_staging"
#: Files of a task go into folders of this many, so that no folder grows without bound.
FOLDER = 10_000


@dataclass
class Written(WriterCommitMessage):
    """What a task has staged."""

    folder: str
    files: int


class _Staged:
    """Writing, publishing and dropping, as both writers do it."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid4().hex

    def stage(self, batches: Iterator[RecordBatch]) -> Written:
        system, root = opened(self.path)
        task, n = TaskContext.get(), 0
        folder = f"{STAGING}/{self.run}/task-{task.partitionId()}-{uuid4().hex}"
        system.create_dir(f"{root}/{folder}", recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                if name is None or "/" in name or name in ("", ".", ".."):
                    raise ValueError(f"not a file name: {name!r}")
                if n % FOLDER == 0:
                    system.create_dir(f"{root}/{folder}/{n // FOLDER}", recursive=True)
                with system.open_output_stream(f"{root}/{folder}/{n // FOLDER}/{name}") as out:
                    out.write(content or b"")
                n += 1
        return Written(folder, n)

    def publish(self, messages: list[Written | None], label: str) -> None:
        system, root = opened(self.path)
        replaced = "epoch-" if self.overwrite else f"{label}-"
        for found in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if found.type == fs.FileType.Directory and found.base_name.startswith(replaced):
                system.delete_dir(found.path)
        for i, message in enumerate(m for m in messages if m is not None and m.files):
            system.move(f"{root}/{message.folder}", f"{root}/{label}-{i}")
        self.drop()

    def drop(self) -> None:
        system, root = opened(self.path)
        staged = f"{root}/{STAGING}/{self.run}"
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.staged = _Staged(path, overwrite)

    def write(self, iterator: Iterator[RecordBatch]) -> Written:
        return self.staged.stage(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.staged.publish(messages, f"epoch-run{self.staged.run}")

    def abort(self, messages: list[Written | None]) -> None:
        self.staged.drop()


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.staged = _Staged(path, False)

    def write(self, iterator: Iterator[RecordBatch]) -> Written:
        return self.staged.stage(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.staged.publish(messages, f"epoch-{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.staged.drop()


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["path"], overwrite)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)
