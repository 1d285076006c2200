"""A sink for files under given names, which tasks write together and the driver puts in place.

Each task writes its part of a file under a temporary name; a commit joins the parts in the order of the tasks under the file's own
name, an abort removes them. What an attempt that was lost has written is in no commit message and goes with the temporary folder.
"""

from __future__ import annotations

import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file string, content binary"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address that driver and executors share, and the path there."""
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (pafs.LocalFileSystem(), path)


@dataclass
class Parts(WriterCommitMessage):
    task: int
    parts: list[tuple[str, str]]  # a file's name and where its part lies


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.held = f"{self.folder}/_parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        fs, held = opened(self.held)
        context = TaskContext.get()
        own = f"{held}/{context.partitionId()}-{context.taskAttemptId()}"
        fs.create_dir(own)
        parts: list[tuple[str, str]] = []
        out = None
        try:
            for batch in iterator:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if not parts or parts[-1][0] != name:  # rows come sorted by file
                        if out:
                            out.close()
                        parts.append((name, f"{own}/{len(parts)}"))
                        out = fs.open_output_stream(parts[-1][1])
                    if content.is_valid:
                        out.write(content.as_buffer())
        finally:
            if out:
                out.close()
        return Parts(context.partitionId(), parts)

    def commit(self, messages: list[Parts | None]) -> None:
        fs, held = opened(self.held)
        folder = opened(self.folder)[1]
        files: dict[str, list[str]] = {}
        for m in sorted((m for m in messages if m), key=lambda m: m.task):
            for name, part in m.parts:
                files.setdefault(name, []).append(part)
        there = {name for name in files if fs.get_file_info(f"{folder}/{name}").type != pafs.FileType.NotFound}
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{sorted(there)[0]} is in {folder} already")
        for name, parts in files.items():
            whole = parts[0]
            if len(parts) > 1:  # a part at a time, in blocks
                whole = f"{held}/whole"
                with fs.open_output_stream(whole) as out:
                    for part in parts:
                        with fs.open_input_stream(part) as come:
                            shutil.copyfileobj(come, out, 1 << 20)
            fs.move(whole, f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Parts | None]) -> None:
        fs, held = opened(self.held)
        if fs.get_file_info(held).type != pafs.FileType.NotFound:
            fs.delete_dir(held)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, folder: str, *order: str, overwrite: bool = False) -> None:
    """Files in a folder. rows: file (a name), content (binary) and what a file's rows are ordered by.

    A large file is written by many tasks; names that exist raise, unless overwrite.
    """
    if re.search(r"^$|^\w+:$", folder):
        raise ValueError("name a folder")
    rows.sparkSession.dataSource.register(NamedFiles)
    ranges = rows.repartitionByRange("file", *order).sortWithinPartitions("file", *order).select("file", F.col("content").cast("binary").alias("content"))
    ranges.write.format("named_files").mode("overwrite" if overwrite else "append").save(folder)
