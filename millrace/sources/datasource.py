"""A user-defined record reader and writers as Spark data sources, with partitions and files of their own.

spark.dataSource.register(TeraSource); spark.read.format("tera").option("rows", n).option("splits", k).load()

Files are written through the file system that the path's scheme names (file, hdfs, s3, gs), into a temporary folder beside their
place; they are moved there when all tasks have ended, so a failed attempt leaves nothing. A path without a scheme is of
the local file system, which all executors then must share.
"""

from __future__ import annotations

import bz2
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from millrace.sources.generators import _fixed, tera_records

BATCH = 10_000


@dataclass
class Rows(InputPartition):
    first: int
    last: int


@dataclass
class Part(WriterCommitMessage):
    name: str
    records: int


def file_system(path: str):  # noqa: ANN201
    """The file system of a path and the path there."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Plain:
    """Bytes as they are, with the interface of a compressor."""

    @staticmethod
    def compress(data: bytes) -> bytes:
        return data

    @staticmethod
    def flush() -> bytes:
        return b""


#: Codecs of files that are written here, each a suffix and a compressor of a stream.
STREAM_CODECS: dict[str, tuple[str, Callable]] = {
    "none": ("", _Plain),
    "gzip": (".gz", lambda: zlib.compressobj(wbits=zlib.MAX_WBITS | 16)),
    "deflate": (".deflate", zlib.compressobj),
    "bzip2": (".bz2", bz2.BZ2Compressor),
}


class FolderWriter(DataSourceWriter):
    """A file for each task; overwrite: in place of the files that are in the folder."""

    def __init__(self, folder: str, overwrite: bool, encode: Callable[[Row], bytes], compression: str = "none") -> None:
        if compression not in STREAM_CODECS:
            raise ValueError(f"unknown codec {compression!r}; known: {', '.join(STREAM_CODECS)}")
        self.folder, self.overwrite, self.encode, self.compression = folder.rstrip("/"), overwrite, encode, compression
        self.run = uuid.uuid4().hex

    def _temporary(self, path: str) -> str:
        return f"{path}/_temporary-{self.run}"

    def write(self, iterator: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        system, path = file_system(self.folder)
        suffix, codec = STREAM_CODECS[self.compression]
        task, records, out = TaskContext.get(), 0, codec()
        name = f"part-{task.partitionId():05d}-{self.run[:8]}-{task.taskAttemptId()}{suffix}"
        system.create_dir(self._temporary(path), recursive=True)
        with system.open_output_stream(f"{self._temporary(path)}/{name}", compression=None, buffer_size=1 << 20) as file:
            for row in iterator:
                file.write(out.compress(self.encode(row)))
                records += 1
            file.write(out.flush())
        return Part(name, records)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, path = file_system(self.folder)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(path)):
                if old.base_name != f"_temporary-{self.run}":
                    (system.delete_dir if old.type == fs.FileType.Directory else system.delete_file)(old.path)
        for m in messages:
            if m is not None:
                system.move(f"{self._temporary(path)}/{m.name}", f"{path}/{m.name}")
        self._removed(system, path)

    def abort(self, messages: list[Part | None]) -> None:
        self._removed(*file_system(self.folder))

    def _removed(self, system, path: str) -> None:  # noqa: ANN001
        from pyarrow import fs

        if system.get_file_info(self._temporary(path)).type == fs.FileType.Directory:
            system.delete_dir(self._temporary(path))


class TeraSource(DataSource):
    """Generated rows of the sort benchmark (read), or records written as lines of key and value (write, to a folder)."""

    @classmethod
    def name(cls) -> str:
        return "tera"

    def schema(self) -> str:
        return "key binary, value binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TeraReader(int(self.options.get("rows", 0)), int(self.options.get("splits", 1)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FolderWriter(self.options["path"], overwrite, lambda row: bytes(row[0]) + bytes(row[1]) + b"\r\n")


class TeraReader(DataSourceReader):
    def __init__(self, rows: int, splits: int) -> None:
        self.rows, self.splits = rows, max(1, splits)

    def partitions(self) -> list[InputPartition]:
        ends = [self.rows * k // self.splits for k in range(self.splits + 1)]
        return [Rows(a, b) for a, b in zip(ends, ends[1:], strict=False)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        for a in range(partition.first, partition.last, BATCH):
            key, value = tera_records(np.arange(a, min(a + BATCH, partition.last)))
            yield pa.RecordBatch.from_arrays([_fixed(key), _fixed(value)], names=["key", "value"])


class RawSource(DataSource):
    """Binary values written one after another, with nothing between them."""

    @classmethod
    def name(cls) -> str:
        return "raw_bytes"

    def schema(self) -> str:
        return "value binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FolderWriter(self.options["path"], overwrite, lambda row: bytes(row[0] or b""), self.options.get("compression", "none"))
