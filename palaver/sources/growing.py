"""A stream of the lines of growing files: recogniser messages and update logs as they are written.

Spark's own file source takes a file once, when it appears. A live log grows: this source keeps, as its offset, how many bytes of each file of a folder have been read, up to the last complete line. A batch is the bytes between two
offsets, cut into partitions that begin and end anywhere; a line belongs to the partition in which it begins. Offsets are in the query's checkpoint, so a restarted query goes on where it stopped and a repeated batch has the same rows.

    growing.register(spark)
    lines = spark.readStream.format("growing_lines").option("path", folder).load()

gives file, position (the byte at which the line begins) and value. ``readers.asr_messages`` and the readers of block formats work on such lines. The folder may be anywhere that pyarrow's file systems reach; files may
only grow.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, position long, value string"
#: Bytes of a partition, and of a look back for the end of the last line.
PARTITION_BYTES, LOOK_BACK = 32 << 20, 1 << 16


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: bool):
        self.path, self.start, self.end, self.first = path, start, end, first


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def complete_sizes(folder: str) -> dict[str, int]:
    """Bytes of each file up to the end of its last complete line."""
    system, root = _open(folder)
    out = {}
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.type != fs.FileType.File or info.base_name[0] in "._":
            continue
        end = info.size
        with system.open_input_file(info.path) as f:
            while end > 0:
                begin = max(0, end - LOOK_BACK)
                at = f.read_at(end - begin, begin).rfind(b"\n")
                if at >= 0:
                    end = begin + at + 1
                    break
                end = begin
        if end:
            out[info.base_name] = end
    return dict(sorted(out.items()))


def ranges(start: dict[str, int], end: dict[str, int], size: int) -> list[Range]:
    out = []
    for name, upto in sorted(end.items()):
        begin = start.get(name, 0)
        out += [Range(name, at, min(at + size, upto), at == begin) for at in range(begin, upto, size)]
    return out


def lines(folder: str, part: Range, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The lines that begin within the range; the first one of a range is looked for behind the byte before it."""
    system, root = _open(folder)
    held: list[tuple[str, int, str]] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["file", "position", "value"])
    with system.open_input_file(f"{root}/{part.path}") as raw, io.BufferedReader(raw, 1 << 20) as f:
        at = part.start if part.first else part.start - 1
        f.seek(at)
        if not part.first:
            at += len(f.readline())
        while at < part.end:
            line = f.readline()
            if not line:
                break
            held.append((part.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")))
            at += len(line)
            if len(held) == rows:
                yield batch()
                held.clear()
    if held:
        yield batch()


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.size = options["path"], int(options.get("partition_bytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return complete_sizes(self.folder)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start, end, self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return lines(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class _Table(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.size = options["path"], int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[Range]:
        return ranges({}, complete_sizes(self.folder), self.size) or [Range("", 0, 0, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return lines(self.folder, partition) if partition.path else iter(())


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)

    def reader(self, schema) -> DataSourceReader:
        return _Table(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)
