"""Windows of files as rows: a data source that reads heads, tails or any range of a file, never the whole of it.

    spark.dataSource.register(FileWindows)
    spark.read.format("file_windows").option("head", 65536).option("tail", 1024).load("hdfs:///media")

Rows: path, size, offset, bytes. A file's windows are `window` bytes long from offset 0 on; given are those that begin below `head` (default:
one window) or reach into the last `tail` bytes (default 0); head = -1: all. A window is one row, and partitions hold windows of about `partition` bytes
together, so a task's memory follows the window, whatever a file's size. Empty files have one empty window. Folders are
listed (option recursive), on any file system that pyarrow opens by its address; hidden files (`.`, `_`) are left out.

Filters on path, size and offset (=, <, <=, >, >=, in, startsWith) are pushed into the listing: with
spark.sql.python.filterPushdown.enabled, which they need, only windows that pass are planned and opened. A file that goes or shrinks
between listing and reading gives shorter bytes or fails the task, as its own reader would.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

SCHEMA = "path string, size bigint, offset bigint, bytes binary"
WINDOW, PARTITION = 1 << 16, 8 << 20
_TESTS: dict[type, Callable] = {EqualTo: operator.eq, LessThan: operator.lt, LessThanOrEqual: operator.le, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, In: lambda x, among: x in among, StringStartsWith: str.startswith}


class Windows(InputPartition):
    """(path, size, offset, length) of each window that one task reads."""

    def __init__(self, windows: list[tuple[str, int, int, int]]):
        super().__init__(None)
        self.windows = windows


class WindowReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path", "")
        self.window, self.part = int(options.get("window", WINDOW)), int(options.get("partition", PARTITION))
        self.head, self.tail = int(options.get("head", self.window)), int(options.get("tail", 0))
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = ".".join(f.attribute) if type(f) in _TESTS else ""
            if column in ("path", "size", "offset") and f.value is not None:
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def passes(self, **known: object) -> bool:
        return all(_TESTS[kind](known[column], value) for column, kind, value in self.tests if column in known)

    def offsets(self, size: int) -> Iterator[int]:
        """Starts of a file's windows: a range of the head, and what a range of the tail adds."""
        head = size if self.head < 0 else min(size, self.head)
        last = max(0, -(-size // self.window))
        front = max(1, -(-head // self.window))
        back = max(front, (size - self.tail) // self.window) if self.tail > 0 else last
        for k in (*range(front), *range(back, last)):
            if self.passes(offset=k * self.window):
                yield k * self.window

    def files(self) -> Iterator[tuple[str, int]]:
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path and not self.path.startswith("file:") else ""
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        for x in sorted(found, key=lambda x: x.path):
            if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")) and self.passes(path=scheme + x.path, size=x.size):
                yield scheme + x.path, x.size

    def partitions(self) -> list[Windows]:
        parts, held = [], 0
        for path, size in self.files():
            for offset in self.offsets(size):
                length = min(self.window, size - offset)
                if not parts or held + length > self.part:
                    parts.append([])
                    held = 0
                parts[-1].append((path, size, offset, length))
                held += length
        return [Windows(x) for x in parts] or [Windows([])]

    def read(self, partition: Windows) -> Iterator[pa.RecordBatch]:
        system, opened, file = None, None, None
        for path, size, offset, length in partition.windows:
            if path != opened:
                if file is not None:
                    file.close()
                system, own = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                file, opened = system.open_input_file(own), path
            data = file.read_at(length, offset) if length else b""
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([offset], pa.int64()), pa.array([data], pa.binary())], names=["path", "size", "offset", "bytes"])
        if file is not None:
            file.close()


class FileWindows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_windows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WindowReader:
        return WindowReader(dict(self.options))


def file_windows(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The windows of a file, or of the files of a folder, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileWindows)
    return spark.read.format("file_windows").options(**{k: str(v) for k, v in options.items()}).load(path)
