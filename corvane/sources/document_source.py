"""A Spark data source for folders of documents: batch and stream, with splits of its own and filters that keep files closed.

    register(spark)
    spark.read.format("corvane_documents").load(folder).filter("extension = 'md' and length < 100000")
    spark.readStream.format("corvane_documents").load(folder)

Folders can be anywhere that pyarrow's file systems reach (local, S3, GCS, HDFS). Options: ``recursive`` (true), ``splitBytes`` and
``splitFiles`` (a split holds files of at most so many bytes, and so many files, one file at least), ``content`` (true; false leaves files closed and gives null).
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from corvane.sources.files import FOLDERS

FORMAT = "corvane_documents"
SCHEMA = "path string, modificationTime timestamp, length long, extension string, folder string, category string, content binary"
SPLIT_BYTES, SPLIT_FILES = 64 << 20, 256
#: What a filter on a column that is known without opening a file asks of its value.
TESTS = {
    EqualTo: lambda v, w: v == w, EqualNullSafe: lambda v, w: v == w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w,
    LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w, In: lambda v, w: v in w, StringStartsWith: lambda v, w: v.startswith(w), StringEndsWith: lambda v, w: v.endswith(w),
}
KNOWN = ("path", "length", "extension", "folder", "category")


@dataclass(order=True)
class Found:
    """A file as its listing tells of it. Files are in order of change, then path."""

    time: int  # microseconds
    path: str
    length: int

    def value(self, column: str):
        name = self.path.rsplit("/", 1)[-1]
        ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
        of = next((f for f, types in FOLDERS.items() if ext in types.split()), None)
        return {"path": self.path, "length": self.length, "extension": ext, "folder": of or "other", "category": "unknown" if of is None else of if of in ("audio", "video") else "document"}[column]


@dataclass
class Split(InputPartition):
    files: list

    def __init__(self, files: list):
        self.files = files


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, recursive: bool = True) -> list[Found]:
    """The regular files below a folder, without those whose name begins with a dot or underscore."""
    from pyarrow import fs

    system, root = _system(path)
    infos = system.get_file_info(fs.FileSelector(root, recursive=recursive, allow_not_found=True))
    return sorted(Found(i.mtime_ns // 1000, i.path, i.size) for i in infos if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")))


def splits(files: list[Found], most_bytes: int = SPLIT_BYTES, most_files: int = SPLIT_FILES) -> list[Split]:
    out, size = [], 0
    for f in files:
        if not out or size + f.length > most_bytes or len(out[-1].files) >= most_files:
            out.append(Split([]))
            size = 0
        out[-1].files.append(f)
        size += f.length
    return out


class _Files:
    """What batch and stream share."""

    def __init__(self, options: dict):
        self.path = options.get("path", "")
        flag = lambda name: str(options.get(name, "true")).lower() == "true"
        self.recursive, self.content, self.tests = flag("recursive"), flag("content"), []
        self.most_bytes, self.most_files = int(options.get("splitBytes", SPLIT_BYTES)), int(options.get("splitFiles", SPLIT_FILES))

    def found(self) -> list[Found]:
        return [f for f in listed(self.path, self.recursive) if all(TESTS[kind](f.value(column), value) for kind, column, value in self.tests)]

    def cut(self, files: list[Found]) -> list[Split]:
        return splits(files, self.most_bytes, self.most_files)

    def rows(self, split: Split) -> Iterator[tuple]:
        system, _ = _system(self.path)
        for f in split.files:
            body = None
            if self.content:
                with system.open_input_stream(f.path) as stream:
                    body = stream.read()
            when = datetime.datetime.fromtimestamp(f.time / 1e6, datetime.timezone.utc)
            yield f.path, when, f.length, *(f.value(c) for c in ("extension", "folder", "category")), body


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on what a listing tells are applied before any file is opened; the others are left to Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if type(f) in TESTS and name in KNOWN and f.value is not None and not (type(f) is In and None in f.value):
                self.files.tests.append((type(f), name, f.value))
            else:
                yield f

    def partitions(self) -> list[Split]:
        return self.files.cut(self.files.found())

    def read(self, partition: Split) -> Iterator[tuple]:
        yield from self.files.rows(partition) if partition is not None else ()


class DocumentStream(DataSourceStreamReader):
    """Files in order of change: an offset is the last file that was read. A file that appears with an older time of change than the offset is not seen."""

    def __init__(self, options: dict):
        self.files = _Files(options)

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(self.files.found(), default=None)
        return {"time": last.time, "path": last.path} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Split]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return self.files.cut([f for f in self.files.found() if low < (f.time, f.path) <= high])

    def read(self, partition: Split) -> Iterator[tuple]:
        yield from self.files.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options)

    def streamReader(self, schema) -> DocumentStream:
        return DocumentStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentSource)
