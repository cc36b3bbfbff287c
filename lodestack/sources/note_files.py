"""Markdown notes as a data source: listed first, read as far as filters ask for, written under a commit.

``spark.read.format("notes")`` lists a folder on the driver, drops what pushed filters on
path, mtime and size exclude, and deals the rest to tasks; only these open files.
``spark.write.format("notes")`` writes (path, content) to hidden files beside their
places and moves them there when all tasks have succeeded; files that would not change
are left alone, and a job that fails leaves every old file as it was.

The file system is any that Arrow reads (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringStartsWith, WriterCommitMessage

SCHEMA = "path string, mtime timestamp, size long, content binary"
#: Files that are moved at once when a write is committed.
MOVERS = 32


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of a plain local path."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path)


_TESTS: dict[type, Callable] = {
    IsNotNull: lambda v, x: v is not None,
    EqualTo: lambda v, x: v == x,
    In: lambda v, x: v in x,
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
    StringStartsWith: lambda v, x: v.startswith(x),
    StringContains: lambda v, x: x in v,
}


@dataclass
class Batch(InputPartition):
    files: list[tuple[str, dt.datetime, int]]


class NotesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.contents = options.get("contents", "true").lower() != "false"
        self.dots = options.get("dotfolders", "true").lower() != "false"
        self.target = int(options.get("partition_bytes", 16 << 20))
        self.cost = int(options.get("open_bytes", 64 << 10))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute[0] in ("path", "mtime", "size"):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        return all(_TESTS[type(f)](row[f.attribute[0]], getattr(f, "value", None)) for f in self.filters)

    def files(self) -> Iterator[tuple[str, dt.datetime, int]]:
        """path, mtime and size of what is to be read; a folder that is missing holds nothing."""
        store, top = open_fs(self.folder)
        shown = self.folder.rstrip("/")
        for info in store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
            inside = info.path[len(top.rstrip("/")) + 1 :]
            folders, _, name = inside.rpartition("/")
            hidden = name.startswith(".") or (not self.dots and any(x.startswith(".") for x in folders.split("/")))
            if info.type == fs.FileType.File and name.endswith(".md") and not hidden:
                row = {"path": f"{shown}/{inside}", "mtime": info.mtime, "size": info.size}
                if self._wanted(row):
                    yield row["path"], row["mtime"], row["size"]

    def partitions(self) -> list[Batch]:
        out: list[Batch] = []
        held = self.target
        for file in sorted(self.files()):
            if held >= self.target:
                out.append(Batch([]))
                held = 0
            out[-1].files.append(file)
            held += file[2] + self.cost
        return out or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        for path, mtime, size in partition.files:
            yield path, mtime, size, _content(path) if self.contents else None


def _content(path: str) -> bytes | None:
    """A file's bytes; null if it is gone."""
    store, at = open_fs(path)
    try:
        with store.open_input_file(at) as f:
            return f.read()
    except FileNotFoundError:
        return None


@dataclass
class Written(WriterCommitMessage):
    #: (hidden file, its place)
    moves: list[tuple[str, str]] = field(default_factory=list)


class NotesWriter(DataSourceWriter):
    """Contents go to hidden files first; commit moves them."""

    def __init__(self, options: dict, schema: pa.Schema) -> None:
        self.folder = options["path"].rstrip("/")
        self.job = uuid.uuid4().hex

    def _place(self, path: str) -> str:
        return path if "://" in path or path.startswith(("/", "file:/")) else f"{self.folder}/{path}"

    def write(self, rows: Iterator) -> Written:
        done = Written()
        for row in rows:
            path, content = self._place(row["path"]), bytes(row["content"])
            if _content(path) == content:
                continue
            store, at = open_fs(path)
            folder, _, name = at.rpartition("/")
            store.create_dir(folder, recursive=True)
            hidden = f"{folder}/.{name}.{self.job}.{uuid.uuid4().hex}"
            done.moves.append((hidden, at))
            with store.open_output_stream(hidden) as f:
                f.write(content)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store = open_fs(self.folder)[0]
        moves = [m for message in messages if message for m in message.moves]
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda m: store.move(*m), moves))

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing has been moved; hidden files of this job go, those of lost tasks too."""
        store, top = open_fs(self.folder)
        for info in store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
            if f".{self.job}." in info.base_name:
                store.delete_file(info.path)


class NotesSource(DataSource):
    """Options: path; contents=false lists only; dotfolders=false leaves out dot folders."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: pa.Schema) -> NotesReader:
        return NotesReader(self.options)

    def writer(self, schema: pa.Schema, overwrite: bool) -> NotesWriter:
        return NotesWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NotesSource)


def notes(spark: SparkSession, folder: str, contents: bool = True, **options: str) -> DataFrame:
    """path, mtime, size, content of the notes below a folder; filter it, and only what passes is opened."""
    register(spark)
    return spark.read.format("notes").options(contents=str(contents).lower(), **options).load(folder)


def read_contents(paths: DataFrame) -> DataFrame:
    """(path, content) of the files that ``paths`` (path) names, opened where the rows lie; those that are gone are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                content = _content(path)
                if content is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], ["path", "content"])

    return paths.select("path").mapInArrow(read, "path string, content binary")


def write_notes(rows: DataFrame, folder: str) -> None:
    """Write (path, content: bytes or text) below ``folder``, in one commit; files that would not change are left alone.

    Paths are relative to the folder or whole, and unique.
    """
    register(rows.sparkSession)
    rows.selectExpr("path", "cast(null as timestamp) as mtime", "cast(null as bigint) as size", "cast(content as binary) as content").write.format("notes").mode("append").save(folder)
