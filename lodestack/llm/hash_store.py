"""Sorted hash arrays in shared files.

Spark deals rows of (key, values) by the leading bits of their 64-bit key and sorts
them; a task writes each such bucket as one Arrow file of flat arrays.  Tasks that look
keys up map the files into memory and search them, so nothing passes through the driver
but the files' names, and workers of one machine share the pages.  Only files of
successful tasks are named; those of lost attempts are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .workspace import fresh_path, open_fs

#: Rows of one file, about.
FILE_ROWS = 1 << 20


@dataclass(frozen=True)
class HashStore:
    """Where the arrays are: their folder, the files by bucket, the leading bits that name it, their rows, and how many lie before each bucket."""

    folder: str
    files: dict[int, str]
    bits: int
    rows: int
    before: dict[int, int]


def write_arrays(store: fs.FileSystem, at: str, bucket: int, columns: list[np.ndarray], names: list[str]) -> str:
    """Write the sorted arrays of a bucket; their file."""
    path = f"{at}/{bucket}-{uuid.uuid4().hex}.arrow"
    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
    with store.open_output_stream(path) as out, pa.ipc.new_file(out, rows.schema) as file:
        file.write_batch(rows)
    return path


def _writer(folder: str, names: list[str], bits: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_fs(folder)
        written: list[tuple[int, str, int]] = []
        held: list[list[np.ndarray]] = []
        bucket = -1

        def flush() -> None:
            if held:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                written.append((bucket, write_arrays(store, at, bucket, columns, names), len(columns[0])))
                held.clear()

        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            which = columns[0].view(np.uint64) >> np.uint64(64 - bits)
            edges = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1), len(which)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    if int(which[a]) != bucket:
                        flush()
                        bucket = int(which[a])
                    held.append([c[a:b] for c in columns])
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([w[i] for w in written], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["bucket", "path", "n"])

    return write


def new_folder(spark: SparkSession, kind: str) -> str:
    folder = fresh_path(spark, kind)
    store, at = open_fs(folder)
    store.create_dir(at, recursive=True)
    return folder


def write_store(rows: DataFrame, kind: str, file_rows: int = FILE_ROWS, n: int | None = None, folder: str | None = None) -> HashStore:
    """Write ``rows`` (key long, then number columns without nulls; keys distinct; ``n`` of them) as sorted arrays, to ``folder`` (of ``new_folder``)."""
    n = rows.count() if n is None else n
    bits = max(1, (n // file_rows).bit_length())
    folder = folder or new_folder(rows.sparkSession, kind)
    bucket = F.shiftrightunsigned("key", 64 - bits)
    dealt = rows.repartition(1 << bits, bucket).sortWithinPartitions(bucket, "key")
    files = dealt.mapInArrow(_writer(folder, rows.columns, bits), "bucket long, path string, n long").collect()
    before, at = {}, 0
    for r in sorted(files, key=lambda r: r["bucket"]):
        before[r["bucket"]] = at
        at += r["n"]
    return HashStore(folder, {r["bucket"]: r["path"] for r in files}, bits, n, before)


class Lookup:
    """Reads a store; files are opened when a key first falls into them."""

    def __init__(self, store: HashStore) -> None:
        self.store, self.fs = store, open_fs(store.folder)[0]
        self.open: dict[int, list[np.ndarray]] = {}

    def arrays(self, bucket: int) -> list[np.ndarray]:
        """The keys (unsigned) and values of a file."""
        if bucket not in self.open:
            path = self.store.files[bucket]
            if isinstance(self.fs, fs.LocalFileSystem):
                source = pa.memory_map(path)
            else:
                with self.fs.open_input_file(path) as file:
                    source = pa.BufferReader(file.read_buffer())
            rows = pa.ipc.open_file(source).get_batch(0)
            self.open[bucket] = [rows.column(0).to_numpy().view(np.uint64), *(c.to_numpy() for c in rows.columns[1:])]
        return self.open[bucket]

    def _hits(self, keys: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """For each file that ascending ``keys`` fall into: its bucket, the range of keys, their places and whether they are there."""
        edges = np.searchsorted(keys, np.arange(1 << self.store.bits, dtype=np.uint64) << np.uint64(64 - self.store.bits))
        edges = np.append(edges, len(keys))
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            if bucket in self.store.files:
                here = slice(edges[bucket], edges[bucket + 1])
                known = self.arrays(bucket)[0]
                at = np.minimum(np.searchsorted(known, keys[here]), len(known) - 1)
                yield bucket, here, at, known[at] == keys[here]

    def find(self, keys: np.ndarray, values: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which of the ascending unsigned ``keys`` are there, and their values (0 where not)."""
        found, out = np.zeros(len(keys), bool), [np.zeros(len(keys), np.int64) for _ in range(values)]
        for bucket, here, at, same in self._hits(keys):
            found[here] = same
            for o, c in zip(out, self.arrays(bucket)[1:], strict=False):
                o[here] = np.where(same, c[at], 0)
        return found, out

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """How many keys of the store lie before each of the ascending ``keys``, all of which are there."""
        out = np.full(len(keys), -1)
        for bucket, here, at, same in self._hits(keys):
            out[here] = np.where(same, at + self.store.before[bucket], -1)
        if (out < 0).any():
            raise KeyError("not in the store")
        return out
