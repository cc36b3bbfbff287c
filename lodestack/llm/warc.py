"""WARC archives as a Spark data source.

``register(spark)`` makes ``format("warc")`` readable and writable.

Writing: each task writes one ``.warc.gz`` with a name of its own; only the files
of successful tasks enter the manifest that the driver commits, so a retried or
speculative task leaves nothing that a reader sees.  Each write adds a manifest of its
own; a reader sees the files of all of them, after an overwrite of the last.  Each record is a gzip member
whose extra field ``sl`` holds the member's length, so a reader can step over it.

Reading: files are packed into partitions by size.  A record's headers are read
first, from the start of its member; predicates on the record type and other
header columns are pushed down and decided on them, and the rest of the member is
neither decompressed nor even read if the record is rejected or its payload is
not wanted (option ``payload=false``).  Plain ``.warc`` files and gzip members
without ``sl`` are read too.

Files are reached through ``pyarrow.fs``, so paths may be on any file system that
it knows (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import json
import operator
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .workspace import cut, fresh_path, open_fs

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
HEADERS = [x.split()[0] for x in SCHEMA.split(", ")][:-1]
MANIFEST = "_manifest"
#: Output batches hold about so many payload bytes.
BATCH_BYTES = 8 << 20
#: Compressed bytes that are read to see the headers.
PEEK = 4096


# ---------------------------------------------------------------- record format


def member(data: bytes) -> bytes:
    """A gzip member with its length in the extra field."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    length = 12 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, length, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def encode(row: dict) -> bytes:
    """One WARC record; a revisit has the HTTP headers of the full payload but no payload."""
    payload = row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    fields = {"WARC-Type": row["record_type"], "WARC-Record-ID": f"<{row['record_id']}>", "WARC-Target-URI": row["target_uri"], "WARC-Date": row["date"], "Content-Type": "application/http; msgtype=response"}
    if row["payload_digest"]:
        fields["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    if row["record_type"] == "revisit":
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": row["refers_to"] and f"<{row['refers_to']}>"}
    lines = [f"{k}: {' '.join(str(v).split())}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def headers(head: bytes, http: bytes | None) -> dict:
    """The header columns of a record."""
    warc, inner = _fields(head), _fields(http) if http else {}
    digest = warc.get("warc-payload-digest", "").removeprefix("sha1:")
    bare = lambda k: warc[k].strip("<>") if k in warc else None
    length = inner.get("content-length", "")
    return {"record_type": warc.get("warc-type"), "record_id": bare("warc-record-id"), "target_uri": warc.get("warc-target-uri"), "date": warc.get("warc-date"), "refers_to": bare("warc-refers-to"), "payload_digest": base64.b32decode(digest).hex() if len(digest) == 32 else digest or None, "payload_length": int(length) if length.isdigit() else None}


def _split(data: bytes) -> tuple[dict, int, int] | None:
    """Header columns, start of the payload and end of the block; None if more bytes are needed."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    block = end + 4
    fields = _fields(data[:end])
    stop = block + int(fields.get("content-length", 0))
    if not fields.get("content-type", "").startswith("application/http"):
        return headers(data[:end], None) | {"payload_length": stop - block}, block, stop
    inner = data.find(b"\r\n\r\n", block)
    if inner < 0 and len(data) < stop:
        return None
    return headers(data[:end], data[block:inner]), inner + 4 if inner >= 0 else stop, stop


def scan(file: pa.NativeFile, size: int, wanted, payload: bool) -> Iterator[dict]:
    """Records of one archive that ``wanted(headers)`` accepts."""
    at = 0
    while at < size:
        file.seek(at)
        start = file.read(PEEK)
        if start[:4] == b"\x1f\x8b\x08\x04" and start[12:14] == b"sl":
            length = struct.unpack("<I", start[16:20])[0]
            inflate, read = zlib.decompressobj(-15), min(len(start), length)
            data = inflate.decompress(start[24:length])
            file.seek(at + read)
            while (found := _split(data)) is None and read < length:
                chunk = file.read(min(1 << 16, length - read))
                data += inflate.decompress(chunk)
                read += len(chunk)
            left = length - read
            rest = lambda: inflate.decompress(file.read(left)) if left else b""  # noqa: E731,B023
            at += length
        elif start[:2] == b"\x1f\x8b":
            inflate, data, pos, chunk = zlib.decompressobj(31), [], at, start
            while chunk and not inflate.eof:
                data.append(inflate.decompress(chunk))
                pos += len(chunk)
                file.seek(pos)
                chunk = b"" if inflate.eof else file.read(1 << 16)
            at, data, rest = pos - len(inflate.unused_data), b"".join(data), lambda: b""
            found = _split(data)
        elif not start.strip():
            at += len(start)
            continue
        else:
            skip = len(start) - len(start.lstrip(b"\r\n"))
            data = start[skip:]
            while (found := _split(data)) is None and len(data) + at + skip < size:
                data += file.read(1 << 16)
            begin = at + skip
            rest = lambda: file.read(found[2] - len(data)) if file.seek(begin + len(data)) is not None and found[2] > len(data) else b""  # noqa: E731,B023
            at = begin + (found[2] if found else size)
        if found is None:
            raise ValueError("broken WARC record")
        row, first, stop = found
        if wanted(row):
            if payload and row["record_type"] != "revisit":
                body = (data + rest())[first:stop]
                row |= {"payload": body}
            yield row


# ------------------------------------------------------------------ data source


_COMPARE = {EqualTo: operator.eq, EqualNullSafe: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: operator.contains}


def accepts(f: Filter, row: dict) -> bool:
    """Whether a pushed filter holds for the header columns (null: only for null-safe equality)."""
    value = row[f.attribute[0]]
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    return value in f.value if isinstance(f, In) else _COMPARE[type(f)](value, f.value)


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    size: int = 0


def manifests_of(store: fs.FileSystem, path: str) -> list[str]:
    """What every committed write to a folder has left."""
    infos = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(x.path for x in infos if x.base_name.startswith(MANIFEST))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.target = int(options.get("partition_bytes", 16 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if (type(f) in _COMPARE or isinstance(f, In | IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, path = open_fs(self.path)
        if manifests := manifests_of(store, path):
            found = []
            for name in manifests:
                with store.open_input_stream(name) as f:
                    found += [(x["name"], x["size"]) for x in json.loads(f.read())]
        else:
            infos = store.get_file_info(fs.FileSelector(path, recursive=True))
            found = [(x.path.removeprefix(path).lstrip("/"), x.size) for x in infos if x.path.endswith((".warc", ".warc.gz"))]
        packs: list[list[str]] = []
        room = 0
        for name, size in sorted(found):
            if not packs or size > room:
                packs.append([])
                room = self.target
            packs[-1].append(name)
            room -= size
        return [Files(p) for p in packs] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, path = open_fs(self.path)
        wanted = lambda row: all(accepts(f, row) for f in self.filters)
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string()) for n, t in (x.split() for x in SCHEMA.split(", "))])
        rows, held = [], 0
        for name in partition.names:
            with store.open_input_file(f"{path}/{name}") as file:
                for row in scan(file, file.size(), wanted, self.payload):
                    rows.append({"payload": None} | row)
                    held += len(rows[-1]["payload"] or b"") + 200
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = open_fs(self.path)
        name, out, size = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 256):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                data = b"".join(member(encode(row)) for row in batch.slice(at, 256).to_pylist())
                out.write(data)
                size += len(data)
        if out is None:
            return Written(None)
        out.close()
        return Written(name, size)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = open_fs(self.path)
        store.create_dir(path, recursive=True)
        old = manifests_of(store, path) if self.overwrite else []
        with store.open_output_stream(f"{path}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([{"name": m.name, "size": m.size} for m in messages if m and m.name]).encode())
        for name in old:
            store.delete_file(name)

    def abort(self, messages: list[Written | None]) -> None:
        store, path = open_fs(self.path)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{path}/{m.name}")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; columns as in SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Register the source and let Spark push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# -------------------------------------------------------------------- operators


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")))


def page_of(record_id: Column) -> Column:
    """page_id of a record id; null for a page without one."""
    return F.regexp_extract(record_id, r"^urn:x-page:(-?[0-9]+)$", 1).try_cast("long")


def records(pages: DataFrame, least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Rows for ``format("warc")``: one record for each page, repeated payloads as revisits.

    Of the pages with one payload of at least ``least_bytes`` UTF-8 bytes, that
    with the largest page_id is the response; a full repeat of that row, with the
    same page_id, is a response too, and so are all if every page_id is null.
    Null html is an empty payload, a null url leaves the header out.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("payload_digest", F.sha1(F.col("html"))).withColumn("payload_length", F.octet_length("html").cast("long"))
    first = rows.where(F.col("payload_length") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written out first, so that the join shuffles both sides plainly and AQE may split a hot payload.
    rows = rows.join(cut(first), "payload_digest", "left")
    revisit = F.coalesce(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.lit(False))
    return rows.select(F.when(revisit, "revisit").otherwise("response").alias("record_type"), _record_id(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.when(revisit, _record_id(F.col("first"))).alias("refers_to"), "payload_digest", "payload_length", F.when(~revisit, F.encode("html", "UTF-8")).alias("payload"))


def archive(pages: DataFrame, path: str | None = None) -> str:
    """Write ``pages`` as WARC files; returns the folder."""
    spark = pages.sparkSession
    register(spark)
    path = path or fresh_path(spark, "warc")
    records(pages).write.format("warc").mode("append").save(path)
    return path


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records below ``path``."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_digests(archived: DataFrame) -> DataFrame:
    """Per page what its record says; digests and lengths of responses are taken from the payload itself."""
    whole = F.col("payload").isNotNull()
    return archived.select(page_of(F.col("record_id")).alias("page_id"), F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"), F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", page_of(F.col("refers_to")).alias("refers_to"))
