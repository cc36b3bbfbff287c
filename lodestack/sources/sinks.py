"""Writing tables and rendered documents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..workspace import cut
from .note_files import MOVERS, open_fs


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace the Parquet table at ``path``; readers see the old or the new one, by Spark's committer."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """(path, body) -> one text file for each path below ``path``, in a folder named for it.

    Parts of one document are joined in order of ``place`` where there is such a column, and then of ``body``.
    """
    order = ["place", "body"] if "place" in docs.columns else ["body"]
    parts = F.sort_array(F.collect_list(F.struct(*order)))
    whole = docs.groupBy("path").agg(F.array_join(parts["body"], "\n\n").alias("value"))
    whole.withColumn("document", F.regexp_replace("path", "[^A-Za-z0-9._-]+", "_")).select("document", "value").write.mode("overwrite").partitionBy("document").text(path)


def _part_writer(folder: str, job: str):
    """Each run of one path's lines as a hidden part file; (path, entry of its first line, part)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_fs(folder)
        store.create_dir(f"{top}/.{job}", recursive=True)
        now, out = None, None
        for batch in batches:
            begun = []
            for path, entry, line in zip(batch.column("path").to_pylist(), batch.column("entry").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if path != now:
                    if out is not None:
                        out.close()
                    part = f"{top}/.{job}/{uuid.uuid4().hex}"
                    now, out = path, store.open_output_stream(part)
                    begun.append((path, entry, part))
                out.write((line or "").encode("utf-8", "surrogatepass") + b"\n")
            if begun:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*begun, strict=True)], ["path", "entry", "part"])
        if out is not None:
            out.close()

    return write


def _joiner(folder: str, job: str):
    """A path's parts, one after the other, as one file beside its place; (path, hidden file)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_fs(folder)
        for batch in batches:
            made = []
            for path, parts in zip(batch.column("path").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                inside, _, name = f"{top}/{path}".rpartition("/")
                store.create_dir(inside, recursive=True)
                hidden = f"{inside}/.{name}.{job}.{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as out:
                    for part in parts:
                        with store.open_input_stream(part) as source:
                            while piece := source.read(_COPIED):
                                out.write(piece)
                made.append((path, hidden))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["path", "hidden"])

    return join


#: Bytes that are copied at once.
_COPIED = 1 << 20


def write_lines(lines: DataFrame, folder: str) -> int:
    """(path, entry, line) -> a text file for each path below ``folder``, its lines by entry; how many files.

    Lines are dealt by ranges, so several tasks write one large file, each a part of it, and
    no path's lines meet in a row or a task.  Parts are then joined as streams and moved to
    their places; until then nothing is seen of them, and a run that fails changes nothing.
    Entries of a path are unlike; a null line is an empty one.
    """
    spark, job = lines.sparkSession, uuid.uuid4().hex
    dealt = lines.select("path", F.col("entry").cast("long").alias("entry"), "line").repartitionByRange("path", "entry").sortWithinPartitions("path", "entry")
    parts = cut(dealt.mapInArrow(_part_writer(folder, job), "path string, entry long, part string"))
    listed = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("entry", "part"))).alias("p")).select("path", F.col("p.part").alias("parts"))
    hidden = cut(listed.mapInArrow(_joiner(folder, job), "path string, hidden string")).collect()
    store, top = open_fs(folder)
    with ThreadPoolExecutor(MOVERS) as pool:
        list(pool.map(lambda r: store.move(r["hidden"], f"{top}/{r['path']}"), hidden))
    if hidden:
        store.delete_dir(f"{top}/.{job}")
    return len(hidden)


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    report.write.mode("overwrite").json(path)


def splice(text: str, block: str, start: str, end: str) -> str:
    """``text`` with what is between the markers replaced; missing markers append, repeated ones are an error."""
    if text.count(start) > 1 or text.count(end) > 1 or (start in text) != (end in text):
        raise ValueError("the markers are ambiguous")
    made = f"{start}\n{block}\n{end}"
    if start not in text:
        return f"{text.rstrip()}\n\n{made}\n" if text.strip() else f"{made}\n"
    before, _, rest = text.partition(start)
    return before + made + rest.partition(end)[2]
