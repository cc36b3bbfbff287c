"""The access log as a stream: files in, latest access of each note out, at least once.

The latest access is a maximum, so repeats and late records do no harm and no
watermark is set: it would drop late records that count.  State is not kept in
the stream but merged into a table, so it does not grow with the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.maintain import last_seen
from ..sources.logs import parse_access
from ..workspace import children, remove

#: Buckets of a merged table; the driver sees a number for each.
BUCKETS = 64


def stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000, clean: str = "off", archive: str | None = None) -> DataFrame:
    """The records of a growing folder of JSON lines.

    ``clean`` says what becomes of files whose batch has been committed: ``delete``, or
    ``archive`` below the folder of that name.  Files go while later batches run, so the
    last ones go when the stream is started again.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("cleanSource", clean)
    return parse_access((reader.option("sourceArchiveDir", archive) if archive else reader).text(folder))


def flush(records: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Hand the latest access of each note in each micro-batch to ``apply``.

    A batch counts as done only when ``apply`` returns; after a failure it comes again.
    """
    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: apply(last_seen(batch)))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _newest(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """The last version of a merged table and the version that holds each bucket."""
    numbers = sorted((int(n[2:]) for n in children(spark, f"{path}/versions") if n.startswith("v=")), reverse=True)
    for v in numbers:
        if "_SUCCESS" in children(spark, f"{path}/versions/v={v}"):
            rows = spark.read.schema("bucket int, at int").parquet(f"{path}/versions/v={v}").collect()
            return v, {r["bucket"]: r["at"] for r in rows}
    return 0, {}


def _folders(path: str, marks: dict[int, int]) -> list[str]:
    return [f"{path}/rows/v={v}/bucket={b}" for b, v in marks.items()]


def current(spark: SparkSession, path: str) -> DataFrame:
    """note_id, seen as the last whole ``merge_into`` left them."""
    marks = _newest(spark, path)[1]
    schema = "note_id string, seen date"
    return spark.read.schema(schema).parquet(*_folders(path, marks)) if marks else spark.createDataFrame([], schema)


def merge_into(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Callable[[DataFrame], None]:
    """An ``apply`` that keeps note_id, seen in buckets by a hash of the note; ``current`` reads them.

    A batch rewrites only the buckets that it touches, and counts when its list of
    buckets is written.  ``expire`` removes what the newest list does not name.
    ``buckets`` is fixed for the life of the table.
    """

    def apply(seen: DataFrame) -> None:
        spark = seen.sparkSession
        new = seen.select("note_id", "seen").withColumn("bucket", F.pmod(F.xxhash64("note_id"), F.lit(buckets)).cast("int")).persist()
        touched = {r[0] for r in new.select("bucket").distinct().collect()}
        version, marks = _newest(spark, path)
        if touched:
            both, held = new.select("note_id", "seen"), {b: v for b, v in marks.items() if b in touched}
            if held:
                both = both.unionByName(spark.read.schema("note_id string, seen date").parquet(*_folders(path, held)))
            merged = both.groupBy("note_id").agg(F.max("seen").alias("seen")).withColumn("bucket", F.pmod(F.xxhash64("note_id"), F.lit(buckets)).cast("int"))
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/v={version + 1}")
            rows = sorted((marks | dict.fromkeys(touched, version + 1)).items())
            spark.createDataFrame(rows, "bucket int, at int").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/v={version + 1}")
        new.unpersist()

    return apply


def expire(spark: SparkSession, path: str) -> int:
    """Remove the folders and lists of a merged table that its newest list does not name; how many went.

    Nobody may be reading an older state.  Without a whole list nothing is removed.
    """
    version, marks = _newest(spark, path)
    if not version:
        return 0
    old = [f"{path}/versions/{n}" for n in children(spark, f"{path}/versions") if n != f"v={version}"]
    for n in children(spark, f"{path}/rows"):
        held = [f"{path}/rows/{n}/{b}" for b in children(spark, f"{path}/rows/{n}") if b.startswith("bucket=")]
        named = [f for f in held if f"v={marks.get(int(f.rsplit('=', 1)[1]))}" == n]
        old += [f for f in held if f not in named] if named else [f"{path}/rows/{n}"]
    for folder in old:
        remove(spark, folder)
    return len(old)
