"""Where shared intermediate data goes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` decides.  Where it is unset, a local session gets a
    temporary folder (tests) and any other session the SQL warehouse, which is
    shared by definition.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-") if local else f"{warehouse}/_checkpoints")
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Compute ``df`` once into replicated-safe storage and forget its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new, unused path below the shared folder, or below that of ``scratch``."""
    return f"{(spark.sparkContext.getLocalProperty(_SCRATCH) or shared_dir(spark)).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: A thread's own folder for fresh paths.
_SCRATCH = "lodestack.scratch"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Fresh paths that are taken meanwhile, and what was written there, go in the end."""
    folder, sc = fresh_path(spark, "scratch"), spark.sparkContext
    before = sc.getLocalProperty(_SCRATCH)
    sc.setLocalProperty(_SCRATCH, folder)
    try:
        yield
    finally:
        sc.setLocalProperty(_SCRATCH, before)
        store, at = open_fs(folder)
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


def table(df: DataFrame, kind: str = "table", path: str | None = None) -> DataFrame:
    """``df`` written as Parquet below the shared folder (to ``path``) and read back; smaller than a checkpoint."""
    path = path or fresh_path(df.sparkSession, kind)
    dense = {"compression": "zstd"} if df.sparkSession.sparkContext.getLocalProperty(_SCRATCH) else {}
    df.write.parquet(path, **dense)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Meanwhile a query's shuffle files go when it ends, and do not wait for the driver to collect garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


#: Rows that a table of statistics may have to be broadcast.
BROADCAST_ROWS = 100_000


def small(stats: DataFrame) -> DataFrame:
    """``stats`` computed once, and marked to be broadcast if it is counted to be small."""
    stats = cut(stats)
    return F.broadcast(stats) if stats.count() <= BROADCAST_ROWS else stats


def join_small(rows: DataFrame, stats: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join a table of statistics, broadcast if it is counted to be small and shuffled otherwise."""
    return rows.join(small(stats), on, how)


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of a plain local path."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path)


def slices(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with low lines behind it, so that no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column_of(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
