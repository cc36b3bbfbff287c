"""Incremental indexing: what changed between a stored state and the files as they are."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def content_hash(content: Column) -> Column:
    """SHA-256 of bytes or text, lower-case hex."""
    return F.sha2(content.cast("binary"), 256)


def snapshot_diff(state: DataFrame, current: DataFrame) -> DataFrame:
    """path and action for every file of either side: (path, mtime, hash) each.

    Only in the state: removed.  Only in the files: new.  Same mtime: unchanged,
    whatever the hash.  Same hash: touched (only the mtime is to be stored).
    Otherwise changed.
    """
    old = state.select("path", F.col("mtime").alias("old_mtime"), F.col("hash").alias("old_hash"), F.lit(True).alias("had"))
    new = current.select("path", "mtime", "hash", F.lit(True).alias("has"))
    action = F.when(F.col("has").isNull(), "removed").when(F.col("had").isNull(), "new").when(F.col("mtime") == F.col("old_mtime"), "unchanged").when(F.col("hash") == F.col("old_hash"), "touched").otherwise("changed")
    return old.join(new, "path", "full_outer").select("path", action.alias("action"))


def index_report(diff: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: how many files of each action and how many chunks of ``chunks`` (path)."""
    counts = [F.count_if(F.col("action") == a).alias(a) for a in ("new", "changed", "touched", "unchanged", "removed")]
    return diff.agg(*counts).join(chunks.agg(F.count("*").alias("chunks")))


def to_index(diff: DataFrame) -> DataFrame:
    """Paths whose chunks have to be made anew."""
    return diff.where(F.col("action").isin("new", "changed")).select("path")


def apply_diff(index: DataFrame, diff: DataFrame, fresh: DataFrame) -> DataFrame:
    """``index`` without what went or changed, with the fresh rows (same columns, path among them)."""
    gone = diff.where(F.col("action").isin("removed", "changed", "new")).select("path")
    return index.join(gone, "path", "left_anti").unionByName(fresh)


def fingerprint(settings: Mapping[str, Any]) -> str:
    """Digest of the settings that an index depends on; another digest means a full rebuild."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def needs_rebuild(stored: str | None, settings: Mapping[str, Any]) -> bool:
    return stored != fingerprint(settings)


def with_read_only(index: DataFrame, read_only: DataFrame) -> DataFrame:
    """``index`` with a read_only flag for the note_ids of ``read_only``."""
    marks = read_only.select("note_id").distinct().withColumn("read_only", F.lit(True))
    return index.drop("read_only").join(marks, "note_id", "left").fillna({"read_only": False})
