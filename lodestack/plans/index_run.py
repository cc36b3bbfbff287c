"""An index run: what is new in a listing of notes, chunked, embedded and posted in one new version.

A listing (path, mtime) is compared with the stored state.  Contents are read of new and
touched notes only, and hashed; what really changed is read again, parsed, chunked,
embedded and written as one segment (``operators.segments``), together with the new state
of its files.  A run that finds nothing changed reads no content and writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import blank_to_null
from ..operators import embed, index, maintain, segments
from ..operators.chunk import MAX_CHARS, OVERLAP, chunk_notes
from ..sources.notes import decoded, parse_notes
from ..workspace import cut

#: (path) -> (path, content): how contents are read.
Reader = Callable[[DataFrame], DataFrame]
#: What embeds lists of texts, set up once a task.
Provider = Callable[[], Callable[[list[str]], np.ndarray]]
FIELDS = ("type", "scope", "agent", "profile", "status", "confidence", "tags", "title")


@dataclass(frozen=True)
class Report:
    """Counts of one run."""

    full: bool
    indexed: int
    touched: int
    unchanged: int
    removed: int
    ambiguous: int
    chunks_written: int
    chunks_deleted: int
    chunks_total: int


def note_of(path: Column) -> Column:
    """A note's id: its file's name."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.md$", "")


def winners(listed: DataFrame) -> DataFrame:
    """path, note_id, mtime, read_only, losers: of files with one name the first path counts."""
    flag = F.coalesce("read_only", F.lit(False)) if "read_only" in listed.columns else F.lit(False)
    rows = listed.select("path", note_of(F.col("path")).alias("note_id"), "mtime", flag.alias("read_only"))
    best = rows.groupBy("note_id").agg(F.min_by(F.struct("path", "mtime", "read_only"), "path").alias("w"), (F.count("*") - 1).alias("losers"))
    return best.select("w.path", "note_id", "w.mtime", "w.read_only", "losers")


def _compared(known: DataFrame | None, now: DataFrame, full: bool, partial: bool) -> DataFrame:
    """Each path of either side with ``look``: removed, unchanged, new or maybe."""
    if known is None:
        known = now.select("path", "note_id", "mtime", F.lit("").alias("hash")).where(F.lit(False))
    old = known.select("path", F.col("note_id").alias("old_note"), F.col("mtime").alias("old_mtime"), F.col("hash").alias("old_hash"))
    both = now.join(old, "path", "left" if partial else "full_outer")
    same = F.lit(False) if full or partial else F.coalesce(F.col("mtime") == F.col("old_mtime"), F.lit(False))
    look = F.when(F.col("note_id").isNull(), "removed").when(F.col("old_note").isNull(), "new").when(same, "unchanged").otherwise("maybe")
    return both.withColumn("look", look)


def NO_VECTORS() -> Callable[[list[str]], np.ndarray]:  # noqa: N802
    """Provider of an index of words alone."""
    raise TypeError("no texts are embedded")


def chunked(files: DataFrame, provider: Provider, settings: Mapping[str, Any]) -> DataFrame:
    """Chunks with their note's fields and vectors, from (path, content)."""
    notes = parse_notes(files.select("path", decoded(F.col("content")).alias("text")))
    kind = maintain.type_of(F.col("folders"), F.col("tags"), "tag_first")
    status = F.coalesce(blank_to_null(F.col("status")), F.lit("ativo"))
    clean = [blank_to_null(F.col(c)).alias(c) for c in ("scope", "agent", "profile", "confidence")]
    rows = notes.select("note_id", kind.alias("type"), *clean, status.alias("status"), "tags", "title", "body")
    made = chunk_notes(rows, settings.get("max_chars", MAX_CHARS), settings.get("overlap", OVERLAP), settings.get("contextual", True), FIELDS)
    made = made.withColumnRenamed("embed_text", "text")
    if provider is NO_VECTORS:
        return made.withColumn("embedding", F.lit(None).cast("array<double>"))
    return embed.add_embeddings(made, "text", provider)


def run(spark: SparkSession, path: str, listed: DataFrame, read: Reader, provider: Provider | None = None, settings: Mapping[str, Any] | None = None, full: bool = False, partial: bool = False, hashes: Reader | None = None) -> Report:
    """Bring the index below ``path`` up to the listing (path, mtime, perhaps read_only).

    ``settings`` (``embedding``: the provider's name, ``max_chars``, ``overlap``,
    ``contextual``) are what the index depends on: others than the stored ones, or
    ``full``, make it anew.  A ``partial`` listing names notes to be read whatever their
    mtime, and says nothing of others.  Of files with one name the first path counts.  With
    ``NO_VECTORS`` chunks have null embeddings and are found by their words alone.
    ``hashes`` gives (path, hash) where a source can hash contents without moving them.
    """
    settings = {"embedding": "hash-256", **(settings or {})}
    mark = index.fingerprint(settings)
    stored = segments.open_index(spark, path)
    fresh = full or stored.settings != mark
    if fresh and partial and stored.segments:
        raise ValueError("the settings changed: run over the whole listing")
    known = None if fresh else segments.state(spark, stored)
    now = winners(listed)
    looked = cut(_compared(known, now, fresh, partial))
    counts = {r["look"]: r for r in looked.groupBy("look").agg(F.count("*").alias("n"), F.sum("losers").alias("losers")).collect()}
    n = lambda k: counts[k]["n"] if k in counts else 0
    ambiguous = sum(r["losers"] or 0 for r in counts.values())
    if not fresh and not n("new") + n("maybe") + n("removed"):
        return Report(False, 0, 0, n("unchanged"), 0, ambiguous, 0, 0, stored.chunks)
    some = looked.where("look in ('new', 'maybe')")
    hashed = hashes(some.select("path")) if hashes else read(some.select("path")).select("path", index.content_hash(F.col("content")).alias("hash"))
    seen = cut(some.join(hashed, "path").withColumn("same", F.coalesce(F.col("hash") == F.col("old_hash"), F.lit(False)) & (F.lit(not partial))))
    todo = seen.where("not same")
    chunks = chunked(read(todo.select("path")), provider or (lambda: embed.hash_vectors), settings)
    removed = looked.where("look = 'removed'")
    gone = removed.select(F.col("old_note").alias("note_id")).union(todo.select("note_id"))

    def of_state(made: DataFrame) -> DataFrame:
        sizes = made.groupBy("note_id").agg(F.count("*").alias("n"))
        kept = known.select("path", "chunks") if known is not None else seen.select("path", F.lit(0).cast("long").alias("chunks")).where(F.lit(False))
        rows = seen.join(sizes, "note_id", "left").join(kept, "path", "left")
        held = F.when(F.col("same"), F.col("chunks")).otherwise(F.coalesce("n", F.lit(0))).cast("long")
        rows = rows.select("path", "note_id", "mtime", "hash", held.alias("chunks"), "read_only", F.lit(False).alias("gone"))
        over = removed.select("path", F.col("old_note").alias("note_id"), F.col("old_mtime").alias("mtime"), F.col("old_hash").alias("hash"), F.lit(0).cast("long").alias("chunks"), F.lit(False).alias("read_only"), F.lit(True).alias("gone"))
        return rows.unionByName(over)

    done = segments.write(spark, path, chunks, gone, of_state, mark, fresh)
    last = done.segments[-1]
    same = seen.where("same").count()
    return Report(fresh, n("new") + n("maybe") - same, same, n("unchanged"), n("removed"), ambiguous, last.chunks, last.gone_chunks, done.chunks)


def remove_notes(spark: SparkSession, path: str, notes: DataFrame) -> segments.Stored:
    """Drop ``notes`` (note_id) from the index and from its state."""
    stored = segments.open_index(spark, path)
    known = segments.state(spark, stored)
    none = segments.chunks(spark, stored).drop("length").where(F.lit(False))
    over = known.join(notes.select("note_id").distinct(), "note_id", "left_semi").withColumn("gone", F.lit(True)) if known is not None else None
    return segments.write(spark, path, none, notes, None if over is None else lambda _: over, stored.settings or "")
