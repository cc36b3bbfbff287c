"""The maintenance cycle: every step sees the notes as the step before left them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..config import Maintenance
from ..operators import maintain, vector
from ..sources.note_files import read_contents, write_notes
from ..sources.notes import decoded, patched, yaml_value
from ..workspace import cut


@dataclass(frozen=True)
class Cycle:
    """What a cycle finds, and the notes as it leaves them."""

    notes: DataFrame
    stamped: DataFrame
    duplicates: DataFrame
    decayed: DataFrame
    deprecated: DataFrame
    stale: DataFrame
    dead_citations: DataFrame

    def report(self) -> DataFrame:
        """step, n: one row for each step."""
        steps = {"stamped": self.stamped, "duplicates": self.duplicates, "decayed": self.decayed, "deprecated": self.deprecated, "stale": self.stale, "dead_citations": self.dead_citations}
        out = None
        for name, found in steps.items():
            row = found.agg(F.lit(name).alias("step"), F.count("*").alias("n"))
            out = row if out is None else out.union(row)
        return out


def changed_fields(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, status, last_accessed, superseded_by of notes (note_id, path, ...) that a cycle has changed; null where a field has not."""
    was = before.select("path", F.col("status").alias("_status"), F.col("last_accessed").alias("_seen"))
    both = after.join(was, "path")
    status = F.when(~F.col("status").eqNullSafe(F.col("_status")), F.col("status"))
    seen = F.when(~F.col("last_accessed").eqNullSafe(F.col("_seen")), F.col("last_accessed"))
    by = F.when(status.isNotNull(), F.col("superseded_by")) if "superseded_by" in after.columns else F.lit(None).cast("array<string>")
    rows = both.select("path", status.alias("status"), seen.alias("last_accessed"), by.alias("superseded_by"))
    return rows.where("status is not null or last_accessed is not null")


def land(changes: DataFrame, folder: str) -> DataFrame:
    """Set ``changed_fields`` in the front matter of their files, in one commit; (path, content) as written.

    Only changed files are opened and written; the rest of each stays as it is, byte order
    marks and CRLF apart.  If a task fails, all files are as they were.
    """
    links = F.transform("superseded_by", lambda x: F.concat(F.lit("[["), x, F.lit("]]")))
    fields = {"status": yaml_value(F.col("status"), "string"), "last_accessed": yaml_value(F.col("last_accessed"), "date"), "superseded_by": F.when(F.size("superseded_by") == 1, yaml_value(links[0], "string")).otherwise(yaml_value(links, "array<string>"))}
    files = changes.join(read_contents(changes), "path")
    written = cut(files.select("path", patched(decoded(F.col("content")), fields).alias("content")))
    write_notes(written, folder)
    return written


def consolidate(notes: DataFrame, access: DataFrame, edges: DataFrame, vectors: DataFrame, documents: DataFrame, today: dt.date, settings: Maintenance = Maintenance(), dry_run: bool = False) -> Cycle:
    """Stamp, find duplicates, decay, deprecate, find stale notes and dead citations.

    A dry run changes nothing, so its decay does not see the stamps either.
    ``vectors`` is (id, kind, scope, embedding) of live knowledge.
    """
    stamps = maintain.stamp(notes, maintain.last_seen(access))
    stamped = stamps.where("stamped").select("note_id", "last_accessed")
    now = notes if dry_run else stamps.drop("stamped")
    duplicates = vector.similar_pairs(vectors, settings.dedup_similarity)
    outdated = maintain.deprecations(edges, now)
    gone = maintain.decayed(now, today, settings.decay_days, outdated.select("note_id"))
    if not dry_run:
        now = maintain.deprecate(maintain.set_status(now, gone, "arquivado"), outdated)
    excluded = gone.select("note_id").union(outdated.select("note_id"))
    old = maintain.stale(now, today, settings.proc_stale_days, excluded)
    dying = gone.select("note_id", F.lit("arquivado").alias("state"), F.lit(None).cast("string").alias("successor"))
    dying = dying.union(outdated.select("note_id", F.lit("deprecado"), F.col("successors")[0]))
    dead = maintain.dead_notes(now).join(dying.select("note_id"), "note_id", "left_anti").union(dying)
    return Cycle(now, stamped, duplicates, gone, outdated, old, maintain.dead_citations(edges, documents, dead))
