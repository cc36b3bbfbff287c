"""Writing accepted candidates as notes: named, rendered, archived what they replace, indexed.

All files of a run, new notes and the archived ones, are moved to their places in one
commit (``sources.note_files``), so a run that fails leaves every file as it was.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank_to_null, strip_wikilink
from ..operators import maintain
from ..operators.write import plan_writes
from ..sources.note_files import notes as list_notes, read_contents, write_notes
from ..sources.notes import decoded, patched, rendered, yaml_value
from ..workspace import cut
from . import index_run

#: Front matter of a new note, in order.
FIELDS = ("title", "tags", "created", "modified", "agent", "profile", "scope", "source", "confidence", "last_accessed", "last_tested", "supersedes", "status")

#: Heading of a procedure's evidence: a fixed value of the format.
EVIDENCE = "## Evidência"


@dataclass(frozen=True)
class Written:
    """(note_id, path) of new notes and (note_id, target, action) of what they replace: archive, keep or missing."""

    notes: DataFrame
    replaced: DataFrame
    index: index_run.Report | None


def _targets(rows: DataFrame) -> DataFrame:
    """(note_id, target) for each note that a new one replaces."""
    named = rows.select("note_id", F.explode(F.coalesce("supersedes", F.array().cast("array<string>"))).alias("raw"))
    return named.select("note_id", strip_wikilink(F.col("raw")).alias("target")).where("target <> ''").distinct()


def with_evidence(kind: Column, body: Column, evidence: Column) -> Column:
    """A procedure's body with its evidence as a list below it; other bodies as they are."""
    items = F.filter(F.coalesce(evidence, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    listed = F.concat(F.lit(f"{EVIDENCE}\n\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), F.trim(x))), "\n"))
    text = F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), r"\r\n?", "\n"), r"^\n+|\n+$", "")
    cited = F.when(text == "", listed).otherwise(F.concat(text, F.lit("\n\n"), listed))
    return F.when((kind == "procedural") & (F.size(items) > 0), cited).otherwise(text)


def store(judged: DataFrame, vault: str, now: dt.datetime, required: Sequence[str] = (), index: str | None = None, settings: Mapping[str, Any] | None = None, provider: index_run.Provider | None = None) -> Written:
    """Write the accepted of ``gate.evaluate`` below ``vault`` and bring the index at ``index`` up to them.

    ``judged`` also has title; note_id names the candidate.  Names never collide with files
    that are there.  What a note supersedes is archived; episodic notes are history and
    stay; a target without a file is missing.  Rejected candidates write nothing.
    """
    spark = judged.sparkSession
    there = cut(list_notes(spark, vault, contents=False).select("path", index_run.note_of(F.col("path")).alias("id")))
    fine = cut(judged.where("accepted"))
    planned = plan_writes(fine, F.lit(now.date()), there.select(F.col("id").alias("name")), list(required))
    rows = fine.drop("folder", "file", "all_tags").join(planned, "note_id")
    stamp = F.lit(now.isoformat(sep=" ", timespec="seconds")).cast("timestamp") if now.tzinfo is None else F.lit(now).cast("timestamp")
    text = lambda c: blank_to_null(F.col(c))
    links = F.transform(F.filter(F.coalesce("supersedes", F.array().cast("array<string>")), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("[["), strip_wikilink(x), F.lit("]]")))
    made = rows.select(
        "note_id",
        F.concat(F.lit(vault.rstrip("/") + "/"), "folder", F.lit("/"), "file").alias("path"),
        text("title").alias("title"),
        F.col("all_tags").alias("tags"),
        stamp.alias("created"),
        stamp.alias("modified"),
        text("agent").alias("agent"),
        text("profile").alias("profile"),
        text("scope").alias("scope"),
        text("source").alias("source"),
        text("confidence").alias("confidence"),
        stamp.alias("last_accessed"),
        F.when(F.col("type") == "procedural", stamp).alias("last_tested"),
        F.when(F.size(links) > 0, links).alias("supersedes"),
        F.lit("ativo").alias("status"),
        with_evidence(F.col("type"), F.col("body"), F.col("evidence")).alias("body"),
    )
    new = cut(made.select("note_id", "path", rendered(made, list(FIELDS)).alias("content")))
    # of files with one name the first path counts
    files = there.groupBy("id").agg(F.min("path").alias("path"))
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    known = files.select(F.col("id").alias("target"), "path", maintain.type_of(folders, F.array().cast("array<string>"), "folder_first").alias("kind"))
    action = F.when(F.col("path").isNull(), "missing").when(F.col("kind") == "episodic", "keep").otherwise("archive")
    replaced = cut(_targets(fine).join(known, "target", "left").select("note_id", "target", action.alias("action"), "path"))
    old = replaced.where("action = 'archive'").select("path").distinct()
    archived = read_contents(old).select("path", patched(decoded(F.col("content")), {"status": yaml_value(F.lit("arquivado"), "string")}).alias("content"))
    write_notes(new.select("path", "content").unionByName(archived), vault)
    report = None
    if index is not None:
        touched = new.select("path").union(old)
        listed = list_notes(spark, vault, contents=False).join(touched, "path", "left_semi")
        report = index_run.run(spark, index, listed, read_contents, provider, settings, partial=True)
    return Written(new.select("note_id", "path"), replaced.drop("path"), report)
