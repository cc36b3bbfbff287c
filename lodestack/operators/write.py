"""Accepted candidates as notes to be stored; look-ups; proposals; derived documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import slug, strip_wikilink
from ..sources.notes import file_names

_PREFIX = {"semantic": "INS", "procedural": "PROC", "episodic": "MEM", "research": "RES"}
FOLDERS = {"semantic": "Semantic", "procedural": "Procedural", "episodic": "Episodic", "research": "Research"}


def note_name(kind: Column, title: Column, day: Column) -> Column:
    """``date_PREFIX_slug``; a missing date goes with its separator, as does the date of procedures."""
    prefix = F.lit(None).cast("string")
    for name, short in _PREFIX.items():
        prefix = F.when(kind == name, short).otherwise(prefix)
    dated = F.when(kind != "procedural", day.cast("string"))
    return F.concat_ws("_", dated, prefix, slug(F.coalesce(title, F.lit(""))))


def note_tags(kind: Column, agent: Column, required: list[str], own: Column) -> Column:
    """Type and agent tags, the required and the author's own, each once and in that order."""
    made = F.array(F.concat(F.lit("mem/"), kind), F.concat(F.lit("agent/"), agent), *map(F.lit, required))
    return F.array_distinct(F.filter(F.concat(made, F.coalesce(own, F.array().cast("array<string>"))), lambda t: t.isNotNull()))


def plan_writes(judged: DataFrame, day: Column, taken: DataFrame | None = None, required: list[str] | None = None) -> DataFrame:
    """note_id, folder, file and all_tags for the accepted of ``gate.evaluate``; names never collide.

    Episodic notes go into a folder of their agent.
    """
    fine = judged.where("accepted").withColumn("name", note_name(F.col("type"), F.col("title"), day))
    named = file_names(fine, taken)
    base = F.lit(None).cast("string")
    for kind, folder in FOLDERS.items():
        base = F.when(F.col("type") == kind, folder).otherwise(base)
    place = F.when(F.col("type") == "episodic", F.concat_ws("/", base, "agent")).otherwise(base)
    return named.select("note_id", place.alias("folder"), "file", note_tags(F.col("type"), F.col("agent"), required or [], F.col("tags")).alias("all_tags"))


def get(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (ref), an id or a wikilink, the note it names, or found = false."""
    refs = wanted.select("ref", strip_wikilink(F.col("ref")).alias("_id"))
    rows = refs.join(notes, refs["_id"] == notes["note_id"], "left")
    return rows.withColumn("found", F.col("note_id").isNotNull()).drop("_id")


def proposals(changes: DataFrame, notes: DataFrame) -> DataFrame:
    """(target, body, agent) as pending proposals for known notes; the targets are not touched."""
    known = notes.select(F.col("note_id").alias("target"))
    return changes.join(known, "target", "left_semi").select("target", "body", "agent", F.lit("pendente").alias("status"))


def stale_documents(stored: DataFrame, rendered: DataFrame) -> DataFrame:
    """path and state (missing, stale, left over) of derived documents (path, body) that are not as rendered now."""
    was, now = stored.select("path", F.col("body").alias("was")), rendered.select("path", F.col("body").alias("now"))
    both = was.join(now, "path", "full_outer")
    state = F.when(F.col("was").isNull(), "missing").when(F.col("now").isNull(), "left over").when(F.col("was") != F.col("now"), "stale")
    return both.select("path", state.alias("state")).where("state is not null")
